"""Exact deduplication: a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_keys


def digests(docs: DataFrame, text: Column) -> DataFrame:
    """Each document's digest, and a second digest and the length that verify it."""
    return docs.select(
        "doc_id",
        F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


KEYS = ["text_sha256", "check", "n_bytes"]


def merge_runs(runs: DataFrame, partitions: int, fan_in: int = 2) -> DataFrame:
    """One row per digest: the largest identifier, and how many rows hold it.

    Each partition is a run. Rounds are binomial: in round r the runs of two partitions whose numbers differ in bit r alone
    (``fan_in`` of them, for a wider merge) are exchanged by (run, digest) and merged in digest order (the identifier is kept
    as a struct, so Spark merges sorted rows instead of hashing them); the next round has half as many runs, until one is
    left, which stays dealt out by digest. A digest that very many rows share thus shrinks to one row per run before it meets
    the others. At every level rows count as equal, and give up all but one identifier, only where digest, second digest and length all agree.
    """
    level = runs.select(*KEYS, F.struct("doc_id").alias("keep"), F.lit(1).cast("long").alias("n"), F.spark_partition_id().alias("run"))
    left = partitions
    while left > 1:
        left = -(-left // fan_in)
        run = (F.col("run") / fan_in).cast("int") if left > 1 else F.lit(0)
        level = level.withColumn("run", run).groupBy("run", *KEYS).agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    if partitions <= 1:
        level = level.groupBy(*KEYS).agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    return level.select(*KEYS, F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Of rows with identical texts the one with the largest doc_id stays; keep_id names it. A null text counts
    as empty, so all null and empty texts form one group. Rows that repeat one doc_id with the same text are
    all kept if that doc_id is the group's largest (they are the same document). A null doc_id sorts below
    all others. Other columns are ignored; very long texts are hashed whole; an empty table gives no rows.

    Texts are read and hashed once; digests stand in a table from which runs are merged, and to whose rows results come back.
    """
    found = stored(digests(docs, F.coalesce("text", F.lit(""))))
    merged = stored(merge_runs(found, found.rdd.getNumPartitions(), fan_in))
    out = with_keys(found, merged.withColumn("rows", F.col("group_size")), KEYS, "keep_id", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


#: The same in DuckDB's SQL.
SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
