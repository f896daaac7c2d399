"""Line deduplication: lines that many documents share are dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, row_key, stored, with_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(key: Column) -> Column:
    """A-Z in lower case and nothing else; where all is ASCII, that is what lower() does, and faster."""
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def shared_lines(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(key_a, key_b, positions) for documents that lose lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stripped = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(SPACE)).alias("key")))
    long = F.filter(stripped, lambda x: (F.octet_length(x["key"]) >= least_chars) & (F.char_length(x["key"]) >= least_chars))
    lowered = F.transform(long, lambda x: F.struct(x["at"].alias("at"), _lower(x["key"]).alias("key")))
    hashed = F.transform(lowered, lambda x: F.struct(F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit("l"), x["key"], F.lit("l")).alias("b"), x["at"].alias("at")))
    keyed = docs.select(*row_key("doc_id", "text"), "doc_id", F.sort_array(hashed).alias("lines"))
    before = lambda i: F.try_element_at("lines", i)
    new = lambda x, i: (before(i)["a"] != x["a"]) | (before(i)["b"] != x["b"])
    marked = F.transform("lines", lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["at"].alias("at"), ((i == 0) | new(x, i)).alias("new")))
    placed = stored(keyed.select("key_a", "key_b", "doc_id", F.explode(marked).alias("x")).select("key_a", "key_b", "doc_id", "x.*"))
    counts = (
        placed.groupBy("a", "b")
        .agg(F.count_if("new").alias("n"), F.max("doc_id").alias("holder"), F.count("*").alias("rows"))
        .where(F.col("n") >= least_docs)
        .select("a", "b", "holder", "rows")
    )
    dropped = with_keys(placed.drop("new"), stored(counts), ["a", "b"], "holder").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return dropped.groupBy("key_a", "key_b").agg(F.collect_set("at").alias("positions"))


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, kept_text) for every row of ``docs`` (doc_id, text).

    Lines are split at \n; a line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at
    least ``least_chars`` code points in at least ``least_docs`` documents lose all their lines but those of
    the document with the largest doc_id; within it, repeats stay. Null and empty texts are one empty line. Very long texts are
    read whole.
    Each row counts as a document; rows that repeat a doc_id count each, and all of them hold their lines if
    it is the largest. A null doc_id sorts below all others. Other columns are ignored.

    Keys travel as 128-bit hashes, written once with their places and counted map-side first; frequent keys are broadcast
    to their places, so none fills a task; only positions to drop come back to a document, whose lines are joined again
    by expressions.
    """
    gone = shared_lines(docs, least_chars, least_docs)
    whole = docs.select(*row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(gone, ["key_a", "key_b"], "left")
    lines = whole.withColumn("lines", F.split("text", "\n", -1))
    # the places that stay, by a set difference that keeps their order
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "positions")
    kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda at: F.get("lines", at)), "\n"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("positions").isNull(), F.lit(0)).otherwise(F.size("positions")).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def digest_of_lines(docs: DataFrame) -> DataFrame:
    """``line_dedup`` with the kept text's SHA-256 (lowercase hex) in its place; rows, nulls and ties as there."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same in DuckDB's SQL.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE s.k IS NOT NULL AND holder <> doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.k IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s ON keyed.k = s.k GROUP BY doc_id
"""
