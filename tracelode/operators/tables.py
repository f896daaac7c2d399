"""Changes of stored tables: upserts, deletions, snapshots and provenance, as new versions of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str = "updated_at", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``old`` with ``new`` over it by key: the greatest version's row, but the least value of the columns in ``keep``."""
    both = old.unionByName(new)
    rest = [c for c in old.columns if c not in keys]
    chosen = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("x"), *[F.min(c).alias(f"least_{c}") for c in keep])
    return chosen.select(*[F.col(c) if c in keys else (F.col(f"least_{c}").alias(c) if c in keep else F.col(f"x.{c}").alias(c)) for c in old.columns])


def kept(old: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still present."""
    return old.join(present.select(key).distinct(), key, "left_semi")


def deleted(old: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return old.join(present.select(key).distinct(), key, "left_anti")


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed; equal values, nulls included, give no row."""
    a = old.select(F.col(key), F.col(value).alias("old_"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.col(value).alias("new_"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_").eqNullSafe(F.col("new_")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def merged_partially(old: DataFrame, new: DataFrame, impacted: DataFrame, key: str = "id", place: str = "file_path") -> DataFrame:
    """Old rows outside the impacted files (file_path), and the new rows over them by key."""
    rest = old.join(impacted.select(place).distinct(), place, "left_anti").select(*old.columns)
    both = rest.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return latest(both, [key], F.col("new_")).drop("new_")


def with_provenance(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes with their number of spans and their places, first by index; one join instead of a lookup per node."""
    joined = spans.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("span_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "source_file", "start_line"))), lambda s: F.concat_ws(":", s["source_file"], s["start_line"])), ",").alias("places"))
    return nodes.join(joined, "id", "left").withColumns({"span_count": F.coalesce("span_count", F.lit(0)), "places": F.coalesce("places", F.lit(""))})


def provenance_header(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, type, confidence, first_line): the first span's header, with defaults where there is none."""
    first = spans.groupBy(F.col("subject_id").alias("id")).agg(F.min_by("start_line", F.struct("idx", "rest")).alias("first_line"), F.min_by("rest", F.struct("idx", "rest")).alias("rest"))
    return nodes.select("id").join(first, "id", "left").select("id", F.lit("parser").alias("type"), F.when(F.col("rest") == 0, 0.7).otherwise(1.0).alias("confidence"), F.coalesce("first_line", F.lit(0)).alias("first_line"))


def exploded_spans(subjects: DataFrame, spans: str = "spans") -> DataFrame:
    """A row per span of the array column, and a blank one for a subject without any."""
    x = F.col("x")
    out = subjects.select("id", F.posexplode_outer(spans).alias("idx", "x"))
    return out.select("id", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce(x["source_file"], F.lit("")).alias("source_file"), F.coalesce(x["start_line"], F.lit(0)).alias("start_line"), F.coalesce(x["end_line"], F.lit(0)).alias("end_line"))
