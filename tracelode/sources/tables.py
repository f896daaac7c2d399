"""Tables of a data folder, and the SQL that both engines run on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Shared SQL on Spark: ``{table}`` names a table of the folder, ``{S}`` the string type."""
    used = {n: read(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text.replace("{S}", "STRING"), **used)


def on_duckdb(text: str) -> str:
    """The same SQL for an engine where the tables are views."""
    return re.sub(r"\{(\w+)\}", lambda m: "VARCHAR" if m[1] == "S" else m[1], text)
