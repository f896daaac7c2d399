"""Helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set (tests, a notebook) a folder of this machine is used, and then only with a local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tracelode-checkpoints")
    return folder


#: Bytes of a stored table's row groups.
ROW_GROUP = 16 << 20
#: Rows of a file, where their number is known beforehand.
FILE_ROWS = 100_000
_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted as the driver's JVM ends."""
    name = spark.sparkContext.applicationId
    if name not in _folders:
        folder = f"{shared_folder(spark)}/tracelode-{name}-{uuid.uuid4().hex[:8]}"
        place, files = _path(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _folders[name] = folder
    return _folders[name]


def delete(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def stored(df: DataFrame, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, its lineage cut: no lost executor makes it anew.

    Tables go with the application, or as the ``scratch`` around them ends. Spark takes a table's size for its files', so what is
    made of few of its bytes (exploded ranges) needs a join hint. Row groups are small, as a task holds one in memory until it is written.
    A table of known few ``rows`` gets few files: a file system without native calls starts processes for each.
    """
    if rows is not None:
        df = df.coalesce(max(1, rows // FILE_ROWS))
    path = f"{own_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    write = df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP)
    if _scopes:
        _scopes[-1].append(path)
        with _swept(df.sparkSession):
            write.parquet(path)
    else:
        write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether the shuffle files of a statement go as it ends, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored within as it ends; what reads them has to be written by then.

    Shuffle files of what is stored within go with each write.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


#: Bytes of an Arrow batch that goes to Python. Executors hold batches on both sides, and memory that held large ones stays with their processes.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about ``BATCH`` bytes; the session keeps it, as results are made after a stage returns."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives as a stored table; the tables that it stored on its way are deleted."""
    with scratch(spark):
        out = stored(make())
        path = _scopes[-1].pop()
    if _scopes:
        _scopes[-1].append(path)
    return out


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by its values; equal rows share it, nulls take part."""
    values = [F.col(c) for c in columns]
    return [F.xxhash64(*values).alias("key_a"), F.xxhash64(F.lit("b"), *values, F.lit("b")).alias("key_b")]


#: Keys that are joined by broadcast because they are frequent, at most: each has more than this part of all rows.
FREQUENT = 1 << 12


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], *columns: str) -> DataFrame:
    """``rows`` whose key ``on`` is in ``keys`` (on, rows, columns), with those columns; a frequent key doesn't fill a task.

    ``keys.rows`` is how many of ``rows`` a key has. Keys with more than a ``FREQUENT``-th part of all, so fewer than
    ``FREQUENT`` of them whatever the size, are broadcast; all others meet by shuffle. ``rows`` is read up to three times, so it should be stored.
    """
    most = rows.count() // FREQUENT + 1000
    few = keys.where(F.col("rows") > most).select(*on, *columns)
    rest = keys.where(F.col("rows") <= most).select(*on, *columns)
    how = "inner" if columns else "left_semi"
    if few.isEmpty():
        return rows.join(rest.hint("shuffle_hash"), on, how)
    cold = rows.join(F.broadcast(few.select(*on).distinct()), on, "left_anti")
    return rows.join(F.broadcast(few), on, how).unionByName(cold.join(rest.hint("shuffle_hash"), on, how))


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str, at_once: int = 256) -> Iterator[tuple]:
    """The named columns' values, row by row; ``at_once`` rows of one batch are Python values at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            some = batch.slice(start, at_once)
            yield from zip(*(some.column(some.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, weight=None, most_weight: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``most`` rows, or of about ``most_weight`` of ``weight(row)``."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 0
        if len(held) >= most or load >= most_weight:
            yield _batch(held, schema)
            held, load = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
