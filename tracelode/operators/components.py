"""Lineage cuts and connected components, shared by the iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set (tests, a notebook) a folder of this machine is used, and then only with a local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tracelode-checkpoints")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_folders: dict[str, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the application's folder of the shared one, its lineage cut.

    Unlike a checkpoint it has a size that the optimiser knows, so a small one is broadcast and a large one is shuffled.
    """
    spark = df.sparkSession
    name = spark.sparkContext.applicationId
    if name not in _folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tracelode-core-{name}-{uuid.uuid4().hex[:8]}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _folders[name] = place.toString()
    path = f"{_folders[name]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(file)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def propagate(labels: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, label) after every edge (u, v) has passed on the least label from u to v until nothing changes."""
    labels, edges = stored(labels), stored(edges.select("u", "v").distinct())
    for _ in range(most_rounds):
        passed = labels.withColumnRenamed("id", "u").join(edges, "u").groupBy("v").agg(F.min("label").alias("got"))
        step = stored(labels.join(passed, labels["id"] == passed["v"], "left").select("id", F.least("label", F.coalesce("got", "label")).alias("label"), (F.coalesce("got", "label") < F.col("label")).alias("moved")))
        dropped(labels)
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            dropped(edges)
            return labels
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node: the least id reachable over edges in either direction."""
    pairs = edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    found = stars(pairs)
    return nodes.join(found, nodes["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))


def _rooted(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of ``pairs`` (u, v): where the way over each node's least neighbour ends, if that is less than the node."""
    both = pairs.union(pairs.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
    labels = stored(both.select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(labels.join(ahead, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        dropped(labels)
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the least node that it can reach.

    Every node goes to its least neighbour, and from there on until none is less; pairs then stand for those roots, and what is left
    of them is contracted again. Roots are halved by any two rounds at least. A node with very many edges is reduced map-side to its least
    partner, and the joins can be split by skew handling. Pairs of a node with itself and nulls are left out; no pairs give no rows.
    """
    pairs, chain = stored(edges.select("u", "v").where("u <> v")), []
    for _ in range(most_rounds):
        if chain and pairs.isEmpty():
            break
        chain.append(_rooted(pairs))
        a, b = chain[-1].toDF("u", "a"), chain[-1].toDF("v", "b")
        left = stored(pairs.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        dropped(pairs)
        pairs = left
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = chain.pop()
    for labels in reversed(chain):
        onward = found.select(F.col("node").alias("label"), F.col("label").alias("component"))
        found = stored(labels.join(onward, "label", "left").select("node", F.coalesce("component", "label").alias("label")))
    return found.withColumnRenamed("label", "component")
