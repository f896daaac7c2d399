"""A stored graph: schemas, versioned tables of a project, and the swap that replaces a graph as a whole.

A project's tables are Parquet folders below ``root``; one small file names the folder of each, so a reader sees either
the old graph or the new one. Edges are stored twice, in ranges of their source and of their target, by type: a filter on types skips
folders, and a lookup of one node reads the files and row groups whose ranges hold it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stored
from ..operators.graph import PropertyGraph
from ..operators.tables import upsert

#: The tables and their columns. Node and edge types, and the project, are folders.
SCHEMAS = {
    "projects": "id string, name string, root string, language string, file_count long, symbol_count long, edge_count long, created_at long, updated_at long",
    "files": "path string, language string, hash string, size long, created_at long, updated_at long",
    "nodes": "id string, type string, name string, full_name string, file_path string, summary string, is_exported boolean, start_line int, end_line int, start_col int, end_col int, metadata string",
    "edges": "id string, type string, from_id string, to_id string, resolved boolean, metadata string",
    "provenance": "subject_id string, subject string, idx int, type string, source_file string, start_line int, end_line int, start_col int, end_col int, text string, confidence double, created_at long, updated_at long",
    "ranking": "node_id string, score double, algorithm string, components map<string,double>, computed_at long",
    "index_state": "id string, file_count long, node_count long, edge_count long, updated_at long",
}
KEYS = {"projects": ["id"], "files": ["path"], "nodes": ["id"], "edges": ["id"], "ranking": ["node_id"], "index_state": ["id"]}
#: What lookups go by: a table's copies and the column in whose ranges each lies.
COPIES = {"nodes": {"nodes": "id"}, "edges": {"edges": "from_id", "edges_by_target": "to_id"}}
NODE_COLUMNS = ["id", "type", "name", "full_name", "file_path", "summary", "is_exported"]
EDGE_COLUMNS = ["id", "type", "from_id", "to_id", "resolved"]
#: Rows of one range, about.
RANGE = 2_000_000
_written: dict[tuple, DataFrame] = {}


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def shaped(df: DataFrame, table: str) -> DataFrame:
    """``df`` with a table's columns and types; what it lacks is null."""
    kinds = [c.split(" ", 1) for c in SCHEMAS[table].split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


class Store:
    """The stored tables of one project."""

    def __init__(self, spark: SparkSession, root: str, project: str):
        self.spark, self.project = spark, project
        self.home = f"{root.rstrip('/')}/{hashlib.sha1(project.encode()).hexdigest()[:16]}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        place, files = self._files(f"{self.home}/current.json")
        if not files.exists(place):
            return {"tables": {}, "closed": False}
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, current: dict) -> None:
        """Replaces the file that names the folders: written beside it first, then renamed."""
        fresh, files = self._files(f"{self.home}/current-{uuid.uuid4().hex}.json")
        stream = files.create(fresh)
        stream.write(bytearray(json.dumps(current).encode()))
        stream.close()
        old, _ = self._files(f"{self.home}/current.json")
        if files.exists(old):
            files.delete(old, False)
        files.rename(fresh, old)

    def create(self) -> None:
        """Makes the project's tables where they are missing; those that are there stay as they are."""
        missing = [t for t in SCHEMAS if t not in self._current()["tables"]]
        self.commit({t: self.spark.createDataFrame([], SCHEMAS[t]) for t in missing})

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replaces tables, all at once; the folders that they leave are deleted then.

        Each relation is made once, as plain rows, from which its copies are laid out. With nodes and edges it is found out here
        whether every edge's ends are nodes.
        """
        current, gone, rows = self._current(), [], {}
        for table, df in tables.items():
            folder = f"{self.home}/{table}-{uuid.uuid4().hex}"
            shaped(df, table).write.parquet(folder)
            rows[table] = self.spark.read.schema(SCHEMAS[table]).parquet(folder)
            for name, key in COPIES.get(table, {table: None}).items():
                gone += [current["tables"][name]] if name in current["tables"] else []
                current["tables"][name] = folder if key is None else self._laid_out(rows[table], f"{self.home}/{name}-{uuid.uuid4().hex}", key)
            gone += [folder] if table in COPIES else []
        if "nodes" in rows and "edges" in rows:
            ends = rows["edges"].select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
            current["closed"] = ends.join(rows["nodes"].select("id"), "id", "left_anti").isEmpty()
        elif "nodes" in rows or "edges" in rows:
            current["closed"] = False
        self._swap(current)
        for folder in gone:
            place, files = self._files(folder)
            files.delete(place, True)

    def _laid_out(self, rows: DataFrame, folder: str, key: str) -> str:
        """A copy in ranges of ``key``, a folder a type, sorted."""
        ranges = max(1, -(-rows.count() // RANGE), min(8, self.spark.sparkContext.defaultParallelism))
        rows.repartitionByRange(ranges, key).sortWithinPartitions("type", key).write.partitionBy("type").parquet(folder)
        return folder

    def read(self, table: str) -> DataFrame:
        """A table as it stands; one that was never written is empty."""
        folder, schema = self._current()["tables"].get(table), SCHEMAS["edges" if table == "edges_by_target" else table]
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder).select(*[c.split()[0] for c in schema.split(", ")])

    def replace_graph(self, nodes: DataFrame, edges: DataFrame, provenance: DataFrame | None = None) -> None:
        """Nodes, edges and provenance anew, in one swap."""
        empty = self.spark.createDataFrame([], SCHEMAS["provenance"])
        self.commit({"nodes": nodes, "edges": edges, "provenance": empty if provenance is None else provenance})

    def upsert(self, table: str, rows: DataFrame, keep: tuple[str, ...] = ("created_at",)) -> None:
        """Rows over those of the same key; a row's first ``created_at`` stays."""
        new = shaped(rows, table)
        keep = tuple(c for c in keep if c in columns(table))
        version = "computed_at" if table == "ranking" else "updated_at"
        self.commit({table: upsert(self.read(table), new, KEYS[table], version, keep)})

    def stored_ranking(self, scores: DataFrame) -> DataFrame:
        """The stored ranking; where there is none, ``scores`` are stored first."""
        if self.read("ranking").isEmpty():
            self.commit({"ranking": scores})
        return self.read("ranking")

    def graph(self) -> PropertyGraph:
        """The stored graph."""
        nodes, edges = self.read("nodes").select(*NODE_COLUMNS), self.read("edges").select(*EDGE_COLUMNS)
        reverse = self.read("edges_by_target").select(*EDGE_COLUMNS) if "edges_by_target" in self._current()["tables"] else None
        return PropertyGraph(nodes, edges, self._current()["closed"], reverse)


def written(spark: SparkSession, source: str, name: str, make) -> DataFrame:
    """The relation that ``make()`` gives for the data folder ``source``, written once an application, as it comes.

    It is made anew when the folder's files are others than before, by name, length or time.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listing = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(place))
    key = (spark.sparkContext.applicationId, source, name, hashlib.sha1("\n".join(listing).encode()).hexdigest())
    if key not in _written:
        _written[key] = stored(make())
    return _written[key]
