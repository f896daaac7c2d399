"""Files to graph, and what is stored of it: registered over sources that the tables give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as indexer
from ..operators.components import shared_folder
from ..operators.endpoints import Endpoints
from ..operators.resolve import by_shuffle
from ..sources import files as sources
from ..sources.store import SCHEMAS, Store
from .registry import Data, query

#: A source for every supplier, which calls the next one's function, and one for every customer.
SOURCES = """
SELECT concat('/repo/s/', s_suppkey, '.ts') AS path,
       concat('import ', chr(123), ' s', s_suppkey + 1, ' ', chr(125), ' from "./', s_suppkey + 1, '";', chr(10), 'export function s', s_suppkey, '() ', chr(123), chr(10), '  s', s_suppkey + 1, '();', chr(10), '  missing', s_suppkey % 5, '();', chr(10), chr(125), chr(10)) AS content FROM {supplier}
UNION ALL SELECT concat('/repo/c/', c_custkey, '.ts'),
       concat('import ', chr(123), ' s', c_custkey % 10, ' ', chr(125), ' from "../s/', c_custkey % 10, '.js";', chr(10), chr(10), 'export class C', c_custkey, ' extends C', c_custkey - 1, ' ', chr(123), chr(10), '  run() ', chr(123), chr(10), '    s', c_custkey % 10, '();', chr(10), '    other.helper', c_custkey % 7, '();', chr(10), '  ', chr(125), chr(10), chr(125), chr(10)) FROM {customer}
"""
#: What the graph of those sources has, by names, from the tables alone.
EXPECTED = """WITH s AS (SELECT s_suppkey AS k, s_suppkey = max(s_suppkey) OVER () AS is_last FROM supplier), c AS (SELECT c_custkey AS k, c_custkey = min(c_custkey) OVER () AS is_first FROM customer),
    e AS (
    SELECT 'OWNS' AS type, 'tables' AS a, 's/' || k || '.ts' AS b, true AS resolved FROM s UNION ALL SELECT 'OWNS', 'tables', 'c/' || k || '.ts', true FROM c
    UNION ALL SELECT unnest(['DEFINES', 'EXPORTS']), 's/' || k || '.ts', 's' || k, true FROM s
    UNION ALL SELECT unnest(['DEFINES', 'EXPORTS']), 'c/' || k || '.ts', 'C' || k, true FROM c
    UNION ALL SELECT 'DEFINES', 'c/' || k || '.ts', 'run', true FROM c UNION ALL SELECT 'OWNS', 'C' || k, 'run', true FROM c
    UNION ALL SELECT unnest(['IMPORTS', 'DEPENDS_ON']), 's/' || k || '.ts', 's/' || (k + 1) || '.ts', true FROM s WHERE NOT is_last
    UNION ALL SELECT 'IMPORTS', 's/' || k || '.ts', 's' || (k + 1), true FROM s WHERE NOT is_last
    UNION ALL SELECT 'IMPORTS', 's/' || k || '.ts', './' || (k + 1), false FROM s WHERE is_last
    UNION ALL SELECT unnest(['IMPORTS', 'DEPENDS_ON']), 'c/' || k || '.ts', 's/' || (k % 10) || '.ts', true FROM c
    UNION ALL SELECT 'IMPORTS', 'c/' || k || '.ts', 's' || (k % 10), true FROM c
    UNION ALL SELECT 'EXTENDS', 'C' || k, 'C' || (k - 1), true FROM c WHERE NOT is_first
    UNION ALL SELECT 'CALLS', 's' || k, 's' || (k + 1), true FROM s WHERE NOT is_last
    UNION ALL SELECT 'CALLS_UNRESOLVED', 's' || k, 's' || (k + 1), false FROM s WHERE is_last
    UNION ALL SELECT 'CALLS_UNRESOLVED', 's' || k, 'missing' || (k % 5), false FROM s
    UNION ALL SELECT 'CALLS', 'run', 's' || (k % 10), true FROM c
    UNION ALL SELECT 'CALLS_UNRESOLVED', 'run', 'other.helper' || (k % 7), false FROM c)
    SELECT type, a AS from_name, b AS to_name, resolved, count(*) AS n FROM e GROUP BY 1, 2, 3, 4"""


def _files(d: Data) -> DataFrame:
    from ..sources.tables import on_spark

    made = on_spark(d.spark, d.sf_dir, SOURCES)
    return made.select("path", "content", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def _store(d: Data) -> Store:
    return Store(d.spark, f"{shared_folder(d.spark)}/stores-{uuid.uuid4().hex}", "tables")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return edges.join(by_shuffle(a), "from_id").join(by_shuffle(b), "to_id").groupBy("type", "from_name", "to_name", "resolved").agg(F.count("*").alias("n"))


@query("index_files", EXPECTED)
def index_files(d: Data) -> DataFrame:
    """Sources parsed, resolved and made one graph: its edges by the names of their ends."""
    built = indexer.index(_files(d), "tables", "/repo")
    return _named(built.nodes, built.edges)


@query("replace_graph", EXPECTED)
def replace_graph(d: Data) -> DataFrame:
    """The same stored, over a graph that was there before, and read again."""
    store = _store(d)
    store.replace_graph(d.bound("nodes"), d.bound("edges"))
    indexer.rebuild(store, _files(d), "/repo")
    return _named(store.read("nodes"), store.read("edges_by_target"))


@query("index_provenance", "SELECT 's' || s_suppkey AS name, '/repo/s/' || s_suppkey || '.ts' AS source_file, 2 AS start_line, 5 AS end_line, 8 AS start_col, 2 AS end_col, 'function s' || s_suppkey || '() {' || chr(10) || '  s' || (s_suppkey + 1) || '();' || chr(10) || '  missing' || (s_suppkey % 5) || '();' || chr(10) || '}' AS text FROM supplier")
def index_provenance(d: Data) -> DataFrame:
    """Where the functions stand, from first to last line and column, and their text."""
    built = indexer.index(_files(d), "tables", "/repo")
    named = built.nodes.where("type = 'function'").select(F.col("id").alias("subject_id"), "name")
    spans = built.provenance.where("subject = 'node'").join(by_shuffle(named), "subject_id")
    return spans.select("name", "source_file", "start_line", "end_line", "start_col", "end_col", "text")


@query("index_state_upsert", "SELECT 'tables' AS id, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS file_count, CAST(2 AS BIGINT) AS updated_at")
def index_state_upsert(d: Data) -> DataFrame:
    """The state after two runs over the same files: one row, the later run's."""
    store = _store(d)
    store.create()
    for time in (1, 2):
        counts = _files(d).agg(F.count("*").alias("file_count")).select(F.lit("tables").alias("id"), "file_count", F.lit(time).cast("long").alias("updated_at"))
        store.upsert("index_state", counts)
    return store.read("index_state").select("id", "file_count", "updated_at")


@query("table_schemas", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c.split(' ')[0]}')" for t, cs in SCHEMAS.items() for c in cs.split(", ")) + ") v(table_name, column_name)")
def table_schemas(d: Data) -> DataFrame:
    """The columns of the stored tables, made where they are missing, from the tables themselves."""
    store = _store(d)
    store.create()
    store.create()
    rows = [(t, c) for t in SCHEMAS for c in store.read(t).columns]
    return d.spark.createDataFrame(rows, "table_name string, column_name string")


@query("update_files", "SELECT concat('/repo/s/', s_suppkey, '.ts') AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'removed' WHEN s_suppkey % 7 = 0 THEN 'changed' ELSE 'added' END AS change FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0")
def update_files(d: Data) -> DataFrame:
    """What changed since the last run of the indexer, which then runs again."""
    every, store = _files(d).where("path LIKE '/repo/s/%'"), _store(d)
    key = F.regexp_extract("path", "(\\d+)", 1).cast("long")
    gone, other, fresh = key % 5 == 0, key % 7 == 0, key % 11 == 0
    indexer.rebuild(store, every.where(~(fresh & ~gone & ~other)), "/repo")
    now = every.where(~gone).withColumn("content", F.when(other, F.concat("content", F.lit("// more\n"))).otherwise(F.col("content"))).withColumn("hash", F.sha2("content", 256))
    return indexer.update(store, now, "/repo", time=1)


@query("json_graph", "SELECT id, type, name FROM nodes WHERE type IN ('file', 'module')")
def json_graph(d: Data) -> DataFrame:
    """A graph written as one JSON line a node or edge, and read again: the exchange with other programs."""
    folder = f"{shared_folder(d.spark)}/json-{uuid.uuid4().hex}"
    sources.write_json_graph(d.graph.nodes_of("file", "module"), d.graph.edges_of("OWNS"), folder)
    return sources.read_json_graph(d.spark, folder)[0].select("id", "type", "name")


@query("stored_ranking", "WITH e AS (SELECT to_id AS id FROM edges UNION ALL SELECT from_id FROM edges), g AS (SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN e ON n.id = e.id GROUP BY 1) SELECT id AS node_id, 'degree_importance' AS algorithm, floor(degree / (SELECT greatest(1, max(degree)) FROM g) * 1000000.0 + 0.5) / 1000000.0 AS centrality FROM g")
def stored_ranking(d: Data) -> DataFrame:
    """The ranking that is stored where there was none, and read as it is afterwards."""
    store = _store(d)
    scores = d.graph.server_importance().join(d.graph.degree_centrality(), "id")
    scores = scores.select(F.col("id").alias("node_id"), F.col("importance").alias("score"), F.lit("degree_importance").alias("algorithm"), F.create_map(F.lit("centrality"), "centrality").alias("components"), F.lit(0).cast("long").alias("computed_at"))
    store.stored_ranking(scores)
    again = store.stored_ranking(scores.limit(0))
    return again.select("node_id", "algorithm", F.col("components")["centrality"].alias("centrality"))


@query("endpoint_node", "WITH w AS (SELECT 'outgoing' AS direction, type, id, to_id AS other FROM edges WHERE from_id = 'c7' UNION ALL SELECT 'incoming', type, id, from_id FROM edges WHERE to_id = 'c7') SELECT 'summary' AS part, direction, type AS name, count(*) AS n FROM w GROUP BY 2, 3 UNION ALL SELECT 'relations', direction, name, count(*) FROM w JOIN nodes ON nodes.id = other GROUP BY 2, 3 UNION ALL SELECT 'node', 'c7', (SELECT name FROM nodes WHERE id = 'c7'), (SELECT count(*) FROM w)")
def endpoint_node(d: Data) -> DataFrame:
    """A node's payload: itself with its degree, its edges by type, and what they lead to."""
    parts = Endpoints(d.graph).node("c7")
    node = parts["node"].select(F.lit("node").alias("part"), F.col("id").alias("direction"), "name", F.col("degree").alias("n"))
    summary = parts["summary"].select(F.lit("summary").alias("part"), "direction", F.col("edge_type").alias("name"), "n")
    relations = parts["relations"].groupBy("direction", "other_name").agg(F.count("*").alias("n"))
    return node.union(summary).union(relations.select(F.lit("relations"), "direction", "other_name", "n"))


@query("parameter_flow", "SELECT e.id, a.name AS from_name, b.name AS to_name, 'parameter_passing' AS type FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE e.type = 'CALLS' AND length(e.to_id) % 2 = 0")
def parameter_flow(d: Data) -> DataFrame:
    """From which caller to which callee parameters pass, for calls whose metadata lists some."""
    from ..functions.labels import parameter_flow as flow

    given = F.when(F.length("to_id") % 2 == 0, F.array("to_id")).otherwise(F.array())
    calls = d.graph.edges_of("CALLS").withColumn("parameters", given)
    a, b = d.graph.nodes.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), d.graph.nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    found = calls.join(a, "from_id").join(b, "to_id").withColumn("flow", flow(F.col("from_name"), F.col("to_name"), F.col("parameters")))
    return found.where("flow IS NOT NULL").select("id", F.col("flow.from")[0].alias("from_name"), F.col("flow.to")[0].alias("to_name"), F.col("flow.type").alias("type"))


