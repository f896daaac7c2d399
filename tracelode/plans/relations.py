"""Scans, filters, joins, counts, changes of tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import stable_id
from ..operators import export, tables
from ..operators.graph import PropertyGraph, by_type
from ..sources.files import glob, supported
from .registry import Data, query

NODE = "id, type, name, full_name, file_path, summary, is_exported"
EDGE = "id, type, from_id, to_id, resolved"


@query("scan_nodes", f"SELECT {NODE} FROM nodes")
def scan_nodes(d: Data) -> DataFrame:
    return d.graph.nodes


@query("scan_edges", f"SELECT {EDGE} FROM edges")
def scan_edges(d: Data) -> DataFrame:
    return d.graph.edges


@query("filter_glob", "SELECT id, file_path FROM nodes WHERE (file_path = '/repo/Brand#1' OR starts_with(file_path, '/repo/Brand#1/') OR ends_with(file_path, '//repo/Brand#1') OR ends_with(file_path, 'NATION_3')) AND NOT ends_with(file_path, '/NATION_1')")
def filter_glob(d: Data) -> DataFrame:
    path = F.col("file_path")
    kept = glob(path, ["/repo/Brand#1", "*NATION_3"], True) | path.endswith("NATION_3")
    return d.graph.nodes.where(kept & ~glob(path, ["NATION_1"], False)).select("id", "file_path")


@query("filter_glob_empty", "SELECT path, false AS excluded, true AS included FROM files")
def filter_glob_empty(d: Data) -> DataFrame:
    """No patterns: nothing is excluded, everything is included."""
    return d.bound("files").select("path", glob(F.col("path"), [], False).alias("excluded"), glob(F.col("path"), [], True).alias("included"))


@query("filter_extension", "SELECT path FROM files WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')")
def filter_extension(d: Data) -> DataFrame:
    return d.bound("files").where(supported(F.col("path"))).select("path")


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(
    "nodes_with_provenance",
    """WITH p AS (SELECT subject_id, count(*) AS n, string_agg(source_file || ':' || start_line, ',' ORDER BY idx, source_file, start_line) AS places FROM spans GROUP BY 1)
    SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS span_count, coalesce(places, '') AS places FROM nodes LEFT JOIN p ON id = subject_id""",
)
def nodes_with_provenance(d: Data) -> DataFrame:
    return tables.with_provenance(d.graph.nodes, d.bound("spans")).select("id", "span_count", "places")


@query(
    "provenance_header",
    """WITH f AS (SELECT subject_id, start_line, rest, row_number() OVER (PARTITION BY subject_id ORDER BY idx, rest) AS r FROM spans)
    SELECT id, 'parser' AS type, CASE WHEN rest = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, coalesce(start_line, 0) AS first_line FROM nodes LEFT JOIN f ON id = subject_id AND r = 1""",
)
def provenance_header(d: Data) -> DataFrame:
    return tables.provenance_header(d.graph.nodes, d.bound("spans"))


@query("project_metadata", "SELECT id, name, (SELECT count(*) FROM nodes WHERE type = 'file') AS file_count, (SELECT count(*) FROM nodes WHERE type NOT IN ('file', 'project')) AS symbol_count, (SELECT count(*) FROM edges) AS edge_count FROM nodes WHERE full_name = 'project'")
def project_metadata(d: Data) -> DataFrame:
    g = d.graph
    counts = g.nodes.agg(F.count_if(F.col("type") == "file").alias("file_count"), F.count_if(~F.col("type").isin("file", "project")).alias("symbol_count"))
    return g.nodes.where(F.col("full_name") == "project").select("id", "name").crossJoin(counts).crossJoin(g.edges.agg(F.count("*").alias("edge_count")))


@query("file_hashes", "SELECT path, hash FROM old_files")
def file_hashes(d: Data) -> DataFrame:
    return d.bound("old_files").select("path", "hash")


@query("index_state", "SELECT 'project' AS project_id, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges WHERE NOT resolved) AS unresolved_count")
def index_state(d: Data) -> DataFrame:
    e = d.graph.edges.agg(F.count("*").alias("edge_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))
    return d.graph.nodes.agg(F.count("*").alias("node_count")).crossJoin(e).select(F.lit("project").alias("project_id"), "node_count", "edge_count", "unresolved_count")


@query("filter_inside_root", "SELECT path, NOT contains(path, '..') AND starts_with(path, '/repo/') AS inside FROM (SELECT path FROM files UNION ALL SELECT '/repo' UNION ALL SELECT path || '/../../../../../etc' FROM files)")
def filter_inside_root(d: Data) -> DataFrame:
    files = d.bound("files").select("path")
    odd = files.select(F.concat("path", F.lit("/../../../../../etc")).alias("path"))
    root = d.spark.createDataFrame([("/repo",)], "path string")
    return files.union(root).union(odd).select("path", paths.inside(F.col("path"), "/repo").alias("inside"))


# changes of tables


@query("upsert_projects", "SELECT region AS root, arg_max(name, v) AS name, CAST(min(v) AS BIGINT) AS created_at, CAST(max(v) AS BIGINT) AS updated_at FROM (SELECT region, name, key AS v FROM files) GROUP BY 1")
def upsert_projects(d: Data) -> DataFrame:
    rows = d.bound("files").select(F.col("region").alias("root"), "name", F.col("key").cast("long").alias("created_at"), F.col("key").cast("long").alias("updated_at"))
    return tables.upsert(rows.where("created_at % 2 = 0"), rows.where("created_at % 2 = 1"), ["root"])


@query(
    "upsert_files",
    """SELECT coalesce(n.path, o.path) AS path, coalesce(n.hash, o.hash) AS hash, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
    FROM old_files o FULL JOIN new_files n ON o.path = n.path""",
)
def upsert_files(d: Data) -> DataFrame:
    return tables.upsert(d.bound("old_files"), d.bound("new_files"), ["path"])


@query("remove_missing_files", "SELECT path, hash FROM old_files WHERE path IN (SELECT path FROM new_files)")
def remove_missing_files(d: Data) -> DataFrame:
    return tables.kept(d.bound("old_files"), d.bound("new_files"), "path").select("path", "hash")


@query("deleted_files", "SELECT path FROM old_files WHERE path NOT IN (SELECT path FROM new_files)")
def deleted_files(d: Data) -> DataFrame:
    return tables.deleted(d.bound("old_files"), d.bound("new_files"), "path").select("path")


DIFFERENCE = """SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old_files o FULL JOIN new_files n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash"""


@query("snapshot_diff", DIFFERENCE)
def snapshot_diff(d: Data) -> DataFrame:
    return tables.difference(d.bound("old_files"), d.bound("new_files"), "path", "hash")


@query("changed_files", f"SELECT path, change FROM ({DIFFERENCE}) WHERE change <> 'removed'")
def changed_files(d: Data) -> DataFrame:
    return snapshot_diff(d).where("change <> 'removed'")


@query(
    "explode_provenance",
    """SELECT id, CAST(coalesce(i, 0) AS INTEGER) AS idx, coalesce(source_file, '') AS source_file, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line
    FROM (SELECT id FROM nodes WHERE type IN ('method', 'file')) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY idx, source_file, start_line, end_line) - 1 AS i FROM spans) ON id = subject_id""",
)
def explode_provenance(d: Data) -> DataFrame:
    held = d.bound("spans").groupBy(F.col("subject_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "source_file", "start_line", "end_line"))).alias("spans"))
    return tables.exploded_spans(d.graph.nodes_of("method", "file").select("id").join(held, "id", "left"))


@query("ranking_ids", "SELECT id AS node_id, 'rank_' || substr(sha1('rank' || '::' || 'project' || '::' || id || '::' || 'degree'), 1, 16) AS id FROM nodes")
def ranking_ids(d: Data) -> DataFrame:
    return d.graph.nodes.select(F.col("id").alias("node_id"), stable_id("rank", F.lit("rank"), F.lit("project"), F.col("id"), F.lit("degree")).alias("id"))


@query("merge_partial_graph", "SELECT path, hash, 'new' AS version FROM new_files UNION ALL SELECT path, hash, 'old' FROM old_files WHERE path NOT IN (SELECT path FROM new_files) AND CAST(substr(path, 8) AS BIGINT) % 2 = 0")
def merge_partial_graph(d: Data) -> DataFrame:
    place = lambda df: df.select(F.col("path").alias("id"), F.col("path").alias("file_path"), "hash")
    odd = d.bound("old_files").select(F.col("path").alias("file_path")).where("cast(substr(file_path, 8) AS bigint) % 2 = 1")
    merged = tables.merged_partially(place(d.bound("old_files")).withColumn("version", F.lit("old")), place(d.bound("new_files")).withColumn("version", F.lit("new")), odd)
    return merged.select(F.col("id").alias("path"), "hash", "version")


# the graph's relations


@query("edges_referential", f"SELECT {EDGE} FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)")
def edges_referential(d: Data) -> DataFrame:
    return d.walked.referential()


@query("build_nodes", "SELECT type || '_' || substr(sha1(type || '::' || file_path || '::' || name), 1, 16) AS node_id, type, name FROM nodes WHERE type IN ('project', 'module', 'file')")
def build_nodes(d: Data) -> DataFrame:
    n = d.graph.nodes_of("project", "module", "file")
    made = [n.where(F.col("type") == t).select(stable_id(t, F.lit(t), F.col("file_path"), F.col("name")).alias("node_id"), "type", "name") for t in ("project", "module", "file")]
    return made[0].union(made[1]).union(made[2])


@query("edges_owns", "SELECT 'OWNS:' || p.id || ':' || f.id AS id, p.id AS from_id, f.id AS to_id FROM nodes p, nodes f WHERE p.type = 'project' AND f.type = 'file'".replace("nodes p, nodes f", "nodes p JOIN nodes f ON true"))
def edges_owns(d: Data) -> DataFrame:
    project, files = d.graph.nodes_of("project").select(F.col("id").alias("from_id")), d.graph.nodes_of("file").select(F.col("id").alias("to_id"))
    return files.crossJoin(project).select(F.concat_ws(":", F.lit("OWNS"), "from_id", "to_id").alias("id"), "from_id", "to_id")  # the project is one row


@query("edges_defines", "SELECT 'DEFINES:' || f.id || ':' || s.id AS id, f.id AS from_id, s.id AS to_id FROM symbols s JOIN files f ON s.file_path = f.path")
def edges_defines(d: Data) -> DataFrame:
    return _file_edges(d, "DEFINES", False)


@query("edges_exports", "SELECT 'EXPORTS:' || f.id || ':' || s.id AS id, f.id AS from_id, s.id AS to_id FROM symbols s JOIN files f ON s.file_path = f.path WHERE s.is_exported")
def edges_exports(d: Data) -> DataFrame:
    return _file_edges(d, "EXPORTS", True)


def _file_edges(d: Data, kind: str, exported: bool) -> DataFrame:
    s = d.bound("symbols").where("is_exported") if exported else d.bound("symbols")
    files = d.bound("files").select(F.col("path").alias("file_path"), F.col("id").alias("from_id"))
    return s.select("file_path", F.col("id").alias("to_id")).join(files, "file_path").select(F.concat_ws(":", F.lit(kind), "from_id", "to_id").alias("id"), "from_id", "to_id")


@query("edges_entry_point", "SELECT 'ENTRY_POINT:p:' || id AS id, 'p' AS from_id, id AS to_id FROM symbols WHERE name IN ('s1', 's2', 's3') AND owner = ''")
def edges_entry_point(d: Data) -> DataFrame:
    names = F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"))
    hit = d.bound("symbols").where(F.array_contains(names, F.col("name")) & (F.col("owner") == ""))
    return hit.select(F.concat(F.lit("ENTRY_POINT:p:"), "id").alias("id"), F.lit("p").alias("from_id"), F.col("id").alias("to_id"))


@query("remove_nodes_cascade", "SELECT type, CAST(count(*) AS BIGINT) AS n FROM edges WHERE from_id NOT IN (SELECT id FROM nodes WHERE summary = 'F') AND to_id NOT IN (SELECT id FROM nodes WHERE summary = 'F') GROUP BY 1")
def remove_nodes_cascade(d: Data) -> DataFrame:
    return by_type(d.graph.without_where(nodes=F.col("summary") == "F").edges)


@query("edges_by_type", f"SELECT {EDGE} FROM edges WHERE type = 'DEFINES'")
def edges_by_type(d: Data) -> DataFrame:
    return d.graph.edges_of("DEFINES")


@query("get_node", f"SELECT {NODE} FROM nodes WHERE id = 'c7'")
def get_node(d: Data) -> DataFrame:
    return d.graph.node("c7")


@query("outgoing_edges", f"SELECT {EDGE} FROM edges WHERE from_id = 'c7'")
def outgoing_edges(d: Data) -> DataFrame:
    return d.graph.outgoing("c7")


@query("incoming_edges", f"SELECT {EDGE} FROM edges WHERE to_id = 's3'")
def incoming_edges(d: Data) -> DataFrame:
    return d.graph.incoming("s3")


@query("filter_noise", "SELECT id, name FROM (SELECT id, CASE WHEN is_exported THEN 'env:' || name ELSE name END AS name, CASE WHEN summary = 'SMALL' THEN 'config:dotenv' ELSE full_name END AS full_name FROM nodes) WHERE NOT (starts_with(name, 'env:') OR starts_with(name, 'config:dotenv') OR starts_with(full_name, 'env:') OR starts_with(full_name, 'config:dotenv'))")
def filter_noise(d: Data) -> DataFrame:
    marked = d.graph.nodes.select("id", F.when(F.col("is_exported"), F.concat(F.lit("env:"), "name")).otherwise(F.col("name")).alias("name"), F.when(F.col("summary") == "SMALL", "config:dotenv").otherwise(F.col("full_name")).alias("full_name"))
    return marked.where(export.not_noise(F.col("name"), F.col("full_name"))).select("id", "name")


@query("strip_source_text", "SELECT subject_id, source_file, start_line, end_line FROM spans")
def strip_source_text(d: Data) -> DataFrame:
    held = d.bound("spans").select("subject_id", F.array(F.struct("source_file", "start_line", "end_line", "text")).alias("source"))
    return held.select("subject_id", F.explode(F.transform("source", lambda s: s.dropFields("text"))).alias("s")).select("subject_id", "s.*")


@query("canonical_name", "SELECT id, coalesce(nullif(CASE WHEN type = 'class' THEN '' END, ''), nullif(CASE WHEN is_exported THEN full_name ELSE '' END, ''), name) AS canonical FROM nodes")
def canonical_name(d: Data) -> DataFrame:
    semantic = F.when(F.col("type") == "class", "")
    return d.graph.nodes.select("id", export.canonical_name(semantic, F.when(F.col("is_exported"), F.col("full_name")).otherwise(""), F.col("name")).alias("canonical"))


@query("vscode_uri", "SELECT id, 'vscode://file/' || regexp_replace(file_path, '^/', '') || ':' || length(name) || ':1' AS uri FROM nodes")
def vscode_uri(d: Data) -> DataFrame:
    return d.graph.nodes.select("id", paths.editor_uri(F.col("file_path"), F.length("name"), F.lit(1)).alias("uri"))


@query("filter_active_types", "SELECT id, type FROM nodes WHERE type IN ('file', 'class')")
def filter_active_types(d: Data) -> DataFrame:
    active = d.spark.createDataFrame([("file",), ("class",)], "type string")
    return d.graph.nodes.join(active, "type", "left_semi").select("id", "type")


@query("neighbors", "SELECT id, type FROM nodes WHERE id = 's3' OR id IN (SELECT from_id FROM edges WHERE to_id = 's3' UNION SELECT to_id FROM edges WHERE from_id = 's3')")
def neighbors(d: Data) -> DataFrame:
    return d.graph.neighbours("s3").select("id", "type")


RELATIONS = """SELECT r.*, n.type AS other_type, n.name AS other_name FROM (SELECT 'outgoing' AS direction, id AS edge_id, type AS edge_type, to_id AS other_id FROM edges WHERE from_id = 'c7'
    UNION ALL SELECT 'incoming', id, type, from_id FROM edges WHERE to_id = 'c7') r LEFT JOIN nodes n ON n.id = other_id"""


@query("node_relations", RELATIONS)
def node_relations(d: Data) -> DataFrame:
    return d.graph.relations("c7")


@query("find_entry_points", f"SELECT {NODE} FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'ENTRY_POINT')")
def find_entry_points(d: Data) -> DataFrame:
    return d.graph.entry_points()


@query("file_symbols", f"SELECT {NODE} FROM nodes WHERE id IN (SELECT e.to_id FROM edges e JOIN nodes f ON e.from_id = f.id WHERE e.type = 'DEFINES' AND f.type = 'file' AND ends_with(f.full_name, '/NATION_4'))")
def file_symbols(d: Data) -> DataFrame:
    path = d.graph.nodes_of("file").where(F.col("full_name").endswith("/NATION_4")).select("full_name").first()["full_name"]
    return d.graph.file_symbols(path)


@query("induced_edges", f"SELECT {EDGE} FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE is_exported) AND to_id IN (SELECT id FROM nodes WHERE is_exported)")
def induced_edges(d: Data) -> DataFrame:
    return d.graph.induced(d.graph.nodes.where("is_exported"))


@query("two_hop", "SELECT DISTINCT a.to_id AS middle, b.to_id AS far FROM edges a JOIN edges b ON a.to_id = b.from_id WHERE a.from_id = 'c7'")
def two_hop(d: Data) -> DataFrame:
    return d.graph.two_hops("c7")


# counts


@query("stats_nodes_by_type", "SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def stats_nodes_by_type(d: Data) -> DataFrame:
    return by_type(d.graph.nodes)


@query("stats_edges_by_type", "SELECT type, count(*) AS n FROM edges GROUP BY 1")
def stats_edges_by_type(d: Data) -> DataFrame:
    return by_type(d.graph.edges)


@query("graph_stats", "SELECT 'node' AS part, coalesce(type, 'all') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', coalesce(type, 'all'), count(*) FROM edges GROUP BY ROLLUP (type)")
def graph_stats(d: Data) -> DataFrame:
    rolled = lambda df, part: df.rollup("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.coalesce("type", F.lit("all")).alias("type"), "n")
    return rolled(d.graph.nodes, "node").union(rolled(d.graph.edges, "edge"))


@query("stats_rollup", "SELECT coalesce(type, 'all') AS type, coalesce(CAST(resolved AS VARCHAR), 'all') AS resolved, count(*) AS n FROM edges GROUP BY GROUPING SETS ((type, resolved), (type), (resolved), ())")
def stats_rollup(d: Data) -> DataFrame:
    return d.graph.edges.cube("type", "resolved").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce(F.col("resolved").cast("string"), F.lit("all")).alias("resolved"), "n")


@query("symbol_count", "SELECT count(*) AS n FROM nodes WHERE type NOT IN ('file', 'project')")
def symbol_count(d: Data) -> DataFrame:
    return d.graph.nodes.agg(F.count_if(~F.col("type").isin("file", "project")).alias("n"))


DEGREES = "(SELECT id, i AS in_degree, o AS out_degree, i + o AS degree FROM (SELECT id, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM nodes LEFT JOIN (SELECT to_id, count(*) AS i FROM edges GROUP BY 1) a ON id = a.to_id LEFT JOIN (SELECT from_id, count(*) AS o FROM edges GROUP BY 1) b ON id = b.from_id))"


@query("degree", f"SELECT id, in_degree, out_degree, degree FROM {DEGREES}")
def degree(d: Data) -> DataFrame:
    return d.graph.degrees()


@query("relation_summary", f"SELECT direction, edge_type, count(*) AS n FROM ({RELATIONS}) GROUP BY 1, 2")
def relation_summary(d: Data) -> DataFrame:
    return d.graph.relations("c7").groupBy("direction", "edge_type").agg(F.count("*").alias("n"))


@query("graph_health", f"SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges WHERE NOT resolved) AS unresolved_count, (SELECT count(*) FROM {DEGREES} WHERE degree = 0) AS isolated_count")
def graph_health(d: Data) -> DataFrame:
    return d.graph.health()


@query("unresolved_count", "SELECT count(*) AS n FROM edges WHERE type = 'CALLS_UNRESOLVED' OR NOT resolved")
def unresolved_count(d: Data) -> DataFrame:
    return d.graph.unresolved().agg(F.count("*").alias("n"))


@query(
    "dir_communities",
    """WITH placed AS (SELECT id, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory FROM nodes),
    sizes AS (SELECT directory, count(*) AS size FROM placed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
    ranked AS (SELECT p.directory, size, id, row_number() OVER (PARTITION BY p.directory ORDER BY id) AS r FROM placed p JOIN sizes s ON p.directory = s.directory)
    SELECT directory, size, CAST((r - 1) // 10000 AS INTEGER) AS part, string_agg(id, ',' ORDER BY id) AS members FROM ranked GROUP BY 1, 2, 3""",
)
def dir_communities(d: Data) -> DataFrame:
    return d.graph.directory_groups(paths.dirname(F.col("file_path")))


@query(
    "file_summaries",
    """WITH f AS (SELECT id, name FROM nodes WHERE type = 'file' ORDER BY name, id LIMIT 20),
    c AS (SELECT from_id, count(*) FILTER (WHERE type = 'DEFINES') AS d, count(*) FILTER (WHERE type IN ('IMPORTS', 'DEPENDS_ON')) AS o FROM edges GROUP BY 1)
    SELECT id, name AS label, name || ' defines ' || coalesce(d, 0) || ' symbols and depends on ' || coalesce(o, 0) || ' modules/files.' AS summary FROM f LEFT JOIN c ON id = from_id""",
)
def file_summaries(d: Data) -> DataFrame:
    return export.file_summaries(d.graph)


@query(
    "symbol_summaries",
    f"""WITH s AS (SELECT id, type, name, full_name FROM nodes WHERE type IN ('class', 'function', 'method', 'route', 'config') ORDER BY type, name, id LIMIT 25)
    SELECT s.id, full_name AS label, type || ' ' || name || ' has ' || out_degree || ' outgoing and ' || in_degree || ' incoming relationships.' AS summary FROM s JOIN {DEGREES} g ON s.id = g.id""",
)
def symbol_summaries(d: Data) -> DataFrame:
    return export.symbol_summaries(d.graph)


@query("evidence_spans", "SELECT DISTINCT source_file, start_line, 1 AS start_col, end_line, 1 AS end_col FROM spans ORDER BY 1, 2, 3, 4, 5 LIMIT 100")
def evidence_spans(d: Data) -> DataFrame:
    return export.evidence(d.bound("spans"))


@query("project_counters", "SELECT (SELECT count(*) FROM nodes WHERE type = 'file') AS file_count, (SELECT count(*) FROM nodes WHERE type NOT IN ('file', 'project')) AS symbol_count, (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT n.name FROM nodes n JOIN edges e ON n.id = e.to_id AND e.type = 'ENTRY_POINT' GROUP BY n.id, n.name)) AS entry_points")
def project_counters(d: Data) -> DataFrame:
    counts = d.graph.nodes.agg(F.count_if(F.col("type") == "file").alias("file_count"), F.count_if(~F.col("type").isin("file", "project")).alias("symbol_count"))
    every = d.graph.entry_points().select("name")
    return counts.crossJoin(every.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("entry_points")))


@query("density", "SELECT node_count, pair_count, pair_count / (node_count::DOUBLE * (node_count - 1)) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT from_id, to_id FROM edges)) AS pair_count)")
def density(d: Data) -> DataFrame:
    from ..operators.analytics import density as measure

    return measure(d.graph.nodes, d.graph.edges)


# exports


@query("serialize_edges", "SELECT id, type, from_id, to_id, resolved, false AS inferred FROM edges")
def serialize_edges(d: Data) -> DataFrame:
    return export.serialised_edges(d.graph)


@query(
    "fingerprint",
    """WITH h AS (SELECT sha256('node|' || id || '|' || type || '|' || coalesce(nullif(full_name, ''), name) || '|' || file_path) AS h FROM nodes
      UNION ALL SELECT sha256('edge|' || id || '|' || type || '|' || from_id || '|' || to_id || '|' || resolved) FROM edges),
    r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
    SELECT sha256(string_agg(h, '' ORDER BY r, h)) AS fingerprint FROM r""",
)
def fingerprint(d: Data) -> DataFrame:
    return export.fingerprint(d.graph)


def _near(d: Data) -> PropertyGraph:
    """The files and what they depend on: a bundle is one document."""
    return PropertyGraph(d.graph.nodes_of("file"), d.graph.edges_of("DEPENDS_ON"))


@query("export_json")
def export_json(d: Data) -> DataFrame:
    document = export.bundle(_near(d), {"name": "project"}, {"type": "focus", "focus": "files"})
    return d.spark.createDataFrame([("json", export.to_json(document)), ("yaml", export.to_yaml(document))], "format string, document string")


@query("export_ai")
def export_ai(d: Data) -> DataFrame:
    document = export.ai_bundle(d.graph, {"name": "project"}, {"type": "overview"}, most_tokens=4000, most_nodes=200)
    return d.spark.createDataFrame([("ai", export.to_json(document))], "format string, document string")
