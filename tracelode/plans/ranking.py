"""Sorts, top-k, importance, centrality and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import rounded
from ..operators import analytics, budget, export
from ..operators.components import stored, weak_components
from ..operators.graph import PropertyGraph, export_rank
from ..operators.traverse import ranked
from .registry import Data, query
from .relations import DEGREES

_RAW = "(coalesce(i, 0) * 1.5::DOUBLE + coalesce(o, 0)) / greatest(1.0::DOUBLE, (SELECT count(*) FROM nodes) * 0.1::DOUBLE)"
_BONUS = "(CASE WHEN n.type IN ('project', 'file', 'class', 'function', 'method', 'route') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN e.id IS NOT NULL THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END)"
IMPORTANCE = f"""(SELECT n.id, n.type, n.name, n.full_name, least(1.0::DOUBLE, floor(({_RAW} + {_BONUS}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE) AS importance
    FROM nodes n LEFT JOIN (SELECT to_id, CAST(count(*) AS DOUBLE) AS i FROM edges GROUP BY 1) a ON n.id = a.to_id LEFT JOIN (SELECT from_id, CAST(count(*) AS DOUBLE) AS o FROM edges GROUP BY 1) b ON n.id = b.from_id
    LEFT JOIN (SELECT DISTINCT to_id AS id FROM edges WHERE type = 'ENTRY_POINT') e ON e.id = n.id)"""
CENTRALITY = f"(SELECT id, degree, floor(degree::DOUBLE / (SELECT greatest(1, max(degree)) FROM {DEGREES})::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS centrality FROM {DEGREES})"
SERVER = f"(SELECT n.id, n.type, n.name, floor((in_degree * 1.4::DOUBLE + out_degree + CASE WHEN type = 'project' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) / (SELECT greatest(1.0::DOUBLE, max(degree) * 1.4::DOUBLE) FROM {DEGREES}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS importance FROM nodes n JOIN {DEGREES} g ON n.id = g.id)"
ORDER = "CASE type WHEN 'file' THEN 1 WHEN 'class' THEN 2 WHEN 'function' THEN 3 WHEN 'method' THEN 4 WHEN 'route' THEN 5 WHEN 'interface' THEN 6 WHEN 'type' THEN 7 WHEN 'constant' THEN 8 WHEN 'variable' THEN 9 WHEN 'config' THEN 10 ELSE 100 END"


@query("ranking_scan", f"SELECT id AS node_id, importance AS score FROM {SERVER} ORDER BY score DESC, node_id")
def ranking_scan(d: Data) -> DataFrame:
    return d.graph.server_importance().select(F.col("id").alias("node_id"), F.col("importance").alias("score")).orderBy(F.desc("score"), "node_id")


@query("sorted_nodes", "SELECT id, type, name, row_number() OVER (ORDER BY type, name, id) AS rank FROM nodes WHERE type IN ('file', 'class') ORDER BY rank")
def sorted_nodes(d: Data) -> DataFrame:
    return ranked(d.graph.nodes_of("file", "class").select("id", "type", "name"), F.col("type"), F.col("name"), F.col("id")).withColumn("rank", F.col("rank").cast("long"))


@query("ai_sorted_nodes", f"SELECT id, importance FROM {IMPORTANCE} ORDER BY importance DESC, type, name, id LIMIT 500")
def ai_sorted_nodes(d: Data) -> DataFrame:
    return export.ai_nodes(d.graph, 500).select("id", "importance")


@query("ai_sorted_edges", "SELECT id, type, resolved FROM edges ORDER BY resolved DESC, type, id LIMIT 500")
def ai_sorted_edges(d: Data) -> DataFrame:
    return d.graph.edges.orderBy(F.desc("resolved"), "type", "id").limit(500).select("id", "type", "resolved")


@query("rank_nodes_for_export", f"SELECT n.id, n.type, n.name FROM nodes n JOIN {CENTRALITY} c ON n.id = c.id ORDER BY CASE WHEN type IN ('file', 'class', 'function') THEN 0 ELSE 1 END, centrality DESC, {ORDER}, name, n.id LIMIT 200")
def rank_nodes_for_export(d: Data) -> DataFrame:
    scored = d.graph.nodes.join(d.graph.degree_centrality(), "id")
    focus = F.when(F.col("type").isin("file", "class", "function"), 0).otherwise(1)
    return scored.orderBy(focus, F.desc("centrality"), export_rank(F.col("type")), "name", "id").limit(200).select("id", "type", "name")


@query("top_nodes", f"SELECT id, importance FROM {IMPORTANCE} ORDER BY importance DESC, id LIMIT 40")
def top_nodes(d: Data) -> DataFrame:
    return d.graph.importance().orderBy(F.desc("importance"), "id").limit(40)


@query("ranking_top50", f"SELECT id AS node_id, importance AS score, 'degree_importance' AS algorithm FROM {IMPORTANCE} ORDER BY importance DESC, id LIMIT 50")
def ranking_top50(d: Data) -> DataFrame:
    return d.graph.importance().orderBy(F.desc("importance"), "id").limit(50).select(F.col("id").alias("node_id"), F.col("importance").alias("score"), F.lit("degree_importance").alias("algorithm"))


@query("hubs", f"SELECT s.id, s.type, s.name, degree, in_degree, out_degree, importance FROM {SERVER} s JOIN {DEGREES} g ON s.id = g.id ORDER BY degree DESC, s.name, s.id LIMIT 25")
def hubs(d: Data) -> DataFrame:
    g = stored(d.graph.with_degrees().select("id", "type", "name", "in_degree", "out_degree", "degree"))
    most = g.agg(F.greatest(F.lit(1.0), F.max("degree") * F.lit(1.4)).alias("most"))
    top = g.orderBy(F.desc("degree"), "name", "id").limit(25)
    raw = F.col("in_degree") * 1.4 + F.col("out_degree") + F.when(F.col("type") == "project", 2.0).otherwise(0.0)
    return top.crossJoin(most).select("id", "type", "name", "degree", "in_degree", "out_degree", rounded(raw / F.col("most"), 6).alias("importance"))


@query("core_modules", f"SELECT id, importance FROM {IMPORTANCE} WHERE type IN ('file', 'module') ORDER BY importance DESC, name, id LIMIT 12")
def core_modules(d: Data) -> DataFrame:
    return export.core_modules(d.graph).select("id", "importance")


@query("key_symbols", f"SELECT id, full_name, importance FROM {IMPORTANCE} WHERE type NOT IN ('project', 'file', 'module') ORDER BY importance DESC, name, id LIMIT 20")
def key_symbols(d: Data) -> DataFrame:
    return export.key_symbols(d.graph).select("id", "full_name", "importance")


@query("rank_centrality", f"SELECT id, centrality FROM {CENTRALITY} ORDER BY centrality DESC, id LIMIT 50")
def rank_centrality(d: Data) -> DataFrame:
    return d.graph.degree_centrality().orderBy(F.desc("centrality"), "id").limit(50).select("id", "centrality")


@query("hub_nodes_py", f"SELECT id, in_degree FROM {DEGREES} ORDER BY in_degree DESC, id LIMIT 20")
def hub_nodes_py(d: Data) -> DataFrame:
    return d.graph.degrees().orderBy(F.desc("in_degree"), "id").limit(20).select("id", "in_degree")


@query("entry_points_py", f"SELECT n.id, out_degree FROM nodes n JOIN {DEGREES} g ON n.id = g.id WHERE is_exported AND out_degree > 0 ORDER BY out_degree DESC, n.id")
def entry_points_py(d: Data) -> DataFrame:
    return d.graph.nodes.where("is_exported").select("id").join(d.graph.degrees(), "id").where("out_degree > 0").select("id", "out_degree").orderBy(F.desc("out_degree"), "id")


@query(
    "top_relations",
    """SELECT direction, edge_id FROM (SELECT direction, edge_id, row_number() OVER (PARTITION BY direction ORDER BY edge_id) AS r FROM
    (SELECT 'outgoing' AS direction, id AS edge_id FROM edges WHERE from_id = 'c7' UNION ALL SELECT 'incoming', id FROM edges WHERE to_id = 'c7')) WHERE r <= 10""",
)
def top_relations(d: Data) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("edge_id"))
    return d.graph.relations("c7").withColumn("r", rank).where("r <= 10").select("direction", "edge_id")


@query("leaf_nodes", "SELECT id, type FROM nodes WHERE id NOT IN (SELECT from_id FROM edges)")
def leaf_nodes(d: Data) -> DataFrame:
    return d.graph.nodes.join(d.graph.edges.select(F.col("from_id").alias("id")).distinct(), "id", "left_anti").select("id", "type")


@query("nodes_with_rank", f"SELECT n.id, n.name, t.score, coalesce(t.score, 0.0::DOUBLE) AS shown FROM nodes n LEFT JOIN (SELECT id, importance AS score FROM {SERVER} ORDER BY 2 DESC, 1 LIMIT 50) t ON n.id = t.id")
def nodes_with_rank(d: Data) -> DataFrame:
    top = d.graph.server_importance().select("id", F.col("importance").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return d.graph.nodes.join(top, "id", "left").select("id", "name", "score", F.coalesce("score", F.lit(0.0)).alias("shown"))


@query("api_graph_nodes", f"SELECT n.id, n.type, n.name, degree, in_degree, out_degree, importance, 'vscode://file/' || regexp_replace(file_path, '^/', '') || ':1:1' AS uri FROM nodes n JOIN {DEGREES} g ON n.id = g.id JOIN {SERVER} s ON n.id = s.id")
def api_graph_nodes(d: Data) -> DataFrame:
    g = stored(d.graph.with_degrees().select("id", "type", "name", "file_path", "in_degree", "out_degree", "degree"))
    most = g.agg(F.greatest(F.lit(1.0), F.max("degree") * F.lit(1.4)).alias("most"))
    raw = F.col("in_degree") * 1.4 + F.col("out_degree") + F.when(F.col("type") == "project", 2.0).otherwise(0.0)
    return g.crossJoin(most).select("id", "type", "name", "degree", "in_degree", "out_degree", rounded(raw / F.col("most"), 6).alias("importance"), paths.editor_uri(F.col("file_path"), F.lit(1), F.lit(1)).alias("uri"))


@query(
    "node_size",
    f"""SELECT id, floor(greatest(3.5::DOUBLE, least(18.0::DOUBLE, 4.0::DOUBLE + sqrt(CASE WHEN degree = 0 THEN 1 ELSE degree END::DOUBLE) * 1.6::DOUBLE + least(10.0::DOUBLE, centrality * 14.0::DOUBLE))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS size,
    floor(greatest(5.0::DOUBLE, least(15.0::DOUBLE, 5.0::DOUBLE + degree * 0.3::DOUBLE)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS radius FROM {CENTRALITY}""",
)
def node_size(d: Data) -> DataFrame:
    g = d.graph.degree_centrality()
    root = F.sqrt(F.when(F.col("degree") == 0, 1).otherwise(F.col("degree")).cast("double"))
    size = F.greatest(F.lit(3.5), F.least(F.lit(18.0), F.lit(4.0) + root * 1.6 + F.least(F.lit(10.0), F.col("centrality") * 14.0)))
    radius = F.greatest(F.lit(5.0), F.least(F.lit(15.0), F.lit(5.0) + F.col("degree") * F.lit(0.3)))
    return g.select("id", rounded(size, 4).alias("size"), rounded(radius, 4).alias("radius"))


# measures


@query("importance", f"SELECT id, importance FROM {IMPORTANCE}")
def importance(d: Data) -> DataFrame:
    return d.graph.importance()


@query("degree_centrality", f"SELECT id, degree, centrality FROM {CENTRALITY}")
def degree_centrality(d: Data) -> DataFrame:
    return d.graph.degree_centrality()


@query("server_importance", f"SELECT id, importance FROM {SERVER}")
def server_importance(d: Data) -> DataFrame:
    return d.graph.server_importance()


@query("nx_degree_centrality", "SELECT id, floor(coalesce(d, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1)::DOUBLE * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE AS centrality FROM nodes LEFT JOIN (SELECT u, count(*) AS d FROM (SELECT u FROM (SELECT DISTINCT from_id AS u, to_id AS v FROM edges) UNION ALL SELECT v FROM (SELECT DISTINCT from_id AS u, to_id AS v FROM edges)) GROUP BY 1) ON id = u")
def nx_degree_centrality(d: Data) -> DataFrame:
    return analytics.degree_share(d.graph.nodes, d.graph.edges)


@query(
    "rank_combined",
    f"""WITH c AS (SELECT id, centrality AS s FROM {CENTRALITY} WHERE degree > 3), i AS (SELECT id, importance AS s FROM {IMPORTANCE})
    SELECT coalesce(c.id, i.id) AS id, floor((coalesce(c.s, 0.0::DOUBLE) / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1.0::DOUBLE END FROM c) * 0.5::DOUBLE + coalesce(i.s, 0.0::DOUBLE) / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1.0::DOUBLE END FROM i) * 0.5::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score
    FROM c FULL JOIN i ON c.id = i.id ORDER BY score DESC, id LIMIT 50""",
)
def rank_combined(d: Data) -> DataFrame:
    c = d.graph.degree_centrality().where("degree > 3").select("id", F.col("centrality").alias("score"))
    return analytics.combined(c, d.graph.importance().withColumnRenamed("importance", "score"))


def _pagerank_sql(rounds: int) -> str:
    steps = ["WITH p AS MATERIALIZED (SELECT DISTINCT from_id AS u, to_id AS v FROM edges), o AS (SELECT u, count(*) AS out FROM p GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, n)".replace("FROM nodes, n", "FROM nodes CROSS JOIN n")]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0.0::DOUBLE) + (SELECT coalesce(sum(rank), 0.0::DOUBLE) FROM r{k} WHERE id NOT IN (SELECT u FROM o)) / n) AS rank FROM nodes CROSS JOIN n LEFT JOIN (SELECT v, sum(rank / out) AS got FROM p JOIN o ON p.u = o.u JOIN r{k} ON r{k}.id = p.u GROUP BY 1) ON id = v)"
        )
    return ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(20))
def pagerank(d: Data) -> DataFrame:
    return analytics.pagerank(d.graph.nodes, d.graph.edges).select("id", F.round("rank", 9).alias("rank"))


def _betweenness_sql(hops: int) -> str:
    """Shortest-path counts as walk counts of the least length, up to ``hops``."""
    steps = ["WITH w1 AS MATERIALIZED (SELECT from_id AS s, to_id AS t, 1.0::DOUBLE AS c FROM trade)"]
    for k in range(2, hops + 1):
        steps.append(f"w{k} AS MATERIALIZED (SELECT w.s, e.t, sum(w.c) AS c FROM w{k - 1} w JOIN w1 e ON w.t = e.s GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT s, t, {k} AS d, c FROM w{k}" for k in range(1, hops + 1))
    steps.append(f"a AS MATERIALIZED (SELECT s, t, min(d) AS d, arg_min(c, d) AS c FROM ({union}) WHERE s <> t GROUP BY 1, 2)")
    return ", ".join(steps) + " SELECT id, round(coalesce(b, 0.0::DOUBLE) / (24.0::DOUBLE * 23.0::DOUBLE), 9) AS betweenness FROM nodes LEFT JOIN (SELECT x.t AS v, sum(x.c * y.c / z.c) AS b FROM a x JOIN a y ON x.t = y.s AND x.s <> y.t JOIN a z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY 1) ON id = v WHERE type = 'file'"


@query("betweenness", _betweenness_sql(8))
def betweenness(d: Data) -> DataFrame:
    return analytics.betweenness(d.trade.nodes, d.trade.edges).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("communities")
def communities(d: Data) -> DataFrame:
    return analytics.communities(d.trade.nodes.select("id"), d.trade.edges)


@query("wcc_count", "WITH RECURSIVE g AS MATERIALIZED (SELECT from_id AS u, to_id AS v FROM edges UNION SELECT to_id, from_id FROM edges), c(id, m) USING KEY (id) AS (SELECT id, id AS m FROM nodes UNION SELECT g.v, min(c.m) FROM c JOIN g ON c.id = g.u JOIN recurring.c t ON t.id = g.v WHERE c.m < t.m GROUP BY 1), e AS MATERIALIZED (SELECT from_id AS u, to_id AS v FROM trade UNION SELECT to_id, from_id FROM trade), r AS (SELECT id AS s, id AS t FROM nodes WHERE type = 'file' UNION SELECT r.s, e.v FROM r JOIN e ON r.t = e.u) SELECT count(DISTINCT m) AS trade_count, (SELECT count(DISTINCT m) FROM c) AS full_count FROM (SELECT s, min(t) AS m FROM r GROUP BY 1)")
def wcc_count(d: Data) -> DataFrame:
    count = lambda g, name: weak_components(g.nodes, g.edges).agg(F.count_distinct("component").alias(name))
    return count(d.trade, "trade_count").crossJoin(count(d.graph, "full_count"))


@query("scc_count", "WITH RECURSIVE r AS (SELECT from_id AS s, to_id AS t FROM trade UNION SELECT r.s, e.to_id FROM r JOIN trade e ON r.t = e.from_id) SELECT n.id, least(n.id, coalesce(m, n.id)) AS component FROM (SELECT id FROM nodes WHERE type = 'file') n LEFT JOIN (SELECT a.s, min(a.t) AS m FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1) ON n.id = s")
def scc_count(d: Data) -> DataFrame:
    return analytics.strong_components(d.trade.nodes, d.trade.edges)


# budgets


@query("node_tokens", "SELECT id, CAST(ceil((length(name) + length(full_name) + length(summary) + 2) * 0.25::DOUBLE) AS BIGINT) AS tokens FROM nodes")
def node_tokens(d: Data) -> DataFrame:
    return d.graph.nodes.select("id", budget.node_tokens(F.col("name"), F.col("full_name"), F.col("summary"), F.lit("{}")).alias("tokens"))


@query("edge_tokens", "SELECT subject_id, idx, CAST(ceil(50.0::DOUBLE + 2 * 0.25::DOUBLE + length(source_file) + length(text) * 0.25::DOUBLE) AS BIGINT) AS tokens FROM spans")
def edge_tokens(d: Data) -> DataFrame:
    held = F.array(F.struct("source_file", "text"))
    return d.bound("spans").select("subject_id", "idx", budget.edge_tokens(F.lit("{}"), held).alias("tokens"))


@query(
    "prune_token_budget",
    f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT id, CAST(ceil((length(name) + length(full_name) + length(summary) + 2) * 0.25::DOUBLE) AS BIGINT) AS tokens,
      row_number() OVER (ORDER BY CASE WHEN type IN ('file', 'class', 'function') THEN 0 ELSE 1 END, {ORDER}, name, id) AS r FROM nodes),
    walk AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, false AS taken, '' AS id UNION ALL
      SELECT k.r, CASE WHEN w.used + k.tokens <= 4480 THEN w.used + k.tokens ELSE w.used END, w.used + k.tokens <= 4480, k.id FROM walk w JOIN ranked k ON k.r = w.r + 1 WHERE w.used + (SELECT min(tokens) FROM ranked) <= 4480),
    kept AS (SELECT id FROM walk WHERE taken),
    inner_edges AS (SELECT id, 51 * row_number() OVER (ORDER BY id) AS upto FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept))
    SELECT 'node' AS part, id FROM kept UNION ALL SELECT 'edge', id FROM inner_edges WHERE upto <= 1920""",
)
def prune_token_budget(d: Data) -> DataFrame:
    g = export.pruned(d.graph, 8000)
    return g.nodes.select(F.lit("node").alias("part"), "id").union(g.edges.select(F.lit("edge"), "id"))


AI_NODES = f"(SELECT id FROM {IMPORTANCE} ORDER BY importance DESC, type, name, id LIMIT 300)"


@query("ai_query_result", f"SELECT id, type FROM edges WHERE (type <> 'ENTRY_POINT' AND from_id IN (SELECT id FROM {AI_NODES}) AND to_id IN (SELECT id FROM {AI_NODES})) OR (type = 'ENTRY_POINT' AND to_id IN (SELECT id FROM {AI_NODES}))")
def ai_query_result(d: Data) -> DataFrame:
    return export.ai_result(d.graph, 300).edges.select("id", "type")


@query(
    "ai_summary",
    f"""SELECT 'entry' AS part, full_name AS value, 0.0::DOUBLE AS importance FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'ENTRY_POINT')
    UNION ALL (SELECT 'core', full_name, importance FROM {IMPORTANCE} WHERE type IN ('file', 'module') ORDER BY importance DESC, name, id LIMIT 12)
    UNION ALL (SELECT 'key', full_name, importance FROM {IMPORTANCE} WHERE type NOT IN ('project', 'file', 'module') ORDER BY importance DESC, name, id LIMIT 20)
    UNION ALL SELECT 'unresolved', CAST(count(*) AS VARCHAR), 0.0::DOUBLE FROM edges WHERE type = 'CALLS_UNRESOLVED' OR NOT resolved""",
)
def ai_summary(d: Data) -> DataFrame:
    g, zero = d.graph, F.lit(0.0).alias("importance")
    part = lambda name, value: [F.lit(name).alias("part"), value.alias("value")]
    entries = g.entry_points().select(*part("entry", F.col("full_name")), zero)
    core = export.core_modules(g).select(*part("core", F.col("full_name")), "importance")
    key = export.key_symbols(g).select(*part("key", F.col("full_name")), "importance")
    count = g.unresolved().agg(F.count("*").cast("string").alias("n")).select(*part("unresolved", F.col("n")), zero)
    return entries.union(core).union(key).union(count)


@query("serialize_nodes", f"SELECT i.id, i.type, i.full_name AS canonical_name, importance, coalesce(nullif(summary, ''), 'unknown') AS summary, false AS inferred FROM {IMPORTANCE} i JOIN nodes n ON n.id = i.id")
def serialize_nodes(d: Data) -> DataFrame:
    return export.serialised_nodes(d.graph)
