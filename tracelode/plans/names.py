"""Resolution of names over the relations of parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve
from .registry import Data, query

EDGE = "id, type, from_id, to_id, resolved"
LOCAL = "loc AS MATERIALIZED (SELECT file_path, owner, name, arg_max(id, ord) AS id, min(ord) AS first FROM symbols GROUP BY 1, 2, 3), everywhere AS MATERIALIZED (SELECT name, arg_min(id, first) AS id FROM loc GROUP BY 1)"
ENDS = ", ".join(f"('{e}', {k})" for k, e in enumerate([".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"], 2))
BASES = """base AS MATERIALIZED (
      SELECT ord, regexp_replace(file_path, '/[^/]*$', '') || substr(module, 2) AS base, 0 AS priority FROM imports WHERE starts_with(module, './')
      UNION ALL SELECT ord, regexp_replace(regexp_replace(file_path, '/[^/]*$', ''), '/[^/]*$', '') || substr(module, 3) AS base, 0 FROM imports WHERE starts_with(module, '../')
      UNION ALL SELECT ord, replace(target, '*', substr(module, length(prefix) + 1, length(module) - length(prefix) - length(suffix))), priority FROM imports JOIN aliases ON starts_with(module, prefix) AND ends_with(module, suffix)
      UNION ALL SELECT ord, '/repo/' || module, 1000000 FROM imports WHERE NOT starts_with(module, '.') UNION ALL SELECT ord, '/repo/src/' || module, 1000001 FROM imports WHERE NOT starts_with(module, '.'))"""
TRIED = BASES + f""", cut AS (SELECT *, regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', '') AS bare FROM base),
    tried AS MATERIALIZED (SELECT ord, priority, base, base AS candidate, 0 AS trial FROM cut UNION ALL SELECT ord, priority, base, bare, 1 FROM cut UNION ALL SELECT ord, priority, base, bare || e, k FROM cut JOIN (VALUES {ENDS}) v(e, k) ON true)"""
TARGETS = TRIED + """, hit AS (SELECT t.ord, t.candidate, f.id, row_number() OVER (PARTITION BY t.ord ORDER BY t.priority, t.trial, t.candidate) AS r FROM tried t JOIN files f ON f.path = t.candidate),
    res AS MATERIALIZED (SELECT i.*, h.candidate AS target_path, coalesce(h.id, 'module:' || i.module) AS target_id, h.id IS NULL AND NOT starts_with(i.module, '.') AND NOT starts_with(i.module, '/') AS external FROM imports i LEFT JOIN hit h ON i.ord = h.ord AND h.r = 1)"""
BOUND = (
    TARGETS
    + ", "
    + LOCAL
    + """, ex AS (SELECT file_path, exported, CASE WHEN local <> '' THEN local ELSE exported END AS meant, row_number() OVER (PARTITION BY file_path, exported ORDER BY ord) AS r FROM exports),
    bound AS MATERIALIZED (SELECT res.*, loc.id AS symbol_id FROM res JOIN ex ON ex.file_path = res.target_path AND ex.exported = res.imported AND ex.r = 1 JOIN loc ON loc.file_path = res.target_path AND loc.owner = '' AND loc.name = ex.meant),
    al AS MATERIALIZED (SELECT file_path, local, arg_max(symbol_id, ord) AS id FROM bound GROUP BY 1, 2)"""
)
CALLED = (
    BOUND
    + """, parts AS (SELECT *, string_split(full_name, '.')[1] AS first_part, string_split(full_name, '.')[-1] AS last_part FROM calls),
    done AS MATERIALIZED (SELECT p.*, coalesce(al.id, l1.id, l2.id, l3.id, l4.id, g1.id, g2.id) AS target_id FROM parts p
      LEFT JOIN al ON al.file_path = p.file_path AND al.local = p.first_part
      LEFT JOIN loc l1 ON p.owner <> '' AND l1.file_path = p.file_path AND l1.owner = p.owner AND l1.name = p.name LEFT JOIN loc l2 ON l2.file_path = p.file_path AND l2.owner = '' AND l2.name = p.name
      LEFT JOIN loc l3 ON p.owner <> '' AND l3.file_path = p.file_path AND l3.owner = p.owner AND l3.name = p.last_part LEFT JOIN loc l4 ON l4.file_path = p.file_path AND l4.owner = '' AND l4.name = p.last_part
      LEFT JOIN everywhere g1 ON g1.name = p.name LEFT JOIN everywhere g2 ON g2.name = p.last_part)"""
)
MISSES = """SELECT DISTINCT 'CALLS_UNRESOLVED:' || from_id || ':unresolved:' || full_name || ':' || line AS id, 'CALLS_UNRESOLVED' AS type, from_id, 'unresolved:' || full_name AS to_id, false AS resolved FROM done WHERE target_id IS NULL"""


def _imports(d: Data) -> DataFrame:
    return resolve.resolve_imports(d.bound("imports"), d.bound("files"), d.bound("aliases"), "/repo")


def _aliases(d: Data) -> DataFrame:
    return resolve.import_aliases(_imports(d), d.bound("exports"), d.bound("symbols"))


def _calls(d: Data) -> DataFrame:
    return resolve.resolve_calls(d.bound("calls"), d.bound("symbols"), _aliases(d))


@query("is_external", "SELECT ord, module, NOT starts_with(module, '.') AND NOT starts_with(module, '/') AS external FROM imports")
def is_external(d: Data) -> DataFrame:
    return d.bound("imports").select("ord", "module", resolve.is_external(F.col("module")).alias("external"))


@query("resolve_module_path", "WITH " + BASES + " SELECT ord, base, priority FROM base")
def resolve_module_path(d: Data) -> DataFrame:
    return resolve.module_bases(d.bound("imports"), d.bound("aliases"), "/repo").select("ord", "base", "priority")


@query("resolve_candidates", "WITH " + TRIED + " SELECT t.ord, t.priority, CAST(t.trial AS INTEGER) AS trial, t.candidate FROM tried t JOIN files f ON f.path = t.candidate")
def resolve_candidates(d: Data) -> DataFrame:
    tried = resolve.candidates(resolve.module_bases(d.bound("imports"), d.bound("aliases"), "/repo"))
    return tried.join(d.bound("files").select(F.col("path").alias("candidate")), "candidate", "left_semi").select("ord", "priority", "trial", "candidate")


@query("resolve_imports", "WITH " + TARGETS + " SELECT ord, module, target_path, target_id, external FROM res")
def resolve_imports(d: Data) -> DataFrame:
    return _imports(d).select("ord", "module", "target_path", "target_id", "external")


@query("edges_imports", "WITH " + TARGETS + " SELECT DISTINCT CASE WHEN is_test THEN 'TESTS' ELSE 'IMPORTS' END || ':' || file_id || ':' || target_id || ':' || line AS id, CASE WHEN is_test THEN 'TESTS' ELSE 'IMPORTS' END AS type, file_id AS from_id, target_id AS to_id, target_path IS NOT NULL AS resolved FROM res")
def edges_imports(d: Data) -> DataFrame:
    return resolve.import_edges(_imports(d))


@query("edges_depends_on", "WITH " + TARGETS + " SELECT 'DEPENDS_ON:' || file_id || ':' || target_id AS id, 'DEPENDS_ON' AS type, file_id AS from_id, target_id AS to_id, true AS resolved, max(ord) AS ord FROM res WHERE target_path IS NOT NULL GROUP BY file_id, target_id")
def edges_depends_on(d: Data) -> DataFrame:
    return resolve.depends_on_edges(_imports(d))


@query("edges_import_symbol", "WITH " + BOUND + " SELECT ord, file_id AS from_id, symbol_id AS to_id FROM bound")
def edges_import_symbol(d: Data) -> DataFrame:
    return resolve.imported_symbols(_imports(d), d.bound("exports"), d.bound("symbols")).select("ord", F.col("file_id").alias("from_id"), F.col("symbol_id").alias("to_id"))


@query("edges_reexport", "SELECT e.ord, f.id AS from_id, t.id AS to_id, t.id IS NOT NULL AS resolved FROM exports e JOIN files f ON e.file_path = f.path LEFT JOIN files t ON t.region = f.region AND t.name = substr(e.module, 3) AND NOT ends_with(f.path, '/index.ts') WHERE e.module <> ''")
def edges_reexport(d: Data) -> DataFrame:
    again = d.bound("exports").where("module <> ''").select("file_path", "module", "ord")
    target = resolve.resolve_imports(again, d.bound("files"), d.bound("aliases"), "/repo")
    source = d.bound("files").select(F.col("path").alias("file_path"), F.col("id").alias("from_id"))
    known = F.when(F.col("target_path").isNotNull(), F.col("target_id"))
    return target.join(source, "file_path").select("ord", "from_id", known.alias("to_id"), F.col("target_path").isNotNull().alias("resolved"))


@query("edges_owns_member", "WITH m AS (SELECT s.id AS to_id, arg_max(o.id, o.ord) AS from_id FROM symbols s JOIN symbols o ON s.file_path = o.file_path AND s.owner = o.name AND o.owner = '' AND s.owner <> '' AND o.ord < s.ord GROUP BY 1) SELECT 'OWNS:' || from_id || ':' || to_id AS id, 'OWNS' AS type, from_id, to_id, true AS resolved FROM m")
def edges_owns_member(d: Data) -> DataFrame:
    return resolve.member_edges(d.bound("symbols"))


@query("join_local_symbol", "WITH " + LOCAL + " SELECT c.ord, coalesce(a.id, b.id) AS found FROM calls c LEFT JOIN loc a ON c.owner <> '' AND a.file_path = c.file_path AND a.owner = c.owner AND a.name = c.name LEFT JOIN loc b ON b.file_path = c.file_path AND b.owner = '' AND b.name = c.name")
def join_local_symbol(d: Data) -> DataFrame:
    return resolve.lookup_local(d.bound("calls"), d.bound("symbols"), "name", "found", "owner").select("ord", "found")


@query(
    "join_suffix",
    """WITH loc AS (SELECT file_path, owner, name, arg_max(id, ord) AS id, min(ord) AS first FROM symbols GROUP BY 1, 2, 3), keys AS (SELECT id, first, file_path || '::' || CASE WHEN owner <> '' THEN owner || '::' ELSE '' END || name AS k FROM loc),
    wanted AS (SELECT DISTINCT name AS w FROM calls UNION SELECT DISTINCT owner || '::' || name FROM calls WHERE owner <> '')
    SELECT w AS wanted, arg_min(id, first) AS id FROM wanted JOIN keys ON ends_with(k, '::' || w) GROUP BY 1""",
)
def join_suffix(d: Data) -> DataFrame:
    calls = d.bound("calls")
    names = calls.select(F.col("name").alias("wanted")).union(calls.where("owner <> ''").select(F.concat_ws("::", "owner", "name")))
    return resolve.global_by_suffix(d.bound("symbols"), names)


@query("edges_calls", "WITH " + CALLED + f" SELECT {EDGE} FROM (SELECT DISTINCT k || ':' || from_id || ':' || target_id || ':' || line AS id, k AS type, from_id, target_id AS to_id, true AS resolved FROM (SELECT *, CASE WHEN is_test THEN 'TESTS' ELSE 'CALLS' END AS k FROM done WHERE target_id IS NOT NULL))")
def edges_calls(d: Data) -> DataFrame:
    return resolve.call_edges(_calls(d))


@query("edges_calls_unresolved", "WITH " + CALLED + " " + MISSES)
def edges_calls_unresolved(d: Data) -> DataFrame:
    return resolve.unresolved_edges(_calls(d))


@query("nodes_unresolved", "WITH " + CALLED + " SELECT DISTINCT 'unresolved:' || full_name AS id, 'module' AS type, full_name AS name FROM done WHERE target_id IS NULL")
def nodes_unresolved(d: Data) -> DataFrame:
    return resolve.unresolved_nodes(_calls(d))


def _cascade_sql(source: str, kind: str, a: str = "s.id", b: str = "hit") -> str:
    hit = f"SELECT s.*, coalesce(al.id, l.id, g.id) AS hit FROM ({source}) s LEFT JOIN al ON al.file_path = s.file_path AND al.local = s.ref LEFT JOIN loc l ON l.file_path = s.file_path AND l.owner = '' AND l.name = s.ref LEFT JOIN everywhere g ON g.name = s.ref"
    return "WITH " + BOUND + f" SELECT DISTINCT '{kind}:' || {a} || ':' || {b} AS id, '{kind}' AS type, {a} AS from_id, {b} AS to_id, true AS resolved FROM ({hit}) s WHERE hit IS NOT NULL"


def _cascade(d: Data, source: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
    return resolve.reference_edges(source.select("id", "file_path", "ref"), d.bound("symbols"), _aliases(d), kind, reverse)


EXTENDS, IMPLEMENTS = "SELECT id, file_path, ref FROM symbols WHERE type = 'class'", "SELECT id, file_path, unnest(string_split(refs, ',')) AS ref FROM symbols WHERE type = 'class'"


@query("edges_inherit", _cascade_sql(EXTENDS, "EXTENDS") + " UNION ALL " + f"SELECT * FROM ({_cascade_sql(IMPLEMENTS, 'IMPLEMENTS').split(' SELECT DISTINCT ', 1)[1].join(['SELECT DISTINCT ', ''])})")
def edges_inherit(d: Data) -> DataFrame:
    classes = d.bound("symbols").where("type = 'class'")
    parts = classes.select("id", "file_path", F.explode(F.split("refs", ",")).alias("ref"))
    return _cascade(d, classes, "EXTENDS").union(_cascade(d, parts, "IMPLEMENTS"))


@query("edges_decorates", _cascade_sql("SELECT id, file_path, ref FROM symbols WHERE type = 'class'", "DECORATES", "hit", "s.id"))
def edges_decorates(d: Data) -> DataFrame:
    return _cascade(d, d.bound("symbols").where("type = 'class'"), "DECORATES", reverse=True)


@query("edges_documents", _cascade_sql("SELECT id, file_path, string_split('Owner.' || ref, '.')[-1] AS ref FROM symbols WHERE type = 'doc'", "DOCUMENTS"))
def edges_documents(d: Data) -> DataFrame:
    docs = d.bound("symbols").where("type = 'doc'").withColumn("ref", resolve.last_part(F.concat(F.lit("Owner."), "ref")))
    return _cascade(d, docs, "DOCUMENTS")


@query("edges_uses", _cascade_sql("SELECT id, file_path, ref FROM symbols WHERE type = 'route'", "USES"))
def edges_uses(d: Data) -> DataFrame:
    return _cascade(d, d.bound("symbols").where("type = 'route'"), "USES")
