"""Semantic labels and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from .registry import Data, query

DIRS = "list_filter(string_split(regexp_replace(substr(path, 7), '/?[^/]*$', ''), '/'), lambda p: p <> '' AND p <> '.')"
STEM = "regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]*$', '\\1')"
UP = "lambda x: upper(substr(x, 1, 1)) || substr(x, 2)"


def _contains(column: str, table: list[tuple[str, str]], otherwise: str) -> str:
    """A CASE over words, the first that holds."""
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words.split()) + f" THEN '{label}'" for words, label in table) + f" ELSE {otherwise} END"


ROLE_WORDS = "service:service_layer,controller:controller_layer,handler:handler_layer,middleware:middleware_layer,route:routing_layer,api:api_layer,model entity:model_layer,database db:data_layer,util helper:utility_layer,config:configuration_layer,test:test_layer,type schema:type_layer,auth:authentication_layer"
MODULE_ROLE = _contains("lower(dotted)", [tuple(x.split(":")) for x in ROLE_WORDS.split(",")], "'application_layer'")  # type: ignore[misc]
CONTEXTS = "api:api_module,auth:authentication_module,core:core_module,common:shared_utilities_module,config:configuration_module,database:database_module,db:database_module,server:server_module,client:client_module,utils:utilities_module,helpers:helpers_module,middleware:middleware_module,routes:routing_module,services:services_module,models:models_module,types:types_module,tests:testing_module,e2e:end_to_end_testing_module,unit:unit_testing_module"
MODULE_CONTEXT = "CASE WHEN len(dirs) = 0 THEN 'root_module' " + " ".join(f"WHEN lower(dirs[1]) = '{k}' THEN '{v}'" for k, v in (x.split(":") for x in CONTEXTS.split(","))) + " ELSE lower(dirs[1]) || '_module' END"
BASE = f"WITH base AS (SELECT *, {DIRS} AS dirs, {STEM} AS stem FROM labelled), b AS (SELECT *, array_to_string(list_append(dirs, stem), '.') AS dotted FROM base)"


def _file(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", *[c.alias(n) for n, c in labels.file_labels(F.col("path"), "/repo").items()])


@query("semantic_file_paths", BASE + f" SELECT key, array_to_string(dirs, '.') AS namespace, dotted AS semantic_path, array_to_string(list_transform(list_append(dirs, stem), {UP}), ' > ') AS hierarchy_label FROM b")
def semantic_file_paths(d: Data) -> DataFrame:
    return _file(d).select("key", "namespace", "semantic_path", "hierarchy_label")


@query("module_role", BASE + f" SELECT key, {MODULE_ROLE} AS semantic_role FROM b")
def module_role(d: Data) -> DataFrame:
    return _file(d).select("key", "semantic_role")


@query("module_context", BASE + f" SELECT key, {MODULE_CONTEXT} AS module_context FROM b")
def module_context(d: Data) -> DataFrame:
    return _file(d).select("key", "module_context")


def _symbol(d: Data) -> DataFrame:
    found = labels.symbol_labels(F.col("path"), "/repo", F.col("type"), F.col("name"), F.col("summary"))
    return d.bound("labelled").select("key", *[c.alias(n) for n, c in found.items()])


@query("semantic_symbol_paths", BASE + f" SELECT key, dotted AS namespace, dotted || '.' || name AS semantic_path, array_to_string(list_transform(list_append(list_append(dirs, stem), name), {UP}), ' > ') AS hierarchy_label FROM b")
def semantic_symbol_paths(d: Data) -> DataFrame:
    return _symbol(d).select("key", "namespace", "semantic_path", "hierarchy_label")


CLASS = _contains("n", [(w, f"{w.split()[0]}_class") for w in ("service", "controller", "handler", "provider", "middleware", "repository", "factory", "model entity")], "'general_class'")
FUNCTION = """CASE WHEN n LIKE 'test%' OR n LIKE 'describe%' OR n LIKE '%spec%' THEN 'test_function' WHEN n LIKE 'get%' OR n LIKE 'fetch%' OR n LIKE 'query%' THEN 'query_function'
    WHEN n LIKE 'set%' OR n LIKE 'update%' OR n LIKE 'create%' OR n LIKE 'delete%' THEN 'mutation_function' WHEN n LIKE 'validate%' OR n LIKE '%check%' OR n LIKE '%verify%' THEN 'validation_function'
    WHEN n LIKE 'format%' OR n LIKE 'transform%' OR n LIKE 'parse%' THEN 'transformation_function' WHEN n LIKE 'handle%' OR n LIKE 'process%' THEN 'handler_function'
    WHEN n LIKE 'init%' OR n LIKE 'setup%' THEN 'initialization_function' WHEN n LIKE 'log%' OR n LIKE '%debug%' THEN 'logging_function' ELSE 'general_function' END"""


@query(
    "semantic_role",
    f"""SELECT key, CASE WHEN type = 'class' THEN {CLASS} WHEN type IN ('function', 'method') THEN {FUNCTION} WHEN type IN ('interface', 'type') THEN 'type_definition' WHEN type = 'enum' THEN 'enum_definition'
    WHEN type IN ('constant', 'variable') THEN {_contains("n", [("config", "configuration"), ("error", "error_definition"), ("default", "default_value")], "'data_definition'")}
    WHEN type = 'route' THEN {_contains("s", [(v, f"{v}_route") for v in ("get", "post", "put", "delete", "patch")], "'api_route'")} ELSE 'unknown' END AS semantic_role
    FROM (SELECT *, lower(name) AS n, lower(summary) AS s FROM labelled)""",
)
def semantic_role(d: Data) -> DataFrame:
    return _symbol(d).select("key", "semantic_role")


@query("classify_files", "SELECT key, CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' ELSE 'javascript' END AS language, regexp_matches(path, '(^|/)__tests__/|(\\.|-)(test|spec)\\.[jt]sx?$') AS is_test, regexp_matches(path, '(^|/)(.+\\.)?(config|settings)\\.[jt]sx?$') AS is_config, regexp_matches(path, '(^|/)(index|main|app|server|cli)\\.[jt]sx?$') AS is_entry FROM labelled")
def classify_files(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", *[c.alias(n) for n, c in labels.file_class(F.col("path")).items()])


@query("entry_point_names", "SELECT key, word IN ('main', 'handler', 'bootstrap', 'start', 'run', 'default') OR (key % 2 = 0 AND regexp_matches(path, '(^|/)(index|main|app|server|cli)\\.[jt]sx?$')) AS is_entry FROM (SELECT *, split_part('main,handler,bootstrap,start,run,default,other,Main', ',', CAST(key % 8 AS INT) + 1) AS word FROM labelled)")
def entry_point_names(d: Data) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x) for x in ("main", "handler", "bootstrap", "start", "run", "default", "other", "Main")]), (F.col("key") % 8 + 1).cast("int"))
    return d.bound("labelled").select("key", labels.is_entry_name(word, F.col("path"), F.col("key") % 2 == 0).alias("is_entry"))


TYPES = "IMPORTS,EXPORTS,CALLS,CALLS_UNRESOLVED,OWNS,DEFINES,USES,DEPENDS_ON,TESTS,DOCUMENTS,IMPLEMENTS,EXTENDS,DECORATES,REFERENCES,ENTRY_POINT,OTHER"
PAIRS = f"(SELECT a.key, split_part('{TYPES}', ',', CAST(a.key % 16 AS INT) + 1) AS kind, a.name AS f, b.name AS t, b.type AS tt, lower(a.name) AS fl, lower(b.name) AS tl FROM labelled a JOIN labelled b ON b.key = a.key * 7 % 199)"
REASON = "CASE WHEN contains(tl, 'validate') OR contains(tl, 'check') THEN 'to validate input' WHEN contains(tl, 'format') OR contains(tl, 'parse') OR contains(tl, 'transform') THEN 'to transform data' WHEN contains(tl, 'query') OR contains(tl, 'fetch') THEN 'to retrieve data' WHEN contains(tl, 'create') OR contains(tl, 'update') THEN 'to modify data' WHEN (contains(fl, 'handler') OR contains(fl, 'controller')) AND contains(tl, 'service') THEN 'to delegate business logic' ELSE 'for functionality' END"
PHRASES = "IMPORTS:imports from:module_dependency,EXPORTS:export from:export,DEFINES:defines:definition,IMPLEMENTS:implements interface:interface_implementation,EXTENDS:extends:inheritance,TESTS:tests:test_coverage,USES:uses:usage,DOCUMENTS:documents:documentation,REFERENCES:references:reference,OWNS:owns:ownership"
_phrases = [x.split(":") for x in PHRASES.split(",")]


def _pairs(d: Data) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in TYPES.split(",")])
    a = d.bound("labelled").select("key", F.element_at(kinds, (F.col("key") % 16 + 1).cast("int")).alias("kind"), F.col("name").alias("f"), (F.col("key") * 7 % 199).alias("other"))
    b = d.bound("labelled").select(F.col("key").alias("other"), F.col("name").alias("t"), F.col("type").alias("tt"))
    return a.join(b, "other")


@query("call_reason", f"SELECT key, {REASON} AS reason FROM {PAIRS}")
def call_reason(d: Data) -> DataFrame:
    return _pairs(d).select("key", labels.call_reason(F.col("f"), F.col("t")).alias("reason"))


@query(
    "edge_explanations",
    "SELECT key, CASE "
    + " ".join(f"WHEN kind = '{k}' THEN f || ' {w} ' || t" for k, w, _ in _phrases)
    + f" WHEN kind = 'CALLS' THEN f || ' calls ' || t || ' ' || {REASON} WHEN kind = 'CALLS_UNRESOLVED' THEN f || ' possibly calls ' || t || ' (unresolved)'"
    + " WHEN kind = 'DEPENDS_ON' THEN f || ' depends on ' || t || ' ' || CASE WHEN contains(tl, 'service') THEN '(service dependency)' WHEN tt = 'interface' THEN '(interface contract)' WHEN tt = 'config' THEN '(configuration)' ELSE '' END"
    + " WHEN kind = 'DECORATES' THEN '@' || f || ' decorator applied to ' || t WHEN kind = 'ENTRY_POINT' THEN t || ' is an entry point of ' || f END AS explanation, CASE "
    + " ".join(f"WHEN kind = '{k}' THEN '{r}'" for k, _, r in _phrases)
    + f" WHEN kind = 'CALLS' THEN {REASON} WHEN kind = 'CALLS_UNRESOLVED' THEN 'unresolved_call' WHEN kind = 'DEPENDS_ON' THEN 'dependency' WHEN kind = 'DECORATES' THEN 'decorator_application' WHEN kind = 'ENTRY_POINT' THEN 'entry_point' END AS relationship_reason,"
    + f" CASE kind WHEN 'CALLS' THEN 'direct_call' WHEN 'CALLS_UNRESOLVED' THEN 'unresolved' END AS call_pattern FROM {PAIRS}",
)
def edge_explanations(d: Data) -> DataFrame:
    found = labels.edge_labels(F.col("kind"), F.col("f"), F.col("t"), F.col("tt"))
    return _pairs(d).select("key", *[c.alias(n) for n, c in found.items()])


# scalar functions


@query("scalar_case", "SELECT key, lower(name) AS low, upper(name) AS up, upper(substr(name, 1, 1)) || substr(name, 2) AS first FROM labelled")
def scalar_case(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.lower("name").alias("low"), F.upper("name").alias("up"), paths.capitalised(F.col("name")).alias("first"))


@query("scalar_search", "SELECT key, contains(name, 'er') AS holds, starts_with(name, 'get') AS begins, ends_with(path, '.ts') AS ends FROM labelled")
def scalar_search(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.col("name").contains("er").alias("holds"), F.col("name").startswith("get").alias("begins"), F.col("path").endswith(".ts").alias("ends"))


@query("scalar_slice", "SELECT key, substr(name, 2, 3) AS part, replace(path, '/', '\\') AS swapped, trim('  ' || name || ' ') AS trimmed FROM labelled")
def scalar_slice(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.substring("name", 2, 3).alias("part"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")).alias("swapped"), F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("trimmed"))


@query("scalar_split", "SELECT key, array_to_string(string_split(path, '/'), '.') AS joined, string_split(path, '.')[-1] AS last FROM labelled")
def scalar_split(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.array_join(F.split("path", "/"), ".").alias("joined"), F.substring_index("path", ".", -1).alias("last"))


@query("scalar_path", f"SELECT key, substr(path, 7) AS rel, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '^.*/', '') AS base, regexp_extract(regexp_replace(path, '^.*/', ''), '^.+(\\.[^.]*)$', 1) AS ext, {STEM} AS stem FROM labelled")
def scalar_path(d: Data) -> DataFrame:
    p = F.col("path")
    return d.bound("labelled").select("key", paths.relative(p, "/repo").alias("rel"), paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.extname(p).alias("ext"), paths.stem(p).alias("stem"))


@query("relative_label", "SELECT key, array_to_string(string_split(path, '/')[-4:], '/') AS label FROM labelled")
def relative_label(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", paths.last_parts(F.col("path")).alias("label"))


@query("scalar_regex", "SELECT key, regexp_matches(path, '(\\.|-)(test|spec)\\.[jt]sx?$') AS test FROM labelled")
def scalar_regex(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.col("path").rlike("(\\.|-)(test|spec)\\.[jt]sx?$").alias("test"))


@query("scalar_hash", "SELECT key, substr(sha1(name), 1, 16) AS short, sha256(path) AS long FROM labelled")
def scalar_hash(d: Data) -> DataFrame:
    return d.bound("labelled").select("key", F.substring(F.sha1("name"), 1, 16).alias("short"), F.sha2("path", 256).alias("long"))


@query("scalar_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS document FROM events")
def scalar_json(d: Data) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return d.table("events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("document"))


@query("scalar_math", "SELECT event_id, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high, least(value, 5.0::DOUBLE) AS lesser, greatest(value, 5.0::DOUBLE) AS greater, sqrt(abs(value)) AS root FROM events")
def scalar_math(d: Data) -> DataFrame:
    v = F.col("value")
    return d.table("events").select("event_id", F.floor(v).alias("low"), F.ceil(v).alias("high"), F.least(v, F.lit(5.0)).alias("lesser"), F.greatest(v, F.lit(5.0)).alias("greater"), F.sqrt(F.abs(v)).alias("root"))


@query("scalar_null", "SELECT id, coalesce(nullif(summary, ''), name) AS truthy, coalesce(CASE WHEN type = 'class' THEN summary END, 'none') AS present FROM nodes")
def scalar_null(d: Data) -> DataFrame:
    return d.graph.nodes.select("id", F.coalesce(F.nullif("summary", F.lit("")), "name").alias("truthy"), F.coalesce(F.when(F.col("type") == "class", F.col("summary")), F.lit("none")).alias("present"))


@query("scalar_array", "SELECT key, array_to_string(list_transform(parts, lambda x: upper(x)), '-') AS mapped, len(list_filter(parts, lambda x: length(x) > 4)) AS kept, len(list_filter(parts, lambda x: x = 'api')) > 0 AS some, CAST(list_sum(list_transform(parts, lambda x: length(x))) AS BIGINT) AS total, len(list_distinct(parts)) AS different FROM (SELECT key, string_split(path, '/') AS parts FROM labelled)")
def scalar_array(d: Data) -> DataFrame:
    p = F.split("path", "/")
    return d.bound("labelled").select(
        "key",
        F.array_join(F.transform(p, F.upper), "-").alias("mapped"),
        F.size(F.filter(p, lambda x: F.length(x) > 4)).cast("long").alias("kept"),
        F.exists(p, lambda x: x == "api").alias("some"),
        F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("total"),
        F.size(F.array_distinct(p)).cast("long").alias("different"),
    )


@query("scalar_map", "SELECT key, 'name=' || name || ',type=' || type AS entries FROM labelled")
def scalar_map(d: Data) -> DataFrame:
    made = F.map_from_entries(F.array(F.struct(F.lit("type").alias("key"), F.col("type").alias("value")), F.struct(F.lit("name").alias("key"), F.col("name").alias("value"))))
    return d.bound("labelled").select("key", F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"))


@query("scalar_epoch_ms", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events")
def scalar_epoch_ms(d: Data) -> DataFrame:
    return d.table("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
