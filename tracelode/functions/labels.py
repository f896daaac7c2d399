"""Semantic labels of nodes and edges as column expressions. Rules are ordered: the first that holds counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import capitalised, directories, relative, stem

#: Fixed values. (label, words of which a directory or file name contains one), in order.
MODULE_ROLES = [
    ("service_layer", ["service"]),
    ("controller_layer", ["controller"]),
    ("handler_layer", ["handler"]),
    ("middleware_layer", ["middleware"]),
    ("routing_layer", ["route"]),
    ("api_layer", ["api"]),
    ("model_layer", ["model", "entity"]),
    ("data_layer", ["database", "db"]),
    ("utility_layer", ["util", "helper"]),
    ("configuration_layer", ["config"]),
    ("test_layer", ["test"]),
    ("type_layer", ["type", "schema"]),
    ("authentication_layer", ["auth"]),
]
#: Fixed values. Top-level directory and the module it stands for.
MODULE_CONTEXTS = {
    "api": "api_module",
    "auth": "authentication_module",
    "core": "core_module",
    "common": "shared_utilities_module",
    "config": "configuration_module",
    "database": "database_module",
    "db": "database_module",
    "server": "server_module",
    "client": "client_module",
    "utils": "utilities_module",
    "helpers": "helpers_module",
    "middleware": "middleware_module",
    "routes": "routing_module",
    "services": "services_module",
    "models": "models_module",
    "types": "types_module",
    "tests": "testing_module",
    "e2e": "end_to_end_testing_module",
    "unit": "unit_testing_module",
}
#: Fixed values. (label, words a class name contains).
CLASS_ROLES = [
    ("service_class", ["service"]),
    ("controller_class", ["controller"]),
    ("handler_class", ["handler"]),
    ("provider_class", ["provider"]),
    ("middleware_class", ["middleware"]),
    ("repository_class", ["repository"]),
    ("factory_class", ["factory"]),
    ("model_class", ["model", "entity"]),
]
#: Fixed values. (label, beginnings of a function's name, words it contains).
FUNCTION_ROLES = [
    ("test_function", ["test", "describe"], ["spec"]),
    ("query_function", ["get", "fetch", "query"], []),
    ("mutation_function", ["set", "update", "create", "delete"], []),
    ("validation_function", ["validate"], ["check", "verify"]),
    ("transformation_function", ["format", "transform", "parse"], []),
    ("handler_function", ["handle", "process"], []),
    ("initialization_function", ["init", "setup"], []),
    ("logging_function", ["log"], ["debug"]),
]
#: Fixed values. (label, words the name of a constant or variable contains).
DATA_ROLES = [("configuration", ["config"]), ("error_definition", ["error"]), ("default_value", ["default"])]
#: Fixed values. Verbs looked for in a route's summary, in order.
ROUTE_VERBS = ["get", "post", "put", "delete", "patch"]
#: Fixed values. (reason, words the called name contains).
CALL_REASONS = [
    ("to validate input", ["validate", "check"]),
    ("to transform data", ["format", "parse", "transform"]),
    ("to retrieve data", ["query", "fetch"]),
    ("to modify data", ["create", "update"]),
]
#: Fixed values. (edge type, words between the two names, reason).
EDGE_PHRASES = [
    ("IMPORTS", "imports from", "module_dependency"),
    ("EXPORTS", "export from", "export"),
    ("DEFINES", "defines", "definition"),
    ("IMPLEMENTS", "implements interface", "interface_implementation"),
    ("EXTENDS", "extends", "inheritance"),
    ("TESTS", "tests", "test_coverage"),
    ("USES", "uses", "usage"),
    ("DOCUMENTS", "documents", "documentation"),
    ("REFERENCES", "references", "reference"),
    ("OWNS", "owns", "ownership"),
]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    (test, value), *rest = rules
    return reduce(lambda case, rule: case.when(*rule), rest, F.when(test, value)).otherwise(otherwise)


def _containing(text: Column, table: list[tuple[str, list[str]]]) -> list[tuple[Column, Column]]:
    return [(_any([text.contains(w) for w in words]), F.lit(label)) for label, words in table]


def module_role(dotted: Column) -> Column:
    """The layer of a file from its directories and name, joined by dots."""
    return _first(_containing(F.lower(dotted), MODULE_ROLES), F.lit("application_layer"))


def module_context(dirs: Column) -> Column:
    """The module that a file's top-level directory stands for."""
    top = F.lower(F.get(dirs, F.lit(0)))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in MODULE_CONTEXTS.items() for x in kv]), top)
    return F.when(F.size(dirs) == 0, "root_module").otherwise(F.coalesce(known, F.concat(top, F.lit("_module"))))


def symbol_role(kind: Column, name: Column, summary: Column) -> Column:
    """A symbol's role from its type and the patterns of its name."""
    low, said = F.lower(name), F.lower(F.coalesce(summary, F.lit("")))
    function = [(_any([low.startswith(w) for w in starts] + [low.contains(w) for w in words]), F.lit(label)) for label, starts, words in FUNCTION_ROLES]
    route = [(said.contains(v), F.lit(v + "_route")) for v in ROUTE_VERBS]
    return _first(
        [
            (kind == "class", _first(_containing(low, CLASS_ROLES), F.lit("general_class"))),
            (kind.isin("function", "method"), _first(function, F.lit("general_function"))),
            (kind.isin("interface", "type"), F.lit("type_definition")),
            (kind == "enum", F.lit("enum_definition")),
            (kind.isin("constant", "variable"), _first(_containing(low, DATA_ROLES), F.lit("data_definition"))),
            (kind == "route", _first(route, F.lit("api_route"))),
        ],
        F.lit("unknown"),
    )


def file_labels(path: Column, root: str) -> dict[str, Column]:
    """namespace, semantic_path, hierarchy_label, semantic_role, module_context of a file."""
    dirs, name = directories(relative(path, root)), stem(path)
    namespace = F.array_join(dirs, ".")
    dotted = F.array_join(F.array_append(dirs, name), ".")
    return {
        "namespace": namespace,
        "semantic_path": dotted,
        "hierarchy_label": F.array_join(F.transform(F.array_append(dirs, name), capitalised), " > "),
        "semantic_role": module_role(dotted),
        "module_context": module_context(dirs),
    }


def symbol_labels(path: Column, root: str, kind: Column, name: Column, summary: Column) -> dict[str, Column]:
    """The same five columns for a symbol of a file."""
    dirs = directories(relative(path, root))
    parts = F.array_append(dirs, stem(path))
    return {
        "namespace": F.array_join(parts, "."),
        "semantic_path": F.concat(F.array_join(parts, "."), F.lit("."), name),
        "hierarchy_label": F.array_join(F.transform(F.array_append(parts, name), capitalised), " > "),
        "semantic_role": symbol_role(kind, name, summary),
        "module_context": module_context(dirs),
    }


def call_reason(from_name: Column, to_name: Column) -> Column:
    """Why one function calls another, by their names."""
    source, target = F.lower(from_name), F.lower(to_name)
    delegating = (source.contains("handler") | source.contains("controller")) & target.contains("service")
    return _first([*_containing(target, CALL_REASONS), (delegating, F.lit("to delegate business logic"))], F.lit("for functionality"))


def dependency_reason(to_type: Column, to_name: Column) -> Column:
    return _first(
        [(F.lower(to_name).contains("service"), F.lit("(service dependency)")), (to_type == "interface", F.lit("(interface contract)")), (to_type == "config", F.lit("(configuration)"))],
        F.lit(""),
    )


def edge_labels(kind: Column, from_name: Column, to_name: Column, to_type: Column) -> dict[str, Column]:
    """explanation, relationship_reason, call_pattern of an edge; null for an unknown type."""
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    none = F.lit(None).cast("string")
    reason = call_reason(from_name, to_name)
    explanation = [(kind == t, said(from_name, f" {words} ", to_name)) for t, words, _ in EDGE_PHRASES] + [
        (kind == "CALLS", said(from_name, " calls ", to_name, " ", reason)),
        (kind == "CALLS_UNRESOLVED", said(from_name, " possibly calls ", to_name, " (unresolved)")),
        (kind == "DEPENDS_ON", said(from_name, " depends on ", to_name, " ", dependency_reason(to_type, to_name))),
        (kind == "DECORATES", said("@", from_name, " decorator applied to ", to_name)),
        (kind == "ENTRY_POINT", said(to_name, " is an entry point of ", from_name)),
    ]
    why = [(kind == t, F.lit(r)) for t, _, r in EDGE_PHRASES] + [
        (kind == "CALLS", reason),
        (kind == "CALLS_UNRESOLVED", F.lit("unresolved_call")),
        (kind == "DEPENDS_ON", F.lit("dependency")),
        (kind == "DECORATES", F.lit("decorator_application")),
        (kind == "ENTRY_POINT", F.lit("entry_point")),
    ]
    pattern = [(kind == "CALLS", F.lit("direct_call")), (kind == "CALLS_UNRESOLVED", F.lit("unresolved"))]
    return {"explanation": _first(explanation, none), "relationship_reason": _first(why, none), "call_pattern": _first(pattern, none)}


#: Fixed values. Patterns of test, configuration and entry-point files, and names of entry points.
TEST_FILE = "(^|/)__tests__/|(\\.|-)(test|spec)\\.[jt]sx?$"
CONFIG_FILE = "(^|/)(.+\\.)?(config|settings)\\.[jt]sx?$"
ENTRY_FILE = "(^|/)(index|main|app|server|cli)\\.[jt]sx?$"
ENTRY_NAMES = ["main", "handler", "bootstrap", "start", "run", "default"]


def file_class(path: Column) -> dict[str, Column]:
    """language, is_test, is_config, is_entry of a source file."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return {
        "language": F.when(path.rlike("\\.tsx?$"), "typescript").otherwise("javascript"),
        "is_test": path.rlike(TEST_FILE),
        "is_config": path.rlike(CONFIG_FILE),
        "is_entry": path.rlike(ENTRY_FILE),
    }


def is_entry_name(name: Column, path: Column, exported: Column) -> Column:
    return name.isin(*ENTRY_NAMES) | (exported & path.rlike(ENTRY_FILE))


def parameter_flow(caller: Column, callee: Column, parameters: Column) -> Column:
    """What a call's parameters say: from the caller to the callee; null for a call without any."""
    flow = F.struct(F.array(caller).alias("from"), F.array(callee).alias("to"), F.lit("parameter_passing").alias("type"))
    return F.when(F.size(F.coalesce(parameters, F.array())) > 0, flow)
