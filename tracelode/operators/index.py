"""From source files to one graph: scanned files are parsed, names are resolved, and nodes, edges and provenance come out.

Every step is a join or an aggregate over the relations of all files together; only parsing looks at a file at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.labels import TEST_FILE
from ..sources import parser
from ..sources.store import Store
from . import resolve
from .components import checkpointed

#: Fixed values. Confidence of what was read from a source, and of what was guessed from a name.
READ, GUESSED = 1.0, 0.7
EDGE = ["id", "type", "from_id", "to_id", "resolved"]


@dataclass(frozen=True)
class Index:
    """``nodes``, ``edges`` and ``provenance`` with the columns of the store's tables, and ``errors`` (path, error) of files that can't be read."""

    nodes: DataFrame
    edges: DataFrame
    provenance: DataFrame
    errors: DataFrame


def _place() -> Column:
    """Where a record stands; places are in order of path, line and column."""
    return F.struct("path", "line", "col", "kind", "name", "detail")


def _file_id(path: Column) -> Column:
    return stable_id("file", path)


def _edges(df: DataFrame, kind: Column | str, start: str, end: str, resolved: bool = True) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.concat_ws(":", kind, start, end).alias("id"), kind.alias("type"), F.col(start).alias("from_id"), F.col(end).alias("to_id"), F.lit(resolved).alias("resolved"))


def index(files: DataFrame, project: str, root: str, aliases: DataFrame | None = None, time: int = 0) -> Index:
    """The graph of ``files`` (path, content), whose paths are below ``root``.

    A file that can't be parsed has a node and no symbols; an empty one likewise. Of equal records in a file the first counts.
    Names that nothing matches give modules and unresolved edges, so every edge's ends are nodes. Equal ids are one node or edge.
    """
    spark = files.sparkSession
    if aliases is None:
        aliases = spark.createDataFrame([], "prefix string, suffix string, target string, priority int")
    # many sources come from a small file, whose one task would parse them all
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = checkpointed(parser.parse(files.select("path", "content").repartition(tasks, "path")).withColumn("ord", _place()))
    known = files.select("path", _file_id(F.col("path")).alias("id")).distinct()
    of = lambda record: rows.where(F.col("record") == record)
    test = F.col("path").rlike(TEST_FILE)

    # symbols
    symbol_id = stable_id("symbol", F.col("path"), F.col("kind"), F.col("owner"), F.col("name"), F.col("line"), F.col("col"))
    listed = of("symbol").select("*", symbol_id.alias("id"), F.col("path").alias("file_path"), F.col("kind").alias("type"), F.col("exported").alias("is_exported"))
    symbols = checkpointed(listed.dropDuplicates(["id"]))
    owned = F.when(F.col("owner") != "", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
    named = symbols.select("id", "type", "name", F.concat("file_path", F.lit("#"), owned).alias("full_name"), "file_path", F.when(F.col("type") == "doc", F.col("detail")).otherwise("").alias("summary"), "is_exported", F.col("line").alias("start_line"), "end_line", F.col("col").alias("start_col"), "end_col")

    # imports, exports and calls as the resolvers take them
    imports = of("import").select(F.col("path").alias("file_path"), _file_id(F.col("path")).alias("file_id"), test.alias("is_test"), "ord", "line", F.col("owner").alias("module"), F.col("name").alias("imported"), F.col("detail").alias("local"))
    exports = of("export").select(F.col("path").alias("file_path"), F.col("name").alias("exported"), F.col("detail").alias("local"), "ord", F.col("owner").alias("module"))
    targets = known.select("path", "id")
    found = checkpointed(resolve.resolve_imports(imports, targets, aliases, root))
    bound = resolve.import_aliases(found, exports, symbols)
    places = resolve.local_symbols(symbols).select("file_path", F.col("owner").alias("owner"), F.col("name").alias("caller"), F.col("id").alias("caller_id"))
    caller = of("call").select(F.col("path").alias("file_path"), test.alias("is_test"), "line", "ord", "name", F.col("detail").alias("full_name"), F.col("owner").alias("by"))
    caller = caller.withColumn("owner", F.when(F.col("by").contains("."), F.substring_index("by", ".", 1)).otherwise("")).withColumn("caller", F.substring_index("by", ".", -1))
    calls = caller.join(resolve.by_shuffle(places), ["file_path", "owner", "caller"], "left").withColumn("from_id", F.coalesce("caller_id", _file_id(F.col("file_path"))))
    called = checkpointed(resolve.resolve_calls(calls.select("from_id", "file_path", "is_test", "line", "ord", "name", "full_name", "owner"), symbols, bound))

    # nodes
    project_id = F.lit(f"project:{project}")
    blank = [F.lit("").alias("summary"), F.lit(True).alias("is_exported")]
    top = spark.range(1).select(project_id.alias("id"), F.lit("project").alias("type"), F.lit(project).alias("name"), F.lit(root).alias("full_name"), F.lit(root).alias("file_path"), *blank)
    listed_files = known.select("id", F.lit("file").alias("type"), F.regexp_replace("path", "^\\Q" + root.rstrip("/") + "\\E/", "").alias("name"), F.col("path").alias("full_name"), F.col("path").alias("file_path"), *blank)
    again = resolve.resolve_imports(exports.where("module <> ''").select("*", _file_id(F.col("file_path")).alias("file_id")), targets, aliases, root)
    modules = found.where("target_path IS NULL").select("target_id", "module").union(again.where("target_path IS NULL").select("target_id", "module"))
    modules = modules.select(F.col("target_id").alias("id"), F.lit("module").alias("type"), F.col("module").alias("name"), F.col("module").alias("full_name"), F.lit("").alias("file_path"), *blank)
    missing = resolve.unresolved_nodes(called).select("id", "type", "name", F.col("name").alias("full_name"), F.lit("").alias("file_path"), *blank)
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [named, top, listed_files, modules, missing]).dropDuplicates(["id"])

    # edges
    files_of = symbols.select(_file_id(F.col("file_path")).alias("file_id"), "id", "is_exported", "owner")
    entries = of("entry").select(F.col("path").alias("file_path"), F.when(F.col("kind") == "route", F.col("name")).otherwise(F.col("name")).alias("ref"))
    entered = resolve.lookup_local(entries, symbols, "ref", "found").select(project_id.alias("project_id"), F.coalesce("found", _file_id(F.col("file_path"))).alias("id"))
    classes = symbols.where("type = 'class'").select("id", "file_path", F.explode(F.split("detail", "; ")).alias("part"))
    after = lambda word: classes.where(F.col("part").startswith(word)).select("id", "file_path", F.expr(f"substring(part, {len(word) + 1})").alias("ref"))
    docs = symbols.where("type = 'doc'").select("id", "file_path", resolve.last_part(F.regexp_replace("name", "^doc:", "")).alias("ref"))
    routes = symbols.where("type = 'route' AND detail <> ''").select("id", "file_path", F.col("detail").alias("ref"))
    kind = F.when(F.col("is_test"), F.lit("TESTS")).otherwise(F.lit("IMPORTS"))
    parts = [
        _edges(known.select(project_id.alias("project_id"), "id"), "OWNS", "project_id", "id"),
        _edges(files_of, "DEFINES", "file_id", "id"),
        _edges(files_of.where("is_exported AND owner = ''"), "EXPORTS", "file_id", "id"),
        resolve.member_edges(symbols),
        _edges(entered, "ENTRY_POINT", "project_id", "id"),
        resolve.import_edges(found),
        resolve.depends_on_edges(found),
        _edges(resolve.imported_symbols(found, exports, symbols), kind, "file_id", "symbol_id"),
        _edges(again.where("target_path IS NOT NULL"), "EXPORTS", "file_id", "target_id"),
        _edges(again.where("target_path IS NULL"), "EXPORTS", "file_id", "target_id", False),
        resolve.reference_edges(after("extends "), symbols, bound, "EXTENDS"),
        resolve.reference_edges(after("implements "), symbols, bound, "IMPLEMENTS"),
        resolve.reference_edges(after("@"), symbols, bound, "DECORATES", reverse=True),
        resolve.reference_edges(docs, symbols, bound, "DOCUMENTS"),
        resolve.reference_edges(routes, symbols, bound, "USES"),
        resolve.call_edges(called),
        resolve.unresolved_edges(called),
    ]
    edges = reduce(lambda a, b: a.unionByName(b), [p.select(*EDGE) for p in parts]).dropDuplicates(["id"])

    # provenance
    stamp = [F.lit("parser").alias("type"), F.lit(time).cast("long").alias("created_at"), F.lit(time).cast("long").alias("updated_at")]
    here = [F.lit(0).alias("idx"), F.col("file_path").alias("source_file"), F.col("line").alias("start_line"), "end_line", F.col("col").alias("start_col"), "end_col", "text"]
    spans = symbols.select(F.col("id").alias("subject_id"), F.lit("node").alias("subject"), *here, F.lit(READ).alias("confidence"), *stamp)
    lines = called.select(F.concat_ws(":", F.when(F.col("is_test"), "TESTS").otherwise("CALLS"), "from_id", "target_id", "line").alias("hit"), F.concat_ws(":", F.lit("CALLS_UNRESOLVED"), "from_id", F.concat(F.lit("unresolved:"), "full_name"), "line").alias("miss"), "target_id", "file_path", "line")
    of_calls = lines.select(F.when(F.col("target_id").isNotNull(), F.col("hit")).otherwise(F.col("miss")).alias("subject_id"), F.lit("edge").alias("subject"), F.lit(0).alias("idx"), F.col("file_path").alias("source_file"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.when(F.col("target_id").isNotNull(), READ).otherwise(GUESSED).alias("confidence"), *stamp).distinct()
    provenance = spans.unionByName(of_calls, allowMissingColumns=True)
    return Index(nodes, edges, provenance, of("error").select("path", "error"))


def rebuild(store: Store, files: DataFrame, root: str, aliases: DataFrame | None = None, time: int = 0) -> Index:
    """Indexes ``files`` (path, content, hash, size) anew and stores it all: the graph in one swap, then what is counted of it."""
    built = index(files, store.project, root, aliases, time)
    store.replace_graph(built.nodes, built.edges, built.provenance)
    nodes, edges = store.read("nodes"), store.read("edges")
    stamp = [F.lit(time).cast("long").alias("created_at"), F.lit(time).cast("long").alias("updated_at")]
    counts = nodes.agg(F.count_if(F.col("type") == "file").alias("file_count"), F.count_if(~F.col("type").isin("file", "project")).alias("symbol_count"), F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    counts = counts.select("*", F.lit(store.project).alias("id"), F.lit(store.project).alias("name"), F.lit(root).alias("root"), F.lit("typescript").alias("language"), *stamp)
    store.upsert("projects", counts)
    store.upsert("index_state", counts)
    store.commit({"files": files.select("path", F.lit("typescript").alias("language"), "hash", "size", *stamp)})
    return built


def update(store: Store, files: DataFrame, root: str, aliases: DataFrame | None = None, time: int = 0) -> DataFrame:
    """(path, change) against the stored files; where anything changed the project is indexed again, as a whole."""
    from .tables import difference

    changes = checkpointed(difference(store.read("files"), files, "path", "hash"))
    if not changes.isEmpty():
        rebuild(store, files, root, aliases, time)
    return changes
