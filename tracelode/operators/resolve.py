"""Resolution of names to symbols and files: cascades of equi-joins, the first that matches counts.

Lookups that a builder makes in hash maps are joins here, all of a step at once. Lookup sides are reduced to one row
per key first (the last written, or the first met), so no join multiplies rows. A plan has some forty of these joins and all their sides
grow with the files, so both sides meet by shuffle: broadcasts of what is just small enough would add up in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, extname, normalise

#: Fixed values. Endings tried in turn when an import names no file, after the path itself and without a runtime extension.
RUNTIME_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs"]
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that isn't broadcast, however small it turns out to be."""
    return df.hint("merge")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def local_symbols(symbols: DataFrame) -> DataFrame:
    """(file_path, owner, name, id): the last written of each place."""
    return symbols.groupBy("file_path", "owner", "name").agg(F.max_by("id", "ord").alias("id"))


def global_symbols(symbols: DataFrame) -> DataFrame:
    """(name, id): of all places whose key ends in the name, the first met, and what was last written there.

    A key is file::owner::name, so its last segment is the name and the search for an ending is an equality.
    """
    places = symbols.groupBy("file_path", "owner", "name").agg(F.min("ord").alias("first"), F.max_by("id", "ord").alias("id"))
    return places.groupBy("name").agg(F.min_by("id", "first").alias("id"))


def global_by_suffix(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, id) for wanted names that may hold ``::`` themselves: all endings of a key are listed, then joined."""
    places = symbols.groupBy("file_path", "owner", "name").agg(F.min("ord").alias("first"), F.max_by("id", "ord").alias("id"))
    key = F.concat_ws("::", "file_path", F.when(F.col("owner") != "", F.col("owner")), "name")
    parts = F.split(key, "::")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "::"))
    listed = places.select("first", "id", F.explode(endings).alias("wanted"))
    best = listed.groupBy("wanted").agg(F.min_by("id", "first").alias("id"))
    return names.select("wanted").distinct().join(by_shuffle(best), "wanted")


def lookup_local(references: DataFrame, symbols: DataFrame, name: str, found: str, owner: str | None = None) -> DataFrame:
    """``references`` (file_path, ...) with ``found``: the symbol of that name in the owner, else in the file."""
    places = local_symbols(symbols)
    plain = places.where("owner = ''").select("file_path", F.col("name").alias(name), F.col("id").alias("plain_"))
    out = references.join(by_shuffle(plain), ["file_path", name], "left")
    if owner is None:
        return out.withColumnRenamed("plain_", found)
    owned = places.where("owner <> ''").select("file_path", F.col("owner").alias(owner), F.col("name").alias(name), F.col("id").alias("owned_"))
    return out.join(by_shuffle(owned), ["file_path", owner, name], "left").withColumn(found, F.coalesce("owned_", "plain_")).drop("owned_", "plain_")


def lookup_global(references: DataFrame, symbols: DataFrame, name: str, found: str) -> DataFrame:
    names = global_symbols(symbols).select(F.col("name").alias(name), F.col("id").alias(found))
    return references.join(by_shuffle(names), name, "left")


def lookup_alias(references: DataFrame, aliases: DataFrame, name: str, found: str) -> DataFrame:
    """``found``: what an import of the same file calls by that name; ``aliases`` has (file_path, local, id)."""
    return references.join(by_shuffle(aliases.select("file_path", F.col("local").alias(name), F.col("id").alias(found))), ["file_path", name], "left")


def cascade(references: DataFrame, symbols: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """``references`` with target_id: by the file's imports, its own symbols, then any file's."""
    out = lookup_alias(references, aliases, name, "a_")
    out = lookup_local(out, symbols, name, "l_")
    out = lookup_global(out, symbols, name, "g_")
    return out.withColumn("target_id", F.coalesce("a_", "l_", "g_")).drop("a_", "l_", "g_")


def resolve_calls(calls: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """``calls`` (from_id, file_path, owner, name, full_name, ...) with target_id, null where nothing matches.

    In turn: the file's imports by the first part, its symbols by name, by the last part, then any file's by name, by the last part.
    """
    calls = calls.withColumn("first_", F.substring_index("full_name", ".", 1)).withColumn("last_", last_part(F.col("full_name")))
    out = lookup_alias(calls, aliases, "first_", "a_")
    out = lookup_local(out, symbols, "name", "n_", "owner")
    out = lookup_local(out, symbols, "last_", "p_", "owner")
    out = lookup_global(out, symbols, "name", "g_")
    out = lookup_global(out, symbols, "last_", "h_")
    return out.withColumn("target_id", F.coalesce("a_", "n_", "p_", "g_", "h_")).drop("a_", "n_", "p_", "g_", "h_", "first_", "last_")


def call_edges(resolved: DataFrame) -> DataFrame:
    """(id, type, from_id, to_id, resolved): one edge for each type, ends and line; calls in tests are TESTS."""
    hit = resolved.where("target_id IS NOT NULL")
    kind = F.when(F.col("is_test"), "TESTS").otherwise("CALLS")
    return hit.select(F.concat_ws(":", kind, "from_id", "target_id", "line").alias("id"), kind.alias("type"), "from_id", F.col("target_id").alias("to_id"), F.lit(True).alias("resolved")).distinct()


def unresolved_nodes(resolved: DataFrame) -> DataFrame:
    """(id, type, name): a module for every called name that nothing matched, once."""
    return resolved.where("target_id IS NULL").select(F.concat(F.lit("unresolved:"), "full_name").alias("id"), F.lit("module").alias("type"), F.col("full_name").alias("name")).distinct()


def unresolved_edges(resolved: DataFrame) -> DataFrame:
    miss = resolved.where("target_id IS NULL").withColumn("to_id", F.concat(F.lit("unresolved:"), "full_name"))
    return miss.select(F.concat_ws(":", F.lit("CALLS_UNRESOLVED"), "from_id", "to_id", "line").alias("id"), F.lit("CALLS_UNRESOLVED").alias("type"), "from_id", "to_id", F.lit(False).alias("resolved")).distinct()


def is_external(module: Column) -> Column:
    return ~module.startswith(".") & ~module.startswith("/")


def module_bases(imports: DataFrame, aliases: DataFrame, root: str) -> DataFrame:
    """``imports`` (file_path, module, ...) with (base, priority): every path that a module may mean, in order of trial.

    A relative module is below its file's directory. Others are tried by the path aliases (prefix, suffix, target with a star,
    priority) whose ends they have, then below the root, then below its ``src``. Aliases are the lines of one configuration file: they are
    checked to be few and joined by their ends.
    """
    module = F.col("module")
    relative = imports.where(module.startswith(".")).withColumn("base", normalise(F.concat(dirname(F.col("file_path")), F.lit("/"), module))).withColumn("priority", F.lit(0))
    bare = imports.where(~module.startswith(".") & (module != ""))
    if aliases.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 path aliases")
    fits = (module == F.col("prefix")) | (module.startswith(F.col("prefix")) & module.endswith(F.col("suffix")))
    star = F.expr("substring(module, length(prefix) + 1, greatest(0, length(module) - length(prefix) - length(suffix)))")
    # F.broadcast: checked above
    named = bare.join(F.broadcast(aliases), fits).withColumn("base", normalise(F.replace(F.col("target"), F.lit("*"), star)))
    named = named.select(*imports.columns, "base", "priority")
    under = lambda folder, p: bare.withColumn("base", normalise(F.concat(F.lit(folder + "/"), module))).withColumn("priority", F.lit(p))
    return relative.unionByName(named).unionByName(under(root, 1_000_000)).unionByName(under(root + "/src", 1_000_001))


def candidates(bases: DataFrame) -> DataFrame:
    """``bases`` (base, ...) with (candidate, trial): fourteen paths in order."""
    base = F.col("base")
    cut = F.when(extname(base).isin(*RUNTIME_EXTENSIONS), F.regexp_replace(base, "\\.[^./]*$", "")).otherwise(base)
    return bases.select("*", F.posexplode(F.array(base, cut, *[F.concat(cut, F.lit(e)) for e in ENDINGS])).alias("trial", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame, root: str) -> DataFrame:
    """``imports`` (ord, ...) with target_path and target_id of the first candidate that is a file of ``files`` (path, id).

    Where there is none, target_id is the module's own node and external says whether its name is a package's.
    """
    tried = candidates(module_bases(imports, aliases, root)).join(by_shuffle(files.select(F.col("path").alias("candidate"), F.col("id").alias("file_id_"))), "candidate")
    best = tried.groupBy("ord").agg(F.min(F.struct("priority", "trial", "candidate", "file_id_")).alias("x")).select("ord", F.col("x.candidate").alias("target_path"), F.col("x.file_id_").alias("found_"))
    out = imports.join(by_shuffle(best), "ord", "left")
    return out.withColumn("target_id", F.coalesce("found_", F.concat(F.lit("module:"), "module"))).withColumn("external", F.col("found_").isNull() & is_external(F.col("module"))).drop("found_")


def import_edges(resolved: DataFrame) -> DataFrame:
    """(id, type, from_id, to_id, resolved): one per import; from a test file it is TESTS. What resolves to no file is unresolved."""
    kind = F.when(F.col("is_test"), "TESTS").otherwise("IMPORTS")
    return resolved.select(F.concat_ws(":", kind, "file_id", "target_id", "line").alias("id"), kind.alias("type"), F.col("file_id").alias("from_id"), F.col("target_id").alias("to_id"), F.col("target_path").isNotNull().alias("resolved")).distinct()


def depends_on_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each pair of files, of the last import among them."""
    pairs = resolved.where("target_path IS NOT NULL").groupBy(F.col("file_id").alias("from_id"), F.col("target_id").alias("to_id")).agg(F.max("ord").alias("ord"))
    return pairs.select(F.concat_ws(":", F.lit("DEPENDS_ON"), "from_id", "to_id").alias("id"), F.lit("DEPENDS_ON").alias("type"), "from_id", "to_id", F.lit(True).alias("resolved"), "ord")


def imported_symbols(resolved: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved imports with symbol_id: an import's name is an export of the target file, and that a symbol there."""
    first = Window.partitionBy("file_path", "exported").orderBy("ord")
    named = exports.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select(F.col("file_path").alias("target_path"), F.col("exported").alias("imported"), F.when(F.col("local") != "", F.col("local")).otherwise(F.col("exported")).alias("meant_"))
    places = local_symbols(symbols).where("owner = ''").select(F.col("file_path").alias("target_path"), F.col("name").alias("meant_"), F.col("id").alias("symbol_id"))
    return resolved.join(by_shuffle(named), ["target_path", "imported"]).join(by_shuffle(places), ["target_path", "meant_"]).drop("meant_")


def import_aliases(resolved: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, local, id): what a file's imports call a symbol; the last import of a name counts."""
    return imported_symbols(resolved, exports, symbols).groupBy("file_path", "local").agg(F.max_by("symbol_id", "ord").alias("id"))


def member_edges(symbols: DataFrame) -> DataFrame:
    """OWNS from an owner to its members: a join of the symbols with themselves; the owner must have come first."""
    owners = symbols.where("owner = ''").select("file_path", F.col("name").alias("owner"), F.col("id").alias("from_id"), F.col("ord").alias("since"))
    members = symbols.where("owner <> ''").select("file_path", "owner", F.col("id").alias("to_id"), "ord")
    met = members.join(by_shuffle(owners), ["file_path", "owner"]).where(F.col("since") < F.col("ord"))
    last = met.groupBy("to_id").agg(F.max_by("from_id", "since").alias("from_id"))
    return last.select(F.concat_ws(":", F.lit("OWNS"), "from_id", "to_id").alias("id"), F.lit("OWNS").alias("type"), "from_id", "to_id", F.lit(True).alias("resolved"))


def reference_edges(references: DataFrame, symbols: DataFrame, aliases: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
    """(id, type, from_id, to_id, resolved) from ``references`` (id, file_path, ref) that resolve; ``reverse`` swaps the ends."""
    hit = cascade(references, symbols, aliases, "ref").where("target_id IS NOT NULL")
    a, b = ("target_id", "id") if reverse else ("id", "target_id")
    return hit.select(F.concat_ws(":", F.lit(kind), a, b).alias("edge_id"), F.lit(kind).alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(True).alias("resolved")).withColumnRenamed("edge_id", "id").distinct()
