"""Path arithmetic on columns, with ``/`` as the separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """What stands before the last slash; ``.`` if there is none, ``/`` for a file in the root."""
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(head == "", "/").otherwise(head)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """The last dot and what follows, unless the name starts with that dot."""
    return F.regexp_extract(basename(path), "^.+(\\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "^(.+)\\.[^.]*$", "$1")


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, or the path itself if it isn't there."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)


def directories(path: Column) -> Column:
    """The directories of a relative path, outermost first."""
    return F.filter(F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/"), lambda p: (p != "") & (p != "."))


def last_parts(path: Column, count: int = 4) -> Column:
    """The last ``count`` parts of a path."""
    parts = F.split(path, "/")
    start = F.greatest(F.size(parts) - count, F.lit(0)) + 1
    return F.array_join(F.slice(parts, start, F.lit(count)), "/")


def normalise(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path: Column, root: str) -> Column:
    """Whether the normalised path is below ``root`` and not the root itself."""
    return normalise(path).startswith(root.rstrip("/") + "/")


def capitalised(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def editor_uri(path: Column, line: Column, column: Column) -> Column:
    """A link that opens an editor at a place."""
    return F.concat(F.lit("vscode://file/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/", ""), F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"))
