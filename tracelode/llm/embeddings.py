"""Near duplicates among embeddings: an exact metric range join over pivot cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_keys
from .components import components

#: Pivots of one split; a deeper cell has pivots of its own, so cells stay small at any size.
PIVOTS = 63
#: Splits one inside the other, at most: 63 ** 9 cells.
DEPTH = 9
#: Rows of a cell that one task assigns to pivots at a time.
DEAL = 8192
#: Slack of the distance bounds, so that rounding never loses a link.
SLACK = 1e-9
#: A cell is split if, by this many rows that stand for all, less than this part of its comparisons is left.
PROBES, PAYS = 256, 0.5


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, dim): rows that can link, as doubles."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole & some).select("vec_id", "label", v.alias("v"), F.size("embedding").alias("dim"))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def assign(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's nearest pivot, and for each pivot whether the vector must be copied to its cell.

    u in the cell of p has |u - p| <= |u - q| for its nearest pivot p. If |u - v| <= r then by the triangle
    inequality v is within r of p's side of the plane halfway between p and q, v's nearest: its distance to that plane,
    (v.q - v.p) / |p - q|, is at most r.
    """
    dots = x @ p.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
    lead = dots[np.arange(len(x)), home][:, None] - dots
    return home, lead <= (radius + SLACK) * apart[home] + SLACK


CELL = ["class", "path"]


def _memberships(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and all cells that it is in: its own and earlier ones where a partner may be."""
    home, near = assign(x, p, radius)
    near &= np.arange(len(p))[None, :] < home[:, None]  # a pair meets in the lower of its two cells
    near[np.arange(len(home)), home] = True
    return home, near


def _chosen(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """A cell's pivots, if by its probes they save enough: a cell's comparisons are the square of its rows."""
    pdf = pdf.sort_values("rank")
    want = int(pdf["want"].iloc[0])
    x = _unit(pdf["v"].tolist())
    _, near = _memberships(x[want:] if len(x) > want else x, x[:want], radius)
    if (near.mean(axis=0) ** 2).sum() >= PAYS:
        return pd.DataFrame(columns=["class", "path", "p"])
    return pd.DataFrame({"class": pdf["class"].iloc[:1], "path": pdf["path"].iloc[:1], "p": [[list(v) for v in pdf["v"].iloc[:want]]]})


def _pivots(placed: DataFrame, sizes: DataFrame, per_cell: int, radius: float) -> DataFrame:
    """(class, path, p): pivots of the cells that they part well: vectors drawn by hash, one for each ``per_cell`` rows, ``PIVOTS`` at most."""
    want = F.least(F.lit(PIVOTS), F.ceil(F.col("rows") / per_cell)).cast("int")
    drawn = with_keys(placed, sizes.withColumn("want", want).withColumn("size", F.col("rows")), CELL, "want", "size").withColumn("h", F.xxhash64("id", "path", F.lit("pivot")))
    # the share drawn by hash is a little above what is wanted, so only about as many rows are sorted
    few = drawn.where(F.shiftrightunsigned("h", 33) < F.lit(float(1 << 31)) * F.least(F.lit(1.0), (1.2 * (F.col("want") + PROBES) + 20) / F.col("size")))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(*CELL).orderBy("h", "id"))).where(F.col("rank") <= F.col("want") + PROBES)
    return ranked.select(*CELL, "rank", "want", "v").groupBy(*CELL).applyInPandas(lambda pdf: _chosen(pdf, radius), "class long, path long, p array<array<double>>")


def _dealt(rows: pd.DataFrame, pivots: pd.DataFrame, radius: float, level: int) -> pd.DataFrame:
    """A part of a cell's rows in the cells of its pivots: each at home in one, and copied to earlier ones where a partner may be."""
    columns = ["class", "path", "id", "n", "v", "homes"]
    if not len(rows) or not len(pivots):
        return pd.DataFrame(columns=columns)
    p = _unit([list(x) for x in pivots["p"].iloc[0]])
    home, near = _memberships(_unit(rows["v"].tolist()), p, radius)
    row, cell = np.nonzero(near)
    out = rows.iloc[row].reset_index(drop=True)
    out["path"] = out["path"] * (PIVOTS + 1) + 1 + cell
    out["homes"] = out["homes"] + np.where(cell == home[row], 1 << level, 0)
    return out[columns]


def _deal_at(radius: float, level: int):
    return lambda rows, pivots: _dealt(rows, pivots, radius, level)


def cells(classes: DataFrame, radius: float, per_cell: int) -> DataFrame:
    """Rows (class, path, id, n, v, homes, levels): vectors in the cells where they meet their partners.

    Cells of more than ``per_cell`` rows are split by pivots of their own, again and again. A cell whose split would copy so
    much that few comparisons are saved (its vectors are too far apart for the radius) stays whole. ``homes`` has a bit for each split at which the row is in its own cell; a pair counts where one of the two is
    at every split of the cell, which is true in exactly one cell.
    """
    done, open_ = None, stored(classes.select("class", F.lit(0).cast("long").alias("path"), "id", "n", "v", F.lit(0).cast("long").alias("homes")))
    for level in range(DEPTH + 1):
        levels = F.lit(level).alias("levels")
        sizes = stored(open_.groupBy(*CELL).agg(F.count("*").alias("rows")))
        big = sizes.where(F.col("rows") > per_cell)
        if level == DEPTH or big.isEmpty():
            last = open_.select("*", levels)
            return last if done is None else done.union(last)
        pivots = stored(_pivots(open_, big, per_cell, radius))
        parted = stored(sizes.join(pivots.select(*CELL), CELL, "left_semi").withColumn("parts", F.ceil(F.col("rows") / DEAL).cast("int")))
        stay = with_keys(open_, sizes.join(pivots.select(*CELL), CELL, "left_anti"), CELL).select(*open_.columns, levels)
        done = stay if done is None else done.union(stay)
        rows = with_keys(open_, parted, CELL, "parts").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        ahead = pivots.join(parted.select(*CELL, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")), CELL)
        keys = [*CELL, "salt"]
        open_ = stored(rows.groupBy(*keys).cogroup(ahead.groupBy(*keys)).applyInPandas(_deal_at(radius, level), "class long, path long, id long, n long, v array<double>, homes long"))
    raise AssertionError("unreachable")


def _join_cell(pdf: pd.DataFrame, least: float, slice_: int = 512) -> pd.DataFrame:
    """Links among one cell's rows, or between two of its blocks: counts, and a partner that connects."""
    x, ids, n, homes = _unit(pdf["v"].tolist()), pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["homes"].to_numpy()
    side, cross, full = pdf["side"].to_numpy(), bool((pdf["lo"] != pdf["hi"]).iloc[0]), (1 << int(pdf["levels"].iloc[0])) - 1
    links, counts = np.zeros((len(ids), len(ids)), bool), np.zeros(len(ids), np.int64)
    for at in range(0, len(ids), slice_):
        s = slice(at, at + slice_)
        part = x[s] @ x.T >= least
        part &= (homes[s, None] | homes[None, :]) == full
        if cross:
            part &= side[s, None] != side[None, :]
        part[np.arange(len(part)), np.arange(at, at + len(part))] = False
        links[s], counts[s] = part, part @ n
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int32)
    label[order] = np.arange(len(ids))
    some = np.flatnonzero(counts)
    links = links[np.ix_(some, some)]
    small = label[some]
    while len(some):  # the least rank among partners, until it stays
        new = small.copy()
        for at in range(0, len(some), slice_):
            s = slice(at, at + slice_)
            new[s] = np.minimum(new[s], np.where(links[s], small[None, :], len(ids)).min(axis=1))
        if (new == small).all():
            break
        small = new
    return pd.DataFrame({"id": ids[some], "links": counts[some], "root": ids[order[small]]})


def embedding_dedup(vectors: DataFrame, least: float = 0.93, per_cell: int = 1024, block: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors with equal, non-null labels of any type and equal lengths link at a cosine of ``least`` or more in double
    precision; a vector that is null, empty, zero or has null or non-finite components links with nothing.
    n_links counts other rows linked directly, component_id is the smallest vec_id reachable, kept says
    whether the row is that one. Rows that repeat a vec_id count as rows and share their component; a null vec_id
    gets no component but itself. Very long vectors cost in proportion. Other columns are ignored; an empty table gives no rows.

    Equal vectors are first reduced to one row with their number. Each vector goes to its nearest pivot's
    cell and, where the distance bound allows a partner there, to earlier cells; cells then join on their own.
    Pivots belong to a cell and are joined with its rows by key, so nothing that grows with labels or rows is collected or broadcast.
    A cell of more than ``block`` rows, one that no pivots can part, is joined as pairs of blocks, each a task's work of bounded
    size: rows are not collected beyond two blocks, and links are counted, not listed.
    """
    usable = _usable(vectors.where("vec_id IS NOT NULL"))
    distinct = stored(usable.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    labels = stored(distinct.groupBy("label", "dim").agg(F.count("*").alias("rows")).select("label", "dim", "rows", F.monotonically_increasing_id().alias("class")))
    classes = stored(with_keys(distinct, labels, ["label", "dim"], "class"))
    placed = stored(cells(classes, float(np.sqrt(max(0.0, 2 - 2 * least))), per_cell))
    sizes = stored(placed.groupBy(*CELL).agg(F.count("*").alias("rows")))
    dealt = with_keys(placed, sizes.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")), CELL, "blocks").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))
    dealt = dealt.select(*CELL, "homes", "levels", "id", "n", "v", F.col("own").alias("side"), F.explode(pairs).alias("x")).select("*", "x.lo", "x.hi").drop("x")
    found = stored(dealt.groupBy(*CELL, "lo", "hi").applyInPandas(lambda pdf: _join_cell(pdf, least), "id long, links long, root long"))
    joined = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.join(totals, "id", "left").join(joined, distinct["id"] == joined["node"], "left")
    known = known.select("label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = usable.join(known, ["label", "dim", "v"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


#: The same in DuckDB's SQL.
SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), low AS (
  SELECT u, min(w) AS m FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.u LEFT JOIN low ON vec_id = low.u
"""
