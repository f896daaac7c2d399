"""Search of nodes by text and type, and the resolution of a focus to one node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph

PLACES = ("name", "full_name", "file_path")


def _any(test) -> Column:
    tests = [F.coalesce(test(F.col(c)), F.lit(False)) for c in PLACES]
    return tests[0] | tests[1] | tests[2]


def find_by_name(graph: PropertyGraph, pattern: str, count: int = 50) -> DataFrame:
    """The first nodes by name whose name, full name or file holds the text, whatever its case; a blank text finds none."""
    wanted = pattern.strip().lower()
    hit = _any(lambda c: F.lower(c).contains(wanted)) if wanted else F.lit(False)
    return graph.nodes.where(hit).orderBy("name", "id").limit(count)


def find_by_type(graph: PropertyGraph, kind: str, count: int = 100) -> DataFrame:
    return graph.nodes_of(kind).orderBy("name", "id").limit(count)


def resolve_focus(graph: PropertyGraph, focus: str) -> DataFrame:
    """The one node that a focus names, with its tier: exact, whatever case, or part of a name; none if every tier is ambiguous.

    All tiers are counted in one pass; a tier with more than one node falls through to the next.
    """
    exact = lambda c: F.coalesce(c == focus, F.lit(False))
    folded = lambda c: F.coalesce(F.lower(c) == focus.lower(), F.lit(False))
    tiers = [exact(F.col("id")) | exact(F.col("name")) | exact(F.col("full_name")), folded(F.col("name")) | folded(F.col("full_name")), _any(lambda c: F.lower(c).contains(focus.strip().lower())) if focus.strip() else F.lit(False)]
    rows = graph.nodes.select("id", *[t.alias(f"t{k}") for k, t in enumerate(tiers)]).where("t0 OR t1 OR t2")
    found = rows.agg(*[F.count_if(f"t{k}").alias(f"n{k}") for k in range(3)], *[F.min(F.when(F.col(f"t{k}"), F.col("id"))).alias(f"i{k}") for k in range(3)])
    tier = F.when(F.col("n0") == 1, 1).when(F.col("n1") == 1, 2).when(F.col("n2") == 1, 3)
    one = found.select(tier.alias("tier"), F.element_at(F.array("i0", "i1", "i2"), F.coalesce(tier, F.lit(1))).alias("id")).where("tier IS NOT NULL")
    return graph.nodes.join(one, "id")
