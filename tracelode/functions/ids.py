"""Identifiers derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 16 hex digits of SHA-1 over the parts joined by ``::`` (null parts: empty)."""
    joined = F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def rounded(x: Column, digits: int) -> Column:
    """Rounding half up by floor, which every IEEE engine does alike."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)
