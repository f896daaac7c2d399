"""Near duplicates by SimHash: an inverted index on byte positions, count filtering, then verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_rows, stored, with_keys
from .components import components

SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text, as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    ones, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for start in range(0, last, BLOCK):
        hashes = np.array([digest(join(words[i : i + width]), SEED) for i in range(start, min(last, start + BLOCK))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > last, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row: words of ASCII white space, A-Z lower-cased, shingles with repeats."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_batches(((i, fingerprint(t, width)) for i, t in arrow_rows(batches, "doc_id", "text")), schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


#: Byte positions of a posting. Postings of five of eight bytes have 40-bit values, so unrelated texts rarely share one at any size.
POSTED = 5


def postings(posted: int = POSTED) -> list[tuple[int, ...]]:
    """All sets of ``posted`` of the eight byte positions; a fingerprint has a posting in each."""
    return list(combinations(range(8), posted))


def least_shared(most_bits: int, posted: int = POSTED) -> int:
    """The guaranteed matches: fingerprints with so many differing bits share at least 8 - bits bytes, and the postings within them."""
    return comb(8 - most_bits, posted)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, most_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Pairs (u, v) of fingerprints that connect all those at ``most_bits`` (1 or 2) or fewer differing bits.

    Every fingerprint is posted under each set of ``POSTED`` byte positions, with those bytes. Pairs that share a posting are
    tallied over all postings, map-side first; pairs with fewer than the guaranteed number of matches go, the rest are verified
    bit by bit. A posting of more than ``bucket`` fingerprints would make pairs with the square of its size, so it gives
    representative pairs and membership instead, in proportion to its size: each member lists itself and every change of one
    bit outside the shared bytes. Two members at distance two or less have such a value in common, and whatever has one in
    common is at distance two or less, so the first member of each value represents it and is linked to the others. A pair
    with such a posting is connected there; any other has all its postings tallied; so none is lost, at any size.
    """
    if most_bits not in (1, 2):
        raise ValueError("most_bits is 1 or 2")
    fp = F.col("fp")
    sets = postings()
    masks = [_signed(sum(255 << (8 * i) for i in positions)) for positions in sets]
    rows = F.array(*[F.struct(F.lit(k).cast("byte").alias("posting"), fp.bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)])
    index = distinct.select("fp", F.explode(rows).alias("x")).select("fp", "x.posting", "x.value")
    met = index.groupBy("posting", "value").agg(F.count("*").alias("rows")).where("rows > 1")
    # most values are one fingerprint's alone; what is left is small, and is written once
    met = stored(with_keys(stored(index), stored(met).withColumn("size", F.col("rows")), ["posting", "value"], "size"))
    small = met.where(F.col("size") <= bucket).groupBy("posting", "value").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select(F.explode("fps").alias("u"), "fps").select("u", F.explode(F.filter("fps", lambda x: x > F.col("u"))).alias("v"))
    tallied = pairs.groupBy("u", "v").agg(F.count("*").alias("matches")).where(F.col("matches") >= least_shared(most_bits))
    near = tallied.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most_bits).select("u", "v")
    hot = met.where(F.col("size") > bucket)
    if hot.isEmpty():
        return near
    flips = [[0, *(_signed(1 << (8 * i + j)) for i in range(8) if i not in positions for j in range(8))] for positions in sets]
    mine = F.element_at(F.array(*[F.array(*[F.lit(x) for x in f]) for f in flips]), F.col("posting") + 1)
    changed = hot.select("posting", "fp", F.explode(F.transform(mine, lambda x: fp.bitwiseXOR(x))).alias("value"))
    if most_bits == 2:
        heads = changed.groupBy("posting", "value").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        stars = changed.join(heads, ["posting", "value"]).where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    else:  # at one bit the changed value is itself the partner
        stars = changed.select(F.col("fp").alias("u"), F.col("value").alias("v")).distinct().join(distinct.withColumnRenamed("fp", "v"), "v").where("u <> v").select("u", "v")
    return near.union(stars)


def simhash_dedup(docs: DataFrame, width: int = 3, most_bits: int = 2, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id, group_size) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links (``most_bits`` or fewer differing bits), itself
    included. A text with fewer words than ``width`` is one shingle; null, empty and blank texts have
    fingerprint zero, which is linked like any other. Rows that repeat a doc_id keep a row each; a null doc_id
    takes no part in the smallest. Other columns are ignored; an empty table gives no rows.
    Equal fingerprints are first reduced to one row, so groups of exact copies cost nothing to link. Very long texts are
    hashed in blocks of shingles.
    """
    marked = stored(fingerprints(docs, width))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(links(distinct.select("fp"), most_bits, bucket))
    placed = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    groups = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    named = stored(placed.join(groups, "component").select("fp", "component_id", "group_size", F.col("n").alias("rows")))
    return with_keys(marked, named, ["fp"], "component_id", "group_size").select("doc_id", "fp", "component_id", "group_size")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of the unsigned number."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
