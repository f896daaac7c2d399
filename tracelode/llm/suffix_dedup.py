"""Removal of repeated substrings by collection Burrows-Wheeler transforms built column-wise.

A string of ``width`` bytes that stands at two places has the same least k-gram hash, its anchor, at the same
distance from its start in both. So every window of a text is dealt to its anchor's hash, and only windows under
one hash can be equal: an anchor's windows are one piece of text, pieces under a hash that occurs once are left out,
equal pieces are reduced to one, and what remains are many small collections, whose transforms with
their common prefixes are built independently.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_rows, row_key, stored, with_keys

#: Windows whose anchors are found at a time.
SEGMENT = 1 << 15
#: Bytes of the pieces in one collection, about; more only where one hash has more.
COLLECTION = 1 << 17
#: Bytes of a transform's file held in memory before it goes to disk.
SPOOL = 8 << 20
_LOW = np.uint64(0xFFFF)
_table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams (k a power of two), by doubling."""
    h, n = _table[data], 1
    while n < k:
        factor = np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64) | 1)
        h = h[:-n] * factor + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from running leasts of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: Iterator[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, first byte, part) of about ``SEGMENT`` to twice as many bytes.

    Texts below ``width`` bytes have no window and are left out; one of more than ``SEGMENT`` windows is cut into parts, which
    overlap so that each window lies in exactly one.
    """
    held, load = [], 0
    for number, data in enumerate(texts):
        for start in range(0, len(data) - width + 1, SEGMENT):
            part = data[start : start + SEGMENT + width - 1]
            if held and load + len(part) >= 2 * SEGMENT:
                yield held
                held, load = [], 0
            held.append((number, start, part))
            load += len(part)
    if held:
        yield held


def anchors(data: bytes, sizes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(part, hash, first window, windows, anchor's place after it) of the runs of windows that share an anchor.

    ``data`` are parts of ``sizes`` bytes, one after the other; windows over two parts are left out, and first windows
    count from the data's start. A window's anchor is its k-gram with the least hash, the first of equals. It depends on the
    window alone, so texts are cut anywhere; a run cut in two is two runs with one hash.
    """
    h = gram_hashes(np.frombuffer(data, np.uint8), k)
    order = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # 48 bits, then the place
    place = (_sliding_least(order, width - k + 1) & _LOW).astype(np.int64)
    ends = np.cumsum(sizes)
    stops = ends - width + 1  # where a part's windows end
    new = np.empty(len(place), bool)
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[ends - sizes] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(ends, first, side="right")
    inside = first < stops[owner]
    first, owner = first[inside], owner[inside]
    length = np.minimum(np.append(first[1:], stops[-1]), stops[owner]) - first
    return owner, h[place[first]].view(np.int64), first, length, place[first] - first


def _stream(size: int):
    """A file of this task alone, in memory up to ``SPOOL`` bytes; it has no name and ends with the task."""
    return tempfile.SpooledTemporaryFile(max_size=max(size, 1) if size < SPOOL else SPOOL)


class _Files:
    """The transform's symbols and common prefixes, two files that each round reads and writes in sequence."""

    def __init__(self):
        self.files, self.size = None, 0

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f in self.files:
            f.seek(0)
            out.append(np.frombuffer(f.read(self.size), np.uint8))
        return out[0], out[1]

    def write(self, *columns: np.ndarray) -> None:
        fresh = [_stream(len(c)) for c in columns]
        for f, c in zip(fresh, columns, strict=True):
            f.write(c)
        for f in self.files or ():
            f.close()
        self.files, self.size = fresh, len(columns[0])

    def close(self) -> None:
        for f in self.files or ():
            f.close()


_PLACE = np.uint32((1 << 24) - 1)


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """(symbol << 24) + place, ascending: where each symbol stands, symbol by symbol.

    numpy sorts such words in vector registers, in 0.6 of the time of its own stable counting sort of the bytes.
    """
    keys = symbols.astype(np.uint32)
    keys <<= np.uint32(24)
    keys |= _ramp(len(symbols))
    keys.sort()
    return keys


@lru_cache(maxsize=1)
def _ramp_of(size: int) -> np.ndarray:
    return np.arange(size, dtype=np.uint32)


def _ramp(n: int) -> np.ndarray:
    return _ramp_of(max(1 << 16, 1 << (n - 1).bit_length()))[:n]


def repeated_starts(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece, a mark for every window: whether it stands at another place of the collection too.

    In round j the j-th symbol from the end of every piece is put before the suffix that starts after it. Where the new suffix goes
    follows from the symbols of the transform, which are counted in one linear pass: suffixes that start with a
    symbol stand in the order of what follows it. Its common prefix with the suffix above is one more than
    the least among those between the two places where the symbol last stood; likewise for the one below.
    Common prefixes are counted to ``width``. Zero ends a piece and bytes are raised by one; 255 is not part of UTF-8.
    """
    count = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")  # longest first: those that go on are always the first ones
    sizes = lengths[order]
    rounds = int(sizes[0])
    alive = count - np.searchsorted(sizes[::-1], np.arange(rounds + 1), side="left")  # pieces of at least j symbols
    grid = np.zeros((rounds + 1, count), np.uint8)  # row j: the symbol that stands j before the end
    for i, o in enumerate(order.tolist()):
        grid[: sizes[i], i] = np.frombuffer(pieces[o], np.uint8)[::-1] + np.uint8(1)
    files = _Files()
    files.write(grid[0], np.zeros(count, np.uint8))
    at = np.arange(count)
    for j in range(1, rounds + 1):
        symbols, common = files.read()
        n = len(symbols)
        going = at[: alive[j]]
        turn = np.argsort(going, kind="stable")
        here = going[turn]
        c = symbols[here]
        by_symbol = _by_symbol(symbols)
        rank = np.searchsorted(by_symbol, (c.astype(np.uint32) << np.uint32(24)) | here.astype(np.uint32))
        ended = int(np.count_nonzero(symbols == 0))
        spots = rank - ended + count
        before, after = by_symbol[np.maximum(rank - 1, 0)], by_symbol[np.minimum(rank + 1, n - 1)]
        has_before, has_after = (rank > 0) & (before >> 24 == c), (rank < n - 1) & (after >> 24 == c)
        before, after = (before & _PLACE).astype(np.int64), (after & _PLACE).astype(np.int64)
        # the least of common[before + 1 : here + 1] and of common[here + 1 : after + 1]; what lies between ranges is passed over
        edges = np.empty((len(here), 3), np.int64)
        edges[:, 1] = here + 1
        edges[:, 0] = np.where(has_before, before + 1, here)
        edges[:, 2] = np.where(has_after, after + 1, here + 2)
        extended = np.zeros(n + 3, np.uint8)
        extended[:n] = common
        least = np.minimum.reduceat(extended, edges.ravel()).reshape(-1, 3)
        up = np.where(has_before, np.minimum(least[:, 0], width - 1) + np.uint8(1), 0)
        down = (np.minimum(least[:, 1], width - 1) + np.uint8(1))[has_after]
        old = np.ones(n + len(here), bool)
        old[spots] = False
        out_symbols, out_common = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        out_symbols[old], out_common[old] = symbols, common
        out_symbols[spots] = grid[j, : len(here)][turn]
        out_common[spots] = up
        out_common[spots[has_after] + 1] = down
        files.write(out_symbols, out_common)
        at[turn] = spots
        # suffixes of pieces that ended move down as others come in above them, but are never asked for again
    symbols, common = files.read()
    files.close()
    n = len(symbols)
    repeated = common >= width
    repeated[:-1] |= common[1:] >= width
    place = np.empty(n, np.int64)
    place[(_by_symbol(symbols) & _PLACE).astype(np.int64)] = np.arange(n)
    ended = int(np.count_nonzero(symbols == 0))
    marks = np.zeros((rounds + 1, count), bool)
    spot = np.arange(count)
    for j in range(1, rounds + 1):
        spot = place[spot[: alive[j]]] - ended + count
        if j >= width:
            marks[j, : alive[j]] = repeated[spot]
    out: list[np.ndarray] = [None] * count  # type: ignore[list-item]
    for i, o in enumerate(order.tolist()):
        out[o] = marks[width : sizes[i] + 1, i][::-1]
    return out


def _digest(piece: bytes) -> tuple[int, int]:
    d = xxhash.xxh128_digest(piece)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


MARKS = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("n", pa.int16()), ("lead", pa.int16()), ("a", pa.int64()), ("b", pa.int64())])
MARKS_SQL = "key_a long, key_b long, h long, at int, n short, lead short, a long, b long"
PIECES = pa.schema([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("lead", pa.int16()), ("copies", pa.int64()), ("piece", pa.binary())])
PIECES_SQL = "h long, a long, b long, lead short, copies long, piece binary"
PARTS = pa.schema([*PIECES, ("of_a", pa.int64()), ("of_b", pa.int64()), ("shift", pa.int32())])
PARTS_SQL = PIECES_SQL + ", of_a long, of_b long, shift int"


def _scan(width: int, k: int):
    """Every run of windows with its anchor's hash and its piece's digest; texts are hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                keys = [some.column(some.schema.get_field_index(n)).to_numpy() for n in ("key_a", "key_b")]
                texts = ((t or "").encode() for t in some.column(some.schema.get_field_index("text")).to_pylist())
                for held in segments(texts, width):
                    data = b"".join([p for _, _, p in held])
                    sizes = np.array([len(p) for _, _, p in held])
                    owner, h, first, length, lead = anchors(data, sizes, width, k)
                    digests = b"".join([xxhash.xxh128_digest(data[s:e]) for s, e in zip(first.tolist(), (first + length + width - 1).tolist(), strict=True)])
                    ab = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    number = np.array([i for i, _, _ in held])[owner]
                    at = first + (np.array([i for _, i, _ in held]) - (np.cumsum(sizes) - sizes))[owner]
                    columns = keys[0][number], keys[1][number], h, at.astype(np.int32), length.astype(np.int16), lead.astype(np.int16), ab[:, 0].copy(), ab[:, 1].copy()
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MARKS, strict=True)], schema=MARKS)

    return run


def _cores(width: int, block: int):
    """What all windows of each block of a piece have in common, as a hash, and the block's windows."""
    schema = pa.schema([("core", pa.int64()), ("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for h, a, b, lead, piece in arrow_rows(batches, "h", "a", "b", "lead", "piece"):
                for first, q, part, core in split_piece(piece, lead, width, block):
                    key = xxhash.xxh64_intdigest(core, (h * 257 + q) & (2**64 - 1))
                    yield key - (1 << 64) if key >= 1 << 63 else key, h, a, b, first, first + len(part) - width + 1

        yield from arrow_batches(rows(), schema, 16384)

    return run


def _cut(width: int):
    """The bytes of the pieces asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for text, asked in arrow_rows(batches, "text", "asked"):
                data = text.encode()
                for m in asked:
                    yield m["h"], m["a"], m["b"], m["lead"], m["copies"], data[m["at"] : m["at"] + m["n"] + width - 1]

        yield from arrow_batches(rows(), PIECES, 8192, lambda r: len(r[5]) + 64, 1 << 22)

    return run


def split_piece(piece: bytes, lead: int, width: int, block: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first window, block, part, core): a piece by blocks of the distance from a window's start to its anchor.

    Equal windows are in one block. The core is what all windows at a block's distances have in common, so parts
    with different cores have no window in common.
    """
    windows = len(piece) - width + 1
    for q in range((lead - windows + 1) // block, lead // block + 1):
        first, last = max(0, lead - q * block - block + 1), min(windows - 1, lead - q * block)
        yield first, q, piece[first : last + width], piece[lead - q * block : lead - q * block - block + 1 + width]


def _split(width: int, block: int):
    """Pieces in parts, each under a hash of its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for h, a, b, lead, copies, piece in arrow_rows(batches, "h", "a", "b", "lead", "copies", "piece"):
                for first, q, part, core in split_piece(piece, lead, width, block):
                    key = xxhash.xxh64_intdigest(core, (h * 257 + q) & (2**64 - 1))
                    yield key - (1 << 64) if key >= 1 << 63 else key, *_digest(part), lead - first, copies, part, a, b, first

        yield from arrow_batches(rows(), PARTS, 8192, lambda r: len(r[5]) + 64, 1 << 22)

    return run


def _collections(width: int):
    """Builds the transforms of a partition sorted by h, a collection at a time, each of whole hashes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            for (a, b, shift, _), marks in zip(held, repeated_starts([x[3] for x in held], width), strict=True):
                edges = (np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))) + shift).tolist()
                for s, e in zip(edges[0::2], edges[1::2], strict=True):
                    yield a, b, s, e

        def rows():
            held, load, last = [], 0, None
            for h, a, b, shift, piece in arrow_rows(batches, "h", "a", "b", "shift", "piece"):
                if (h, a, b) == last:  # fetched from equal rows
                    continue
                if last is not None and h != last[0] and load >= COLLECTION:
                    yield from flush(held)
                    held, load = [], 0
                last = (h, a, b)
                held.append((a, b, shift, piece))
                load += len(piece)
            if held:
                yield from flush(held)

        yield from arrow_batches(rows(), schema)

    return run


def _remove(with_kept: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_kept else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, spans in arrow_rows(batches, "doc_id", "text", "spans"):
                data = (text or "").encode()
                joined: list[list[int]] = []
                for s in sorted((x["s"], x["e"]) for x in spans or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append([*s])
                kept, at = [], 0
                for s, e in joined:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                out = (doc_id, len(data), len(data) - len(rest), len(joined), hashlib.sha256(rest).hexdigest())
                yield (*out, rest) if with_kept else out

        yield from arrow_batches(rows(), schema, 1024, (lambda r: len(r[5])) if with_kept else None)

    return run


def _promising(pieces: DataFrame, width: int, block: int) -> DataFrame:
    """``pieces`` cut down to the blocks that may have a window in common with another piece, with their number under each hash.

    Two pieces with a common window have that block's core in common. A piece none of whose cores another has can't repeat
    anything and goes; the others keep the windows from their first such block to their last (``shift`` were before).
    """
    cores = stored(pieces.mapInArrow(_cores(width, block), "core long, h long, a long, b long, first int, stop int"))
    counted = cores.groupBy("core").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min("b").alias("low_b"), F.max("b").alias("high_b"), F.count("*").alias("rows"))
    shared = counted.where("low <> high OR low_b <> high_b").select("core", "rows")
    kept = with_keys(cores, shared, ["core"]).groupBy("h", "a", "b").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    kept = stored(kept)
    number = kept.groupBy("h").agg(F.count("*").alias("rows"))
    kept = with_keys(kept, number.select("h", "rows", F.col("rows").alias("pieces")), ["h"], "pieces")
    piece = F.col("piece").substr(F.col("first") + 1, F.col("stop") - F.col("first") + width - 1)
    return pieces.join(kept, ["h", "a", "b"]).select("h", "a", "b", (F.col("lead") - F.col("first")).cast("short").alias("lead"), "copies", piece.alias("piece"), F.col("first").alias("shift"), "pieces")


def _solve(pieces: DataFrame, width: int, most_pieces: int, blocks: tuple[int, ...]) -> DataFrame:
    """(a, b, s, e): runs of windows of the different ``pieces`` (PIECES, shift, pieces) that stand in others too."""
    few = pieces.where((F.col("pieces") > 1) & (F.col("pieces") <= most_pieces)).select("h", "a", "b", "shift", "piece")
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = few.repartition(parts, "h").sortWithinPartitions("h", "a", "b").mapInArrow(_collections(width), "a long, b long, s int, e int")
    many = pieces.where(F.col("pieces") > most_pieces)
    if not blocks or many.isEmpty():
        return found
    split = many.dropDuplicates(["h", "a", "b"]).select("h", "a", "b", "lead", "copies", "piece").mapInArrow(_split(width, blocks[0]), PARTS_SQL)
    split = stored(split)
    different = stored(split.groupBy("h", "a", "b").agg(F.first("lead").alias("lead"), F.sum("copies").alias("copies"), F.first("piece").alias("piece")))
    windows = F.octet_length("piece") - width + 1
    copied = different.where("copies > 1").select("a", "b", F.lit(0).alias("s"), windows.cast("int").alias("e"))
    number = different.groupBy("h").agg(F.count("*").alias("rows"))
    counted = with_keys(different, number.select("h", "rows", F.col("rows").alias("pieces")), ["h"], "pieces").withColumn("shift", F.lit(0))
    inner = copied.unionByName(_solve(counted, width, most_pieces, blocks[1:])).distinct()
    outer = many.select("a", "b", F.col("shift").alias("outer")).distinct()
    whole = split.select("a", "b", "of_a", "of_b", "shift").join(inner, ["a", "b"]).join(outer.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "outer"), ["of_a", "of_b"])
    at = F.col("shift") + F.col("outer")
    return found.unionByName(whole.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"), (F.col("s") + at).alias("s"), (F.col("e") + at).alias("e")))


def suffix_dedup(docs: DataFrame, width: int = 200, k: int = 32, most_pieces: int = 4096, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes (null: empty). Every byte covered by a string of ``width`` bytes that starts at another
    place too, of the same or another row, goes; overlaps count, and strings are judged on the input. n_spans
    counts the maximal removed runs; kept holds the other bytes (which may split a character). Rows that repeat a
    doc_id are texts of their own, so equal ones remove each other. Other columns are ignored; texts
    shorter than ``width`` stay whole; an empty table gives no rows. A very long text is scanned in parts.

    Equal pieces under a hash are one piece of the transform, with their number. A hash with more than ``most_pieces``
    different pieces is split by what blocks of 16 windows have in common, and then by single windows, which are equal or
    under different hashes; so no collection grows with a group of copies or with the texts around a frequent passage.
    Pieces that have no core in common with another are left out. Only digests are shuffled for all runs of windows; bytes
    are fetched for one of each different piece that shares its hash with others. Joins on hashes hold against frequent ones.
    """
    if width > 254 or k >= width or k & (k - 1):
        raise ValueError("width is at most 254, and k a power of two below it")
    if most_pieces > 1 << 15:  # so that a collection stays below 16 MB
        raise ValueError("a collection holds at most 32768 pieces of one hash")
    keyed = docs.select(*row_key("doc_id", "text"), "doc_id", "text")
    marks = stored(keyed.select("key_a", "key_b", "text").mapInArrow(_scan(width, k), MARKS_SQL))
    shared = marks.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1")
    places = stored(with_keys(marks, shared, ["h"]))
    one = [F.first(c).alias(c) for c in ("key_a", "key_b", "at", "n", "lead")]
    different = stored(places.groupBy("h", "a", "b").agg(F.count("*").alias("copies"), *one))
    copied = different.where("copies > 1").select("a", "b", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))
    several = different.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1")
    asked = with_keys(different, several, ["h"])
    asked = asked.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("h", "a", "b", "at", "n", "lead", "copies")).alias("asked"))
    pieces = stored(keyed.select("key_a", "key_b", "text").join(asked, ["key_a", "key_b"]).select("text", "asked").mapInArrow(_cut(width), PIECES_SQL), "zstd")
    likely = _promising(pieces, width, max(1, (width - k + 4) // 4))
    runs = stored(copied.unionByName(_solve(likely, width, most_pieces, (16, 1))))
    repeats = different.groupBy("a", "b").agg(F.sum("copies").alias("rows"))
    found = with_keys(places.select("key_a", "key_b", "at", "a", "b"), runs.join(repeats, ["a", "b"]), ["a", "b"], "s", "e")
    spans = found.select("key_a", "key_b", F.struct((F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e") + width - 1).alias("e")).alias("span"))
    spans = spans.groupBy("key_a", "key_b").agg(F.collect_set("span").alias("spans"))
    whole = keyed.join(spans, ["key_a", "key_b"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_remove(with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else ""))
