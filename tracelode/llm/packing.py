"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_batches, arrow_rows

#: Words whose tokens are kept, at most; then the store is emptied.
CACHE = 600_000
_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + k for k, b in enumerate(rest)}


class _Words(dict):
    """Little-endian ids of a lower-case word or sign by the tokenizer's merges; filled as words come up."""

    def __init__(self, tokenize):
        self.tokenize, self.letters = tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        tokens = self.tokenize(word.encode().decode("latin-1").translate(self.letters))
        self[word] = out = np.array([t.id for t in tokens], "<u4").tobytes()
        return out


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of a whole text by the word tokenizer at ``path``, without special tokens.

    The tokenizer lower-cases, drops white space and merges within words, so frequent words' ids are kept.
    In Latin-1 its normal form and classes are spelled out here; where a text has other characters or what may be
    a special token's string, the parts between plain spaces that hold them are encoded by the library itself.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    words = _Words(tokenizer.model.tokenize)
    letters, digits = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    find = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{letters}{digits}\t-\r \x85\xa0]+").findall
    beyond = re.compile("[^\x00-\xff]|<\\|").search
    lookup = words.__getitem__

    def encode(text: str) -> np.ndarray:
        if not beyond(text):
            return np.frombuffer(b"".join(map(lookup, find(text.lower()))), "<u4")
        out, plain = [], []
        for part in text.split(" "):
            if beyond(part):
                out += map(lookup, find(" ".join(plain).lower()))
                plain = []
                out.append(np.array(tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                plain.append(part)
        out += map(lookup, find(" ".join(plain).lower()))
        return np.frombuffer(b"".join(out), "<u4")

    _encoders[path] = encode
    return encode


def best_cuts(cuts: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Indexes into ``cuts`` of the cheapest division of [0, cuts[-1]) into windows.

    ``cuts`` are the places where a window may end, ascending from 0, no two more than ``window`` apart;
    ``costs`` are the penalties of cutting there. A window of n tokens is padded with window - n, or not at all
    where n is a power of two. best(j) = cost(j) + window - cut(j) + min over cut(i) >= cut(j) - window of
    best(i) + cut(i): a sliding minimum, held in a queue whose values ascend; windows of a power of two are tried beside it.
    """
    at, cost = cuts.tolist(), costs.tolist()
    n = len(at)
    index = {x: i for i, x in enumerate(at)}
    best, origin = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque()  # (best + cut, cut, index)
    powers = [p for p in (1 << k for k in range(13, -1, -1)) if p <= window]
    for j in range(1, n):
        i = j - 1
        value = best[i] + at[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at[i], i))
        here = at[j]
        while queue[0][1] < here - window:
            queue.popleft()
        least, source = queue[0][0] + window - here, queue[0][2]
        for p in powers:
            k = index.get(here - p)
            if k is not None and best[k] < least:
                least, source = best[k], k
        best[j], origin[j] = least + cost[j], source
    out, j = [], n - 1
    while j:
        out.append(j)
        j = origin[j]
    return out[::-1]


def candidates(lengths: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_cost: float, free_cost: float, free_every: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, and their penalties: 0 at documents' ends, then sentences, then any.

    Free cuts stand every ``free_every`` tokens, so that a stretch without sentences can be cut, and in a
    partition's last two windows everywhere, so that its end can be made of powers of two.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    free = np.arange(free_every, total, free_every)
    if last:
        free = np.concatenate([free, np.arange(max(1, total - 2 * window), total)])
    places = np.concatenate([[0], free, sentence_ends, ends]).astype(np.int64)
    costs = np.concatenate([[0.0], np.full(len(free), free_cost), np.full(len(sentence_ends), sentence_cost), np.zeros(len(ends))])
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    first = np.concatenate([[True], places[1:] != places[:-1]])
    return places[first], costs[first]


class _Packer:
    """Packs one partition's documents in their order, a stretch of about ``stretch`` tokens at a time."""

    def __init__(self, window: int, stretch: int, stops: list[int], costs: tuple[float, float, int]):
        self.window, self.stretch, self.stops, self.costs = window, stretch, np.array(stops, "<u4"), costs
        self.held: list[tuple[object, int, np.ndarray, int]] = []  # doc_id, start, ids, tokens of the document
        self.load = self.sequence = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for start in range(0, len(ids), self.stretch):  # a very long document spans several stretches
            part = ids[start : start + self.stretch]
            self.held.append((doc_id, start, part, len(ids)))
            self.load += len(part)
            if self.load >= self.stretch:
                yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Emits the pieces of the whole windows held; what follows the last but one cut waits for more."""
        if not self.held:
            return
        lengths = np.array([len(x[2]) for x in self.held])
        stream = np.concatenate([x[2] for x in self.held])
        stops = np.flatnonzero(np.isin(stream, self.stops)) + 1
        places, costs = candidates(lengths, stops, self.window, *self.costs, last)
        chosen = places[best_cuts(places, costs, self.window)]
        if not last and len(chosen) > 2:
            chosen = chosen[:-2]  # these windows may yet be better placed
        begin = d = inside = 0
        for end in chosen.tolist():
            offset = 0
            while begin < end:
                doc_id, start, ids, tokens = self.held[d]
                n = min(end - begin, len(ids) - inside)
                piece = ids[inside : inside + n]
                yield doc_id, start + inside, n, zlib.crc32(piece.tobytes()), tokens, self.sequence, offset, piece
                begin, offset, inside = begin + n, offset + n, inside + n
                if inside == len(ids):
                    d, inside = d + 1, 0
            self.sequence += 1
        rest = self.held[d:]
        if inside:
            doc_id, start, ids, tokens = rest[0]
            rest[0] = (doc_id, start + inside, ids[inside:], tokens)
        self.held, self.load = rest, sum(len(x[2]) for x in rest)


def pack(docs: DataFrame, window: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, stretch: int = 1 << 18, sentence_cost: float = 2.0, free_cost: float = 16.0, free_every: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of ``docs`` (doc_id, text).

    A document is its token ids and ``end_id``; a null or empty text is that id alone. Documents follow one another in
    the order in which their partition has them, and are cut into sequences of at most ``window`` tokens; each
    id lies in one piece, and a sequence's pieces are gapless from offset 0. Cuts minimise padding plus
    ``sentence_cost`` or ``free_cost`` where a document is cut after a sentence or elsewhere. Each partition
    is a stream of its own (sequence_id holds its number above 2**40, so it depends on how the table is partitioned) and ends in sequences of a power of two, which need no padding; nothing is shuffled, and a task holds
    one stretch; a very long document spans several. Repeated rows are packed each; other columns are ignored; an empty table gives no rows.
    """
    if window < 1 or window > 8192 or window & (window - 1):
        raise ValueError("window is a power of two up to 8192")
    free_every = min(free_every, window)
    path = tokenizer_path(tokenizer)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int64()))] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        stops = sorted({int(encode(x)[-1]) for x in (".", "a.", "!", "?")})
        base = TaskContext.get().partitionId() << 40
        packer = _Packer(window, stretch, stops, (sentence_cost, free_cost, free_every))

        def rows() -> Iterator[tuple]:
            for doc_id, text in arrow_rows(batches, "doc_id", "text"):
                yield from packer.add(doc_id, np.append(encode(text or ""), np.array([end_id], "<u4")))
            yield from packer.flush(last=True)

        def shaped() -> Iterator[tuple]:
            for r in rows():
                out = (*r[:5], base + r[5], r[6])
                yield (*out, r[7].tolist()) if with_ids else out

        yield from arrow_batches(shaped(), schema, weight=lambda r: r[2] * 8 if with_ids else 64)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, kinds + (", ids array<long>" if with_ids else ""))
