"""Edit-aware token counts: a tree of pre-token segments per document, re-encoded only where edits touch."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_batches, arrow_rows

#: Pre-tokens of a leaf as it is built.
LEAF = 64
#: Pre-tokens whose counts are kept, at most; then the store is emptied.
CACHE = 500_000


class _Counts(dict):
    """Tokens of a pre-token by a rank file's merges; filled as they come up."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> tuple[Callable[[str], list[str]], _Counts]:
    """The split into pre-tokens, and their counts, of a tiktoken rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(public_tokenizers.PATTERN).findall, _Counts(encoding.encode_ordinary)


class Tree:
    """A document's pre-tokens in leaves of up to twice ``LEAF``, with sums of characters and tokens above them.

    ``chars`` and ``tokens`` are the levels of a binary segment tree, leaves first. An edit re-splits the text from
    a pre-token's start a little before it up to the first old boundary that holds after it; only those pre-tokens are
    encoded, and only the sums above their leaves are updated. A leaf that grows beyond its bound is dealt out to new ones,
    which rebuilds the levels; that takes as many new pre-tokens as a leaf has, so edits stay cheap however many there are.
    """

    def __init__(self, text: str, split: Callable[[str], list[str]], counts: _Counts):
        self.split, self.counts = split, counts
        self.encoded = 0  # pre-tokens encoded again by edits
        pieces = split(text)
        self._build([pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]])

    def _build(self, leaves: list[list[str]]) -> None:
        self.leaves = leaves
        self.chars = self._levels([sum(map(len, p)) for p in leaves])
        self.tokens = self._levels([sum(map(self.counts.__getitem__, p)) for p in leaves])

    @staticmethod
    def _levels(leaves: list[int]) -> list[np.ndarray]:
        levels = [np.array(leaves, np.int64)]
        while len(levels[-1]) > 1:
            low = levels[-1]
            if len(low) % 2:
                low = np.append(low, 0)
            levels.append(low.reshape(-1, 2).sum(axis=1))
        return levels

    @property
    def total(self) -> int:
        return int(self.tokens[-1][0])

    @property
    def length(self) -> int:
        return int(self.chars[-1][0])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the character where it starts."""
        i, before = 0, 0
        for level in self.chars[-2::-1]:
            i *= 2
            if at - before >= level[i] and i + 1 < len(level):
                before += int(level[i])
                i += 1
        return i, before

    def _set(self, i: int, pieces: list[str], tokens: int) -> None:
        self.leaves[i] = pieces
        for levels, value in ((self.chars, sum(map(len, pieces))), (self.tokens, tokens)):
            step, j = value - int(levels[0][i]), i
            for level in levels:
                level[j] += step
                j //= 2

    def text(self) -> str:
        return "".join("".join(p) for p in self.leaves)

    def _from(self, leaf: int, inside: int) -> Iterator[tuple[int, int, str]]:
        """(leaf, place, pre-token) from a place in a leaf on."""
        for i in range(leaf, len(self.leaves)):
            for k in range(inside if i == leaf else 0, len(self.leaves[i])):
                yield i, k, self.leaves[i][k]

    def _context(self, start: int) -> tuple[int, int, int]:
        """(leaf, place, character) of the pre-token before the one that holds the character ahead of ``start``."""
        leaf, at = self.find(max(0, start - 1))
        place = 0
        while place < len(self.leaves[leaf]) - 1 and at + len(self.leaves[leaf][place]) < start:
            at += len(self.leaves[leaf][place])
            place += 1
        if place:
            return leaf, place - 1, at - len(self.leaves[leaf][place - 1])
        earlier = leaf - 1
        while earlier >= 0 and not self.leaves[earlier]:
            earlier -= 1
        if earlier < 0:
            return leaf, 0, at
        return earlier, len(self.leaves[earlier]) - 1, at - len(self.leaves[earlier][-1])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) by ``new``.

        What stands before a pre-token's start decides nothing about the split after it, except that a run of white
        space gives its last character to what follows: so the split is taken up one pre-token before the one that
        touches ``start``. It holds as soon as it meets an old boundary at or past ``end``; the last two pre-tokens of a stretch
        that is cut short may change with what follows them, so they don't count.
        """
        first, place, begin = self._context(start)
        ahead, at, old, bounds = self._from(first, place), begin, [], {}
        want, ended = 4, False
        while True:
            while not ended and want:  # some more old pre-tokens, with their ends past the edit
                step = next(ahead, None)
                if step is None:
                    ended = True
                    break
                i, k, piece = step
                old.append(piece)
                at += len(piece)
                if at >= end:
                    bounds[at - end + start + len(new)] = (i, k, len(old))
                    want -= 1
            whole = "".join(old)
            pieces = self.split(whole[: start - begin] + new + whole[end - begin :])
            upto, here, held = len(pieces) if ended else len(pieces) - 2, begin, None
            for n, piece in enumerate(pieces[: max(0, upto)]):
                here += len(piece)
                if here >= start + len(new) and here in bounds:
                    held = n + 1, bounds[here]
                    break
            if held:
                pieces, (last, k, _) = pieces[: held[0]], held[1]
                break
            if ended:
                last, k = len(self.leaves) - 1, len(self.leaves[-1]) - 1
                break
            want = 2 * len(old)
        self.encoded += len(pieces)
        joined = self.leaves[first][:place] + pieces + self.leaves[last][k + 1 :]
        if len(joined) > 2 * LEAF:
            fresh = [joined[i : i + LEAF] for i in range(0, len(joined), LEAF)]
            self._build(self.leaves[:first] + fresh + self.leaves[last + 1 :])
            return
        gone = self.leaves[first][place:] if last > first else self.leaves[first][place : k + 1]
        tokens = int(self.tokens[0][first]) + sum(map(self.counts.__getitem__, pieces)) - sum(map(self.counts.__getitem__, gone))
        if last > first:
            tokens += sum(map(self.counts.__getitem__, self.leaves[last][k + 1 :]))
        self._set(first, joined, tokens)
        for i in range(first + 1, last + 1):
            self._set(i, [], 0)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of mail addresses and long digit runs, the edits that a redaction makes."""
    return [(m.start(), m.end(), "<mail>" if "@" in m[0] else "<number>") for m in _PERSONAL(text)]


_PERSONAL = regex.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?\d[\d() -]{7,}\d").finditer


def edited_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", edits: Callable[[str], list[tuple[int, int, str]]] = redactions, with_text: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_edits, n_encoded, chars_after, tokens_after[, text_after]) per row of ``docs`` (doc_id, text).

    n_tokens counts the whole text; ``edits`` (ascending, not overlapping, in the text's characters) are then applied from the last to
    the first to its tree, of which n_encoded pre-tokens were encoded again; the counts after are those of the
    edited text. Null and empty texts have none; a very long text is one tree in its task. Repeated rows get equal results; an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path(tokenizer)
    names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_encoded", "chars_after", "tokens_after"]
    schema = pa.schema([(n, pa.int64()) for n in names] + ([("text_after", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = counter(path)

        def rows():
            for doc_id, text in arrow_rows(batches, "doc_id", "text"):
                tree = Tree(text or "", split, counts)
                before, changes = tree.total, edits(text or "")
                for start, end, new in reversed(changes):
                    tree.edit(start, end, new)
                out = (doc_id, len(text or ""), before, len(changes), tree.encoded, tree.length, tree.total)
                yield (*out, tree.text()) if with_text else out

        yield from arrow_batches(rows(), schema, weight=lambda r: len(r[7]) if with_text else 56)

    kinds = ", ".join(f"{n} long" for n in names) + (", text_after string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
