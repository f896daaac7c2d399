"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_rows, stored

#: n-grams of a word with a mark at each end, from one character to as many.
LONGEST = 4
#: Words of the excerpts that a sampled text adds to itself.
EXCERPTS = (1, 3, 9)
#: Characters hashed at a time; a longer text is taken in parts of whole words where it has any.
PART = 1 << 16
_MIX = np.uint32(0x9E3779B1)
#: Marks that set n-grams of different length, and whole words, apart.
_SALT = np.array([0, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646C], np.uint32)
_POWERS = np.array([pow(0x01000193, i, 1 << 32) for i in range(PART + 2)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def marked(text: str) -> str:
    """A text's words in lower case, each between single spaces, which mark its ends."""
    return f" {' '.join(text.lower().split())} "


def _parts(words: str) -> Iterator[str]:
    """``words`` in parts of at most ``PART`` characters, cut at a mark, which both sides have; a longer word is cut inside."""
    at = 0
    while len(words) - at > PART:
        cut = words.rfind(" ", at + 1, at + PART)
        end = cut + 1 if cut > at else at + PART
        yield words[at:end]
        at = end - 1 if cut > at else end
    yield words[at:]


def features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of ``text`` (marked), place by place, and whether there is one.

    Subwords are a word's n-grams of 1 to ``LONGEST`` characters, its marks among them, and the word itself. All are hashed at
    once: row n - 1 has the n-grams by where they begin, the last row the words by where they end. ``buckets`` is a power of two.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, size = np.uint32(32 - (buckets.bit_length() - 1)), len(c)
    mark = c == 32
    ids, there = np.zeros((LONGEST + 1, size), np.uint32), np.zeros((LONGEST + 1, size), bool)
    rolled, inner = c, np.zeros(size, bool)
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if n > 2:  # no mark between the ends
                inner = inner[: len(rolled)] | mark[n - 2 : n - 2 + len(rolled)]
        here = slice(0, len(rolled))
        ids[n - 1, here] = ((rolled ^ _SALT[n]) * _MIX) >> shift
        there[n - 1, here] = ~mark if n == 1 else ~(mark[here] & mark[1 : len(rolled) + 1]) if n == 2 else ~inner[here]
    edges = np.flatnonzero(mark)
    first, last = edges[:-1], edges[1:]
    some = last - first > 1
    first, last = first[some], last[some]
    if len(first):
        length = last - first
        starts = np.repeat(first, length)
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        sums = np.add.reduceat(c[starts + inside] * _POWERS[inside], np.cumsum(length) - length, dtype=np.uint32)
        ids[LONGEST, last] = ((sums ^ _SALT[LONGEST + 1]) * _MIX) >> shift
        there[LONGEST, last] = True
    return ids, there


def counted(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A whole text's different buckets, ascending, and how often each occurs."""
    total = np.zeros(buckets, np.int64)
    for part in _parts(marked(text)):
        ids, there = features(part, buckets)
        total += np.bincount(ids[there], minlength=buckets)
    used = np.flatnonzero(total)
    return used, total[used]


def excerpts(text: str) -> list[str]:
    """A few words each from places that the text decides; they teach what little text can tell, and how much to trust it."""
    words = text.split()
    out = []
    for n in EXCERPTS:
        if len(words) > n:
            at = zlib.crc32(f"{n} {len(words)} {words[0]}".encode("utf-8", "surrogatepass")) % (len(words) - n)
            out.append(" ".join(words[at : at + n]))
    return [x for x in out if has_letter(x)]


@dataclass
class Model:
    """Sums over a text's subwords come from ``planes``: a number for each bucket, and a last one that is zero.

    Planes are the embeddings' dimensions, which ``weights`` turn into scores, or where languages are fewer, the scores
    themselves (``weights`` is None then); so a prediction's work is bounded by the smaller of both.
    """

    langs: list[str]
    planes: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: tuple[float, float]
    threshold: float

    @classmethod
    def of(cls, langs: list[str], embed: np.ndarray, weights: np.ndarray, *rest) -> Model:
        few = len(langs) <= embed.shape[1]
        planes = np.zeros((len(langs) if few else embed.shape[1], len(embed) + 1))
        planes[:, :-1] = (embed @ weights if few else embed).T
        return cls(langs, planes, None if few else weights, *rest)

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text (marked) the planes' sums over all its subwords, and their number."""
        out, held, load = np.zeros((len(texts), len(self.planes) + 1)), [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                if held and load + len(part) > PART:
                    self._add(held, out)
                    held, load = [], 0
                held.append((i, part))
                load += len(part)
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: np.ndarray) -> None:
        buckets = self.planes.shape[1] - 1
        ids, there = features("".join([p for _, p in held]), buckets)
        np.copyto(ids, np.uint32(buckets), where=~there)  # a plane's last value is zero
        sizes = np.array([len(p) for _, p in held])
        starts = np.cumsum(sizes) - sizes
        which = [i for i, _ in held]
        places = ids.astype(np.intp)
        for k, plane in enumerate(self.planes):
            rows = np.add.reduceat(plane[places], starts, axis=1)
            np.add.at(out[:, k], which, rows.sum(axis=0))
        np.add.at(out[:, -1], which, np.add.reduceat(there, starts, axis=1, dtype=np.int64).sum(axis=0))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ``und`` and 0 where it is null or has no letter, or nothing was learned."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        which = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if which:
            sums = self.sums([marked(texts[i]) for i in which])
            hidden = sums[:, :-1] / np.maximum(1.0, sums[:, -1:])
            z = (hidden if self.weights is None else hidden @ self.weights) + self.bias
            p = probabilities(z, sums[:, -1], self.temperature)
            for i, row in zip(which, p, strict=True):
                best = int(row.argmax())
                out[i] = self.langs[best], float(min(1.0, row[best]))
        return out

    def accepts(self, lang: str, score: float) -> bool:
        return lang != "und" and score >= self.threshold


def probabilities(z: np.ndarray, subwords: np.ndarray, temperature: tuple[float, float]) -> np.ndarray:
    """Softmax at a temperature that is higher for fewer subwords: its first number, times 1 + the second over their count."""
    t = temperature[0] * (1 + temperature[1] / np.maximum(1.0, subwords))
    e = np.exp((z - z.max(axis=1, keepdims=True)) / t[:, None])
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Samples:
    """Whole texts and excerpts one after the other: each has a language, the number of its document, and a stretch of buckets and counts."""

    langs: list[str]
    docs: np.ndarray
    whole: np.ndarray
    ends: np.ndarray
    used: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, bool, bytes]]) -> Samples:
        """From (lang, document, whole, packed): buckets, then counts, little-endian 32-bit numbers under zlib."""
        langs, docs, whole, packed = ([r[i] for r in rows] for i in range(4))
        pairs = [np.frombuffer(zlib.decompress(p), "<u4").reshape(2, -1) for p in packed]
        used = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint32)
        times = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint32)
        return cls(langs, np.array(docs, np.int64), np.array(whole, bool), np.cumsum([p.shape[1] for p in pairs], dtype=np.int64), used, times)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
        return self.used[at], self.times[at]


def train(samples: Samples, buckets: int = 1 << 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """A model from whole texts and excerpts, by stochastic gradient descent over the embeddings and the softmax.

    A fifth of the samples sets the temperatures that make scores probabilities, and the rejection threshold: half the
    score that all but one in a hundred of the whole texts' right predictions exceed. Buckets never met stay zero, so a text
    of unknown characters scores as little as chance, and is rejected.
    """
    langs = sorted(set(samples.langs))
    if not langs:
        return Model([], np.zeros((0, 2)), None, np.zeros(0), (1.0, 0.0), 0.0)
    rng = np.random.default_rng(seed)
    kinds = np.array([langs.index(k) for k in samples.langs])
    documents = rng.permutation(int(samples.docs.max()) + 1)
    checks = np.isin(samples.docs, documents[: len(documents) // 5])
    check, learn = np.flatnonzero(checks), np.flatnonzero(~checks)
    met = np.zeros(buckets, bool)
    for i in learn:
        met[samples.row(i)[0]] = True
    embed = rng.normal(0, 1 / dim, (buckets, dim)) * met[:, None]
    w, b = np.zeros((dim, len(langs))), np.zeros(len(langs))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            step = rate * (1 - done / steps)
            done += 1
            (ids, times), k = samples.row(i), kinds[i]
            weight = times / times.sum()
            hidden = weight @ embed[ids]
            p = hidden @ w + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[k] -= 1
            back = w @ p
            w -= step * np.outer(hidden, p)
            b -= step * p
            embed[ids] -= step * min(len(ids), 1024) ** 0.5 * np.outer(weight, back)
    temperature, threshold = (1.0, 0.0), 0.0
    if len(check):
        size = np.array([samples.row(i)[1].sum() for i in check])
        z = np.array([(t / t.sum()) @ (embed[ids] @ w) + b for ids, t in map(samples.row, check)])
        truth, whole = kinds[check], samples.whole[check]
        loss = lambda t: -np.log(probabilities(z, size, t)[np.arange(len(truth)), truth] + 1e-12).sum()
        temperature = min(((float(t), float(c)) for t in np.geomspace(0.02, 5, 24) for c in (0, 10, 30, 100, 300, 1000)), key=loss)
        p = probabilities(z, size, temperature)
        right = p.max(axis=1)[(p.argmax(axis=1) == truth) & whole]
        if len(right):
            threshold = float(np.quantile(right, 0.01)) / 2
    return Model.of(langs, embed, w, b, temperature, threshold)


#: Rows that are never learned from.
HELD_OUT = "crc32(cast(doc_id AS string)) % 4 = 2"


def fit(docs: DataFrame, sample_rows: int = 2000, buckets: int = 1 << 16) -> Model:
    """A model of ``docs`` (doc_id, text, lang), from a sample of bounded size: up to ``sample_rows`` labelled rows, whole texts.

    Every language gives the same number of rows, or all it has; where there are more languages than ``sample_rows``, the most
    frequent give one each. Rows are drawn by hash of doc_id. A task makes a row's text, whatever its length, at most ``buckets``
    counts, and those of a few excerpts; these go to the driver. Rows whose crc32(doc_id as text) mod 4 is 2, whose doc_id is null or whose text has no letter
    are never learned from.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.expr(HELD_OUT))
    counts = usable.groupBy("lang").agg(F.count("*").alias("all")).orderBy(F.desc("all"), "lang").limit(sample_rows)
    counts = stored(counts)  # one row a language, ``sample_rows`` at most
    quota = max(1, sample_rows // max(1, counts.count()))
    # the share drawn by hash is a little above what is wanted, so that few rows are sorted however many there are
    share = F.least(F.lit(1.0), (1.2 * quota + 20) / F.col("all"))
    drawn = usable.select(F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("h"), "doc_id", "text", "lang").join(F.broadcast(counts), "lang").where(F.col("h") <= share * float(1 << 53))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    chosen = drawn.withColumn("rank", rank).where(F.col("rank") <= quota)
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for h, doc_id, lang, text in arrow_rows(batches, "h", "doc_id", "lang", "text"):
                if has_letter(text):
                    for k, part in enumerate([text, *excerpts(text)]):
                        used, times = counted(part, buckets)
                        yield h, doc_id, lang, k, zlib.compress(used.astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)

        yield from arrow_batches(rows(), schema, 64)

    found = chosen.select("h", "doc_id", "lang", "text").mapInArrow(run, "h long, doc_id long, lang string, part int, packed binary").collect()
    rows, number, last = [], -1, None
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["part"], r["packed"])):
        if r["part"] == 0 or (r["lang"], r["doc_id"]) != last:
            number += 1
        last = (r["lang"], r["doc_id"])
        rows.append((r["lang"], number, r["part"] == 0, bytes(r["packed"])))
    del found
    samples = Samples.of(rows)
    del rows
    return train(samples, buckets)


def _predictions(batch: pa.RecordBatch, model: Model, at_once: int = 256) -> Iterator[tuple[int, list[tuple[str, float]]]]:
    """(first row, predictions) of a batch's texts, some rows at a time."""
    column = batch.column(batch.schema.get_field_index("text"))
    for start in range(0, batch.num_rows, at_once):
        yield start, model.predict_all(column.slice(start, at_once).to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text), from whole texts.

    lang_pred is a learned language, or ``und`` with score 0 where text is null or has no letter. A row is
    rejected if it is ``und`` or its score is below the model's threshold. Nothing but the text is read;
    repeated rows get equal results; very long texts are taken in parts; an empty table gives no rows. The model is bounded by its
    buckets and languages.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for start, found in _predictions(batch, model):
                columns = [k for k, _ in found], [x for _, x in found], [not model.accepts(k, x) for k, x in found]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(found)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text, lang), as ``fit`` and ``identify`` say.

    held_out is false where doc_id is null. A table without labelled rows gives ``und`` throughout.
    """
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) that identification does not reject, with all their columns, in one pass.

    Null texts, and those without a letter, are rejected, however many columns they fill; equal rows are all kept or all
    rejected; very long texts are judged whole; an empty table gives no rows, and one without labelled rows keeps none.
    """
    model, schema = fit(docs), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.accepts(k, x) for _, found in _predictions(batch, model) for k, x in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
