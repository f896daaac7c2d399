"""Every stage of the pipeline against brute force on its own input, and run() against the stages one after the other."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tracelode.llm import language, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAY = {
    "en": "the with through house and water people never again little morning under bridge should because",
    "de": "der und nicht straße auch wieder morgen unter brücke leute niemals wasser kleine häuser weil",
    "es": "que los mañana para calle nunca agua gente puente debajo pequeña casas porque otra vez",
}


def table():
    rng = random.Random(11)
    say = {k: v.split() for k, v in SAY.items()}

    def text(lang, n):
        return " ".join(rng.choice(say[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))

    rows = []
    for i in range(150):
        lang = list(SAY)[i % 3]
        rows.append((i, text(lang, rng.randrange(20, 400)), lang, f"s{i % 5 if i % 2 else 0}"))
    copy = rows[4][1]
    rows += [(200, copy, "de", "s1"), (201, copy, "de", "s2"), (3, copy, "de", None)]
    words = rows[7][1].split()
    rows += [(210 + k, " ".join(words[:-k] + ["zusatz"] * k), "de", "s3") for k in (1, 2, 3)]
    rows += [(220, "12345 ... 678", "en", "s1"), (221, None, "de", "s1"), (222, "", None, "s2"), (223, " \n\t", "es", None), (224, "½ ² Ⅷ", "en", "s1")]
    rows += [rows[11], rows[11], (None, text("es", 40), "es", "s4"), (None, rows[8][1], "es", "s4"), (11, text("en", 60), "en", "s0")]
    rows += [(300, text("en", 30000), "en", "s0"), (301, "nospace" * 30000, "en", None)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Each stage's input and output, as lists of rows."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        after = stage(spark, docs, folder).collect()
        out.append((name, before, after))
        docs = spark.createDataFrame(after, SCHEMA) if name != "packing" else None
    return {name: (before, [tuple(r) for r in after]) for name, before, after in out}


def spread(rows):
    return sorted(rows, key=repr)


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_language(spark, folder, steps):
    before, after = steps["language"]
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    want = []
    for r in before:
        lang, score = model.predict_all([r[1]])[0]
        assert (lang == "und") == (not any(c.isalpha() for c in r[1] or ""))
        if lang != "und" and score >= model.threshold:
            want.append(r)
    assert spread(after) == spread(want)
    assert {220, 221, 222, 223, 224} & {r[0] for r in after} == set()
    assert {r[0] for r in before if r[0] is not None and r[0] < 150} <= {r[0] for r in after}


def test_exact(steps):
    before, after = steps["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[r[1] or ""].append(r)
    assert sorted(r[1] or "" for r in after) == sorted(groups)
    for r in after:
        assert r in groups[r[1] or ""] and r[0] == max((x[0] for x in groups[r[1] or ""] if x[0] is not None), default=None)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near(steps):
    before, after = steps["near_dedup"]
    sets = [shingles(r[1]) for r in before]
    parent = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    groups = defaultdict(list)
    for i, p in enumerate(parent):
        groups[p].append(before[i])
    assert len(groups) < len(before) and len(after) == len(groups)
    for g in groups.values():
        kept = [r for r in after if r in g]
        assert len(kept) == 1 and kept[0][0] == min((r[0] for r in g if r[0] is not None), default=None)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_mixing(steps):
    before, after = steps["mixing"]
    size = Counter()
    for r in before:
        size[r[3]] += len(words_of(r[1]))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while left:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level >= 2 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    taken = Counter()
    for r in after:
        taken[r[3]] += len(words_of(r[1]))
        whole = max((Counter(words_of(b[1])) for b in before if b[0] == r[0] and b[3] == r[3]), key=lambda c: (Counter(words_of(r[1])) - (c + c)).total() * -1)
        assert not Counter(words_of(r[1])) - (whole + whole)  # nothing but the document's words, none more than twice
    assert all(abs(taken[s] - target[s]) <= 128 for s in names)
    assert all(r[4] == len(r[1]) for r in after)


def test_packing(steps):
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want, found, sequences, loose = Counter(), Counter(), defaultdict(list), 0
    for r in before:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids)] += len(ids)
    for doc_id, start, length, crc, tokens, sequence, offset in after:
        found[doc_id, tokens] += length
        sequences[sequence].append((offset, length))
    assert found == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        loose += 0 if at & (at - 1) == 0 else 4096 - at
    assert loose < 0.05 * sum(want.values())
    whole = {r[0]: r[1] for r in before if sum(x[0] == r[0] for x in before) == 1}
    for doc_id, start, length, crc, *_ in after:
        if doc_id in whole:
            ids = np.array([*tokenizer.encode(whole[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc


def test_run_is_the_stages(spark, folder, steps):
    found = corpus_pipeline.run(spark, folder).collect()
    by_doc = lambda rows: Counter((r[0], r[4]) for r in rows for _ in range(r[2]))
    assert by_doc([tuple(r) for r in found]) == by_doc(steps["packing"][1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
