"""The pipeline's near stage, and run() as a whole, against brute force."""

import os
import random

import pytest

import corpus_pipeline
from tracelode.llm import common, language, mixing, near_dedup, packing

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def corpus():
    rng = random.Random(3)
    texts = []
    for size in (8, 60, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            texts += [edited(rng, base, n) for n in (0, 0, 1, 2, 4, 5, 9)]
    large = [f"v{rng.randrange(3000)}" for _ in range(120)]
    texts += [edited(rng, large, rng.randrange(6)) for _ in range(40)]
    texts += [None, "", " \n", "one two", "ONE  two", "one two three four five six", "x " * 400]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, rows[9][1], "en", "s", 1), (None, "no id " * 5, "en", "s", 1)]


def brute(rows):
    sets = [sets_of(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for r, g in zip(rows, group, strict=True):
        ids.setdefault(g, []).append(r[0])
    return sorted((min((i for i in v if i is not None), default=None) for v in ids.values()), key=repr)


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_dedup(spark, bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = near_dedup.near_dedup(docs, corpus_pipeline.COLUMNS, bucket).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == brute(rows)
    assert near_dedup.near_dedup(docs.where("false"), corpus_pipeline.COLUMNS).count() == 0


def test_near_stage_links_what_two_bits_do_not(spark):
    rows = corpus()
    found = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    copies = [(10**6 + r[0], r[1] + " and some words more", *r[2:]) for r in rows[:40]] + [(10**7 + r[0], *r[1:]) for r in rows[:5]]
    spark.createDataFrame(rows + copies, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    accepted = [tuple(r) for r in language.accepted(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    last = {}
    for r in sorted(accepted, key=lambda r: r[0]):
        last[r[1] or ""] = r
    keep = set(brute(list(last.values())))
    assert len(keep) < len(last) < len(accepted)
    mixed = mixing.mixed_documents(spark.createDataFrame([r for r in last.values() if r[0] in keep], docs.schema)).collect()
    encode = packing.encoder(packing.tokenizer_path())
    want = sorted((r["doc_id"], len(encode(r["text"] or "")) + 1) for r in mixed)
    found = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(tuple(r) for r in found) == want


def test_large_postings_in_blocks(spark, monkeypatch):
    """A group of near copies whose postings are cut into many pairs of blocks stays one group, and others stay out of it."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base[:30] + [f"y{rng.randrange(500)}" for _ in range(90)])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in near_dedup.near_dedup(df, ["doc_id", "text"], bucket=4).collect())
    assert found == [0, *range(100, 106)]


def folders(spark):
    return set(os.listdir(common.own_folder(spark).removeprefix("file://")))


def test_disk_is_given_back_and_one_tree_moves_once(spark, monkeypatch):
    """What the stage stored on its way is gone, and postings of texts that are one tree already are not moved again."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    moved, plain = [], near_dedup._forests
    monkeypatch.setattr(near_dedup, "_forests", lambda large: moved.append(large.count()) or plain(large))
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(24)]
    df, before = spark.createDataFrame(rows, "doc_id long, text string"), folders(spark)
    found = near_dedup.near_dedup(df, ["doc_id", "text"], bucket=4)
    assert [r["doc_id"] for r in found.collect()] == [0]
    assert len(folders(spark) - before) <= 3
    assert sum(moved) == 0


def test_part_by_part(spark, monkeypatch):
    """Pairs and postings compared in many parts give the same groups."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "PART", 0.3)
    rows = corpus()
    found = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), corpus_pipeline.COLUMNS, 2).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == brute(rows)


def test_simhash_links_come_first(spark, monkeypatch):
    """What SimHash links is verified first, also where a text has a nearer one, and what it connects isn't looked at again."""
    asked, plain = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda texts, pairs, room: asked.append({(r["u"], r["v"]) for r in pairs.collect()}) or plain(texts, pairs, room))
    base = [f"w{i}" for i in range(200)]
    # a chain: each text is nearest to the one before it
    texts = spark.createDataFrame([(i, " ".join([f"x{j}" for j in range(i)] + base[i:])) for i in range(1, 6)], "node long, text string")
    star = [(1, v) for v in range(2, 6)]
    monkeypatch.setattr(near_dedup, "simhash_pairs", lambda texts: spark.createDataFrame(star, "u long, v long"))
    near_dedup.links(texts).collect()
    first, second = asked
    assert set(star) <= first and not second
