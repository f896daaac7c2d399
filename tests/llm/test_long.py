"""Texts of a megabyte and more, and runs without a boundary, through every operator, beside nulls and clashing columns."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tracelode.llm import embeddings, exact_dedup, language, line_dedup, mixing, packing, secrets, simhash, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rows long, h long, size int, path long, class string, rank int, used binary, part int, n_blocks long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else "") for _ in range(200_000))
    return {1: prose, 2: prose[:700_000] + " another end", 3: "a" * 1_200_000, 4: None, 5: "short text", 6: "MIIC" * 260_000 + " eyJ" + "b" * 300_000}


@pytest.fixture(scope="module")
def long(spark, texts):
    rows = [(i, t, "en", "s", 0, 1, 2, 3, 4, "c", 5, b"", 6, 7) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix(long, texts):
    found = by_id(suffix_dedup.suffix_dedup(long, with_kept=False))
    shared = len(texts[1][:700_000].encode())
    # what 1 and 2 share goes from both, with up to as many bytes as happen to continue alike
    assert shared <= found[1]["n_removed"] < shared + 3 and found[1]["n_spans"] == 1
    assert found[2]["n_bytes"] - found[2]["n_removed"] == len(texts[2].encode()) - found[1]["n_removed"]
    assert found[3]["n_removed"] == 1_200_000 and found[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[5]["n_removed"] == 0 and found[4]["n_bytes"] == 0 and found[6]["n_removed"] == 4 * 260_000 + 300_000 - 0 or found[6]["n_spans"] == 2


def test_lines(long, texts):
    found = by_id(line_dedup.digest_of_lines(long))
    assert all(found[i]["n_lines"] == (t or "").count("\n") + 1 and found[i]["n_dropped"] == 0 for i, t in texts.items())
    assert all(found[i]["kept_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items())


def test_simhash(long):
    found = by_id(simhash.simhash_dedup(long))
    assert len(found) == 6 and found[3]["component_id"] == 3 and found[4]["fp"] == 0


def test_packing(long, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(long).collect()
    for i in (1, 4, 5, 6):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_language(long, texts):
    found = by_id(language.language_id(long))
    assert found[4]["lang_pred"] == "und" and all(found[i]["lang_pred"] == "en" for i in (1, 2, 3, 6))
    assert language.accepted(long).columns == long.columns


def test_secrets_take_linear_time(long, texts):
    for text in (texts[6], "eyJ" + "x" * 1_000_000, "b3BlbnNzaC1rZXktdjEA" * 50_000, "-----BEGIN " + "A " * 500_000, "eyJ." * 250_000, "password" + " " * 1_000_000):
        began = time.process_time()
        secrets.base_spans(text), secrets.confirmed_spans(text)
        assert time.process_time() - began < 8
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"me"}', b"signature-bytes-here"))
    assert secrets.confirmed_spans(f"see www-some-host.example.{token} ok")[0][1] == 6
    assert len(by_id(secrets.secret_scan(long))) == 6


def test_embeddings_with_string_labels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5000))
    rows = [(i, [float(v) for v in x[i % 20] * (1 + i // 20)], "label" if i % 2 else "1.5", "c", 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, class string, path long, rows long")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_dedup(df, per_cell=4).collect()}
    assert found == {i: (1, i % 20) for i in range(40)}
    half = df.selectExpr("vec_id", "embedding", "double(vec_id % 2) / 2 AS label")
    assert {r["vec_id"]: r["component_id"] for r in embeddings.embedding_dedup(half).collect()} == {i: i % 20 for i in range(40)}


def test_token_counts(long, texts):
    import public_tokenizers

    _, counts = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = by_id(token_counts.edited_counts(long.where("doc_id NOT IN (3, 6)"), with_text=True))
    for i in (1, 4, 5):
        assert found[i]["n_tokens"] == len(counts.encode(texts[i] or ""))
        assert found[i]["tokens_after"] == len(counts.encode(found[i]["text_after"]))


def test_mixing(long, texts):
    found = by_id(mixing.taken_words(long))
    assert sum(r["taken"] for r in found.values()) == pytest.approx(found[1]["target"], abs=128)
    assert all(r["taken"] <= 2 * r["size"] for r in found.values())


def test_mixing_tells_equal_rows_apart(spark):
    text = " ".join(f"w{i}" for i in range(1500))
    rows = [(1, text, "en", "a", 1)] * 2 + [(1, text, "en", "b", 1), (1, text, "de", "b", 1), (2, " ".join(f"v{i}" for i in range(900)), "en", "c", 1), (None, text, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = sorted((r["doc_id"] or 0, r["target"], r["taken"]) for r in mixing.taken_words(df).collect() if r["taken"])
    mixed = sorted((r["doc_id"] or 0, len(r["text"].split())) for r in mixing.mixed_documents(df).collect())
    assert sorted((i, n) for i, _, n in taken) == mixed


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 120, f"s{i}") for i in range(9)] + [(99, "w " * 30000, "big")]
    found = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in found if r["size"] == 120)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 29, 58, 101, 4097])
def test_permutation_meets_every_block_in_a_mixed_order(spark, n):
    from pyspark.sql import functions as F

    places = [r[0] for r in spark.range(n).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(17), F.lit(n))).collect()]
    assert sorted(places) == list(range(n))
    if n > 20:
        assert len({(b - a) % n for a, b in zip(places, places[1:])}) > 5  # no plain rotation or stride


def test_exact(long, texts):
    found = by_id(exact_dedup.exact_dedup(long))
    assert all(r["kept"] and r["text_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in found.items())
