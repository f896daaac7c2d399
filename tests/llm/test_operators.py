"""The operators against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import embeddings, exact_dedup, language, line_dedup, mixing, packing, secrets, simhash, suffix_dedup, token_counts
from tracelode.llm.components import components

WORDS = ["the", "of", "and", "river", "stone", "über", "ñandú", "Σigma", "winter", "glass", "paper", "orbit", "lamp", "quiet"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, positions int, key_a string, n string, lines string, h string, spans string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = "This exact line of boilerplate stands in a good many of the documents."
    passage = sentence(rng, 60)
    rows = []
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5)))
        if i % 5 == 0:
            text += "\n  " + shared.upper() + "\t\n" + sentence(rng, 4)
        if i % 7 == 0:
            text = text[:30] + passage + text[30:]
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}"))
    near = rows[3][1] + " " + sentence(rng, 80)
    rows += [(100, near, "en", "s1"), (101, near + " end", "en", "s1"), (102, near, "en", "s9"), (103, near.replace("lamp", "lump", 1), "en", None)]
    rows += [(104, None, "en", "s1"), (105, "", None, "s2"), (106, " \n\t ", "de", None), (107, sentence(rng, 6000), "en", "s0"), (108, "x" * 5000, "en", "s0"), (None, "no id at all " * 4, "en", "s1")]
    rows += [rows[9], rows[9], (9, "another text under the same id", "en", "s1")]
    return [(i, t, lang, s, len(t or ""), 1, "a", "b", "c", "d", "e") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs, none):
    texts = [(r[0], r[1] or "") for r in corpus()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    assert rows_of(exact_dedup.exact_dedup(docs, fan_in=2)) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_line_dedup(docs, none):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    texts = [(r[0], r[1] or "") for r in corpus()]
    held = defaultdict(list)
    for n, (i, t) in enumerate(texts):
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                held[k].append((n, i))
    gone = {k: max(i for _, i in v if i is not None) for k, v in held.items() if len(v) >= 5}
    want = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert any(w[2] for w in want)
    assert rows_of(line_dedup.digest_of_lines(docs)) == sorted(want, key=repr)
    assert line_dedup.digest_of_lines(none).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, none, bucket):
    rows = corpus()
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in set(groups)}
    want = [(rows[i][0], f"{prints[i]:016x}", least[groups[i]]) for i in range(len(rows))]
    found = simhash.simhash_dedup(docs, bucket=bucket).select("doc_id", simhash.hex_of(simhash.F.col("fp")), "component_id")
    assert rows_of(found) == sorted(want, key=repr)
    assert simhash.simhash_dedup(none).count() == 0


@pytest.mark.parametrize("bucket", [2, 1000])
@pytest.mark.parametrize("most_bits", [1, 2])
def test_simhash_links_of_a_large_group(spark, bucket, most_bits):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(150)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    want = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= most_bits)
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most_bits, bucket)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    labels = [found.get(s, s) for s in signed]
    assert len(set(zip(want, labels, strict=True))) == len(set(want)) == len(set(labels))


def test_posting_sets_cover_two_differing_bytes():
    for a in range(8):
        for b in range(8):
            assert any(a not in s and b not in s for s in simhash.postings())


def check_packing(rows, texts, window=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(r["length"] for r in rows)


def test_packing(spark, none):
    texts = {r[0]: r[1] or "" for r in corpus()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert check_packing(packing.pack(df).collect(), texts) < 0.05
    assert check_packing(packing.pack(df, window=64, stretch=500).collect(), texts, 64) < 0.2
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 1000))
def test_cuts_are_the_cheapest(gaps, seed):
    rng = np.random.default_rng(seed)
    cuts = np.concatenate([[0], np.cumsum(gaps)])
    costs = rng.integers(0, 9, len(cuts)).astype(float)
    window, n = 16, len(cuts)
    best = [0.0] + [float("inf")] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            size = cuts[j] - cuts[i]
            if size <= window:
                best[j] = min(best[j], best[i] + costs[j] + (0 if size & (size - 1) == 0 else window - size))
    chosen = packing.best_cuts(cuts, costs, window)
    total, before = 0.0, 0
    for j in chosen:
        size = cuts[j] - cuts[before]
        total += costs[j] + (0 if size & (size - 1) == 0 else window - size)
        before = j
    assert before == n - 1 and abs(total - best[-1]) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abXY '’s.,!09<|>\n\t\x0b\x85\xa0éßµ½Σİ中éſ👍")) | st.characters(), max_size=30))
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert packing.encoder(packing.tokenizer_path())(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_language(spark, docs, none):
    rng = random.Random(3)
    say = {"en": ["the", "with", "through", "house", "that"], "de": ["der", "und", "nicht", "straße", "auch"], "es": ["que", "los", "mañana", "para", "calle"]}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(rng.randrange(4, 40))), k) for i, k in enumerate(list(say) * 120)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 ... 456", "es"), (None, "the house", "en"), (903, "der " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.language_id(df).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i]["lang_pred"] == k for i, _, k in held) / len(held) > 0.97
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"] for i in (900, 901, 902))
    assert found[903]["lang_pred"] == "de" and found[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.language_id(none).count() == 0
    assert language.accepted(df).where("doc_id IN (900, 901, 902)").count() == 0
    assert language.accepted(df).where("doc_id < 900").count() >= 0.97 * 360
    assert language.language_id(docs).count() == docs.count()


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_secrets(spark, docs, none):
    import base64

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7] * 64)) for _ in range(8)))
    text64 = base64.b64encode(key).decode()
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"me"}', b"signature-bytes-here"))
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(secrets.SSH_MAGIC + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"public" * 9) + string(b"private" * 9)).decode()
    texts = [
        f"a {text64} b",
        f"-----BEGIN RSA PRIVATE KEY-----\n{text64[:64]}\n{text64[64:]}\n-----END RSA PRIVATE KEY-----",
        f"see {token} ok",
        f"k={ssh}",
        key.hex(),
        base64.b64encode(key[:-3] + b"xxxx").decode(),
        "Password: hunter22 API_key='abcdef' secret=token: abcdefgh toKen=abc",
        "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " " + "0a" * 12 + " " + "f" * 23,
        "ſecret=abcdefgh paKword:zzzzzzz",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.secret_scan(df).collect()}
    kinds = lambda i: {s.split(":")[0] for s in found[i]["spans"].split(",") if s}
    assert "der_key" in kinds(0) and "pem_key" in kinds(1) and "signed_token" in kinds(2) and "ssh_key" in kinds(3) and "der_key" in kinds(4)
    assert found[5]["n_confirmed"] == 0 and found[8]["n_assign"] == 0
    assert (found[6]["n_assign"], found[7]["n_access"], found[7]["n_hex"]) == (2, 1, 1)
    assert found[9]["base_sha256"] == found[10]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[10]["spans"] == ""
    for i, t in enumerate(texts):
        spans = []
        for k, pattern in enumerate((r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)")):
            spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if len(m[1]) >= (6, 20, 24)[k]]
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
    assert secrets.secret_scan(none).count() == 0 and secrets.secret_scan(docs).count() == docs.count()


@pytest.mark.parametrize(("per_cell", "block"), [(512, 1024), (6, 4)])
def test_embeddings(spark, per_cell, block):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        c = i % 5
        v = np.eye(8)[c] + rng.normal(0, 0.12 if i % 2 else 0.4, 8)
        rows.append((i, [float(np.float32(x)) for x in v], c % 2))
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(12)] + [(300, rows[3][1], None), (301, None, 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, [1.0, None], 1), (305, [], 0), (306, [1.0, 2.0], 1), (307, [float("inf")] + [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, links string, n int")
    usable = {i: np.array(v, float) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    ids = sorted(usable)
    near = lambda a, b: label[a] == label[b] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / np.sqrt((usable[a] @ usable[a]) * (usable[b] @ usable[b])) >= 0.93
    groups = groups_of(ids, near)
    want = []
    for i, *_ in rows:
        if i in usable:
            root = ids[groups[ids.index(i)]]
            want.append((i, sum(near(i, j) for j in ids if j != i), root, root == i))
        else:
            want.append((i, 0, i, True))
    assert rows_of(embeddings.embedding_dedup(df, per_cell=per_cell, block=block)) == sorted(want, key=repr)
    assert embeddings.embedding_dedup(df.limit(0)).count() == 0


@settings(max_examples=250, deadline=None)
@given(st.text(st.sampled_from(list("ab's \n.12é")), max_size=200), st.data())
def test_tree_after_edits(text, data):
    import public_tokenizers

    split, counts = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    token_counts.LEAF, leaf = 3, token_counts.LEAF
    try:
        tree = token_counts.Tree(text, split, counts)
        for _ in range(4):
            start = data.draw(st.integers(0, len(text)))
            end = data.draw(st.integers(start, min(len(text), start + 9)))
            new = data.draw(st.text(st.sampled_from(list("ab' s\n1")), max_size=6))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == sum(counts[p] for p in split(text))
    finally:
        token_counts.LEAF = leaf


def test_token_counts(spark, docs, none):
    df = spark.createDataFrame([(1, "Write to a.b@example.com or +49 (0) 30 1234567 today. " * 40), (2, None), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_counts.edited_counts(df, with_text=True).collect()}
    import public_tokenizers

    _, counts = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert found[1]["n_edits"] == 80 and "@" not in found[1]["text_after"]
    assert found[1]["tokens_after"] == len(counts.encode(found[1]["text_after"]))
    assert found[2]["n_tokens"] == found[3]["n_tokens"] == found[2]["tokens_after"] == 0
    assert token_counts.edited_counts(none).count() == 0 and token_counts.edited_counts(docs).count() == docs.count()


def test_mixing(docs, none):
    rows = corpus()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = defaultdict(int)
    for r in rows:
        sources[r[3]] += size(r[1])
    names = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(names)
    while True:
        level = (1.5 * sum(sources.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level >= 2 * sources[s]]
        if not over:
            break
        target |= {s: 2.0 * sources[s] for s in over}
        left -= set(over)
    target |= {s: weight[s] * level for s in left}
    found = mixing.taken_words(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["size"]) for r in found))) == sorted(map(repr, ((r[0], size(r[1])) for r in rows)))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_target = defaultdict(int)
    for r in found:
        by_target[round(r["target"], 6)] += r["taken"]
    want = defaultdict(float)
    for s in names:
        want[round(target[s], 6)] += target[s]
    assert set(by_target) == set(want) and all(abs(by_target[t] - want[t]) <= 128 for t in want)
    assert rows_of(mixing.taken_words(docs)) == sorted((tuple(r) for r in found), key=repr)
    assert mixing.taken_words(none).count() == 0
    words = Counter()
    for r in mixing.mixed_documents(docs.where("doc_id <> 9")).collect():
        words[r["doc_id"]] += size(r["text"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs.where("doc_id <> 9")).collect()}
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_block_permutation_takes_all_blocks(spark):
    sources = spark.createDataFrame([(1, 1000, 2000.0), (2, 640, 320.0), (3, 0, 0.0)], "source_rank long, source_size long, target double")
    uses = Counter((r["source_rank"], r["block"]) for r in mixing.manifest(sources, 10, 3).collect())
    assert [uses[1, b] for b in range(100)] == [2] * 100
    assert sum(n for (s, _), n in uses.items() if s == 2) == 32 and max(n for (s, _), n in uses.items() if s == 2) == 1


def brute_suffix(texts, width):
    counts = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if counts[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("width", "k", "most"), [(200, 32, 512), (60, 16, 1), (60, 16, 3)])
def test_suffix_dedup(spark, docs, none, width, k, most):
    rows = corpus()
    want = [(r[0], *w) for r, w in zip(rows, brute_suffix([(r[1] or "").encode() for r in rows], width), strict=True)]
    found = suffix_dedup.suffix_dedup(docs, width, k, most)
    assert rows_of(found.drop("kept")) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=9), st.integers(1, 6))
def test_repeated_starts(pieces, width):
    counts = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
    for p, marks in zip(pieces, suffix_dedup.repeated_starts(pieces, width), strict=True):
        assert marks.tolist() == [counts[p[i : i + width]] > 1 for i in range(len(p) - width + 1)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    linked = {frozenset(e) for e in edges}
    groups = groups_of(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert found == {n: nodes[g] for n, g in zip(nodes, groups, strict=True)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


