"""Pieces, fingerprints, personal data, quality and mixing: brute force, round trips, held-out accuracy and odd tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("wardline.llm")
from wardline.llm import fingerprint, mixing, pieces, pii, quality

DOCS = "doc_id long, text string, source string, lang string, n_chars long, score string, size string"
ODD = [
    (None, None, None, None, None, "x", "y"), (1, "", "a", "en", 0, None, None), (2, "same text here", "a", "en", 1, "", ""), (2, "same text here", "a", "en", 1, "", ""),
    (3, "same text here", None, "de", 1, "", ""), (4, "wordy " * 4000, "b", "en", 1, "", ""), (5, "\n\n\t ", "b", "en", 1, "", ""), (6, "é😀 +1 (826) 555-4081 ▁", "c", "fr", 1, "", ""),
]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# Pieces


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file here")
    return pieces.PieceEncoder(pieces.PieceVocabulary())


def test_ids_equal_the_library(encoder, spark, sf):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    random.seed(1)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " ", "   a", "a   b", "\n\n", "日本語 テスト", "▁x", "é" * 50, "a" * 3000, "😀 x😀", "  " * 40 + "x", "x" + " " * 40]
    texts += ["".join(random.choice("aabceht   inЖ中.") for _ in range(60)) for _ in range(500)]
    assert [x.tolist() for x in encoder.encode(texts)] == spm.encode(texts)


def test_compatible_equals_merging(encoder):
    v, rng = encoder.v, np.random.default_rng(0)
    number = {p: n for n, p in enumerate(v.names)}
    a, b = rng.integers(0, len(v.names), (2, 400))
    for x, y, ok in zip(a, b, v.compatible(a, b)):
        whole = pieces.merge([number[c] for c in v.names[x] + v.names[y]], v.names, number)
        assert (whole == [x, y]) == ok


def test_forgetting_changes_nothing(encoder, monkeypatch):
    texts = ["some words here", "and other words", "some words here again"]
    first = [x.tolist() for x in encoder.encode(texts)]
    monkeypatch.setattr(pieces, "MOST_KEPT", 1)
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == first


def test_encode_documents(encoder, spark):
    rows = pieces.encode_documents(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.n_tokens == len(r.ids)
    out = {r.doc_id: r for r in rows}
    assert out[1].ids == [] and out[1].round_trip and out[4].round_trip and not out[6].round_trip and out[5].round_trip
    assert pieces.encode_documents(table(spark, [])).count() == 0


# Fingerprints


def brute_print(text):
    found = re.findall(fingerprint.PIECE, text) if text else [""]
    exact, signed = [0] * 8, [0] * fingerprint.SIGNED
    for p in found:
        s, m = hashlib.sha256(p.encode()).hexdigest(), hashlib.md5(p.encode()).hexdigest()
        for i in range(8):
            exact[i] = (exact[i] + int(s[8 * i : 8 * i + 8], 16)) % 2**32
        if p != "\n":
            for j in range(fingerprint.SIGNED):
                signed[j] += (int(m[15 * (j // 60) : 15 * (j // 60) + 15], 16) >> (j % 60) & 1) * 2 - 1
    return "".join(f"{x:08x}" for x in exact) + "".join(f"{x % 65536:04x}" for x in signed)


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    rows = ODD + [(i, f"line {i}.\nshared line.\nother {i % 3}", "z", "en", 1, "", "") for i in range(10, 60)]
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_print(t), brute_print(edited)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    for per_range in (64, 1):  # one range, and ranges of a row or so
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", per_range)
        got = fingerprint.fingerprint_documents(table(spark, rows)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprint_documents(table(spark, [])).count() == 0
    one = fingerprint.fingerprint_documents(table(spark, [ODD[2]])).first()
    assert one.near_next == 1.0 and one.fingerprint == brute_print("same text here")


def test_paragraphs_are_added_and_removed(spark):
    from pyspark.sql import functions as F

    texts = {"ab": "a one.\nb two.\n", "ba": "b two.\na one.\n", "a": "a one.\n", "b": "b two.\n", "abb": "a one.\nb two.\nb two.\n", "long": "x" * 400 + "\n" * 70000}
    d = spark.createDataFrame(list(texts.items()), "key string, text string").select("key", F.explode(fingerprint.paragraphs(F.col("text"))).alias("piece"))
    prints = {r.key: r.fingerprint for r in fingerprint.fingerprint_paragraphs(d, "key").collect()}
    assert prints == {k: brute_print(t) for k, t in texts.items()} and prints["ab"] == prints["ba"] != prints["abb"]
    one = spark.createDataFrame([tuple(prints.values())], list(prints))
    r = one.select(
        fingerprint.add(one.a, one.b).alias("ab"), fingerprint.remove(one.ab, one.a).alias("b"), fingerprint.add(fingerprint.add(one.b, one.a), one.b).alias("abb"),
        fingerprint.remove(fingerprint.add(one.long, one.a), one.long).alias("a"), fingerprint.add(one.a, F.lit(None).cast("string")).alias("none"),
    ).first()
    assert r.none is None and all(r[k] == prints[k] for k in ("ab", "b", "abb", "a"))


# Personal data


def test_base_spans():
    t = "x +1 (826) 555-4081, a.b@c-d.example.org; 1.2.3.4 999.1.1.1, 4111 1111 1111 1111, 4111111111111112, +12 a@b"
    assert [(pii.KINDS[k], t[a:b]) for a, b, k in pii.base_spans(t)] == [("phone", "+1 (826) 555-4081"), ("email", "a.b@c-d.example.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111")]
    assert pii.base_spans("a@b.c@d.e") == [(0, 5, 0), (5, 9, 0)] or pii.base_spans("a@b.c@d.e")[0] == (0, 5, 0)
    for t in ("a" * 200_000, "1" * 200_000, "+" * 100_000, "@" * 100_000, "1." * 100_000, "+1" + "(" * 100_000):
        pii.base_spans(t)  # linear


PATTERNS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_equal_the_patterns():
    random.seed(5)
    for _ in range(1500):
        t = "".join(random.choice("aB1234567890..@@-- ()+é\n") for _ in range(60))
        out = []
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                    out.append((m.start(), m.end(), k))
        assert pii.base_spans(t) == sorted(out, key=lambda s: (s[0], s[2])), t


def test_model_adds_linked_spellings_only():
    t = "Call +1 (826) 555-4081 or 826 555 4081, mail Jo.Doe@mail.example.com or jo.doe@mail, order 4111111111111112."
    model = pii.fit([pii.nodes_of(t, pii.base_spans(t))] * 20)
    base, every = pii.find_spans([t, "no 826 555 4081 alone", ""], model)
    assert {t[a:b] for a, b, _ in set(every[0]) - set(base[0])} == {"826 555 4081", "jo.doe@mail"} and set(base[0]) <= set(every[0])
    assert every[1:] == [[], []]
    assert pii.mask(t, every[0]).startswith("Call <PHONE> or <PHONE>, mail <EMAIL> or <EMAIL>, order 4111111111111112.")
    start = pii.SkipChainModel.start()
    assert pii.fit([]).skip == start.skip


def test_tokens_equal_the_patterns():
    random.seed(7)
    number, at = r"[0-9(][0-9 ().-]{5,}[0-9]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*"
    for _ in range(3000):
        t = "".join(random.choice("aB1234567890..@@-- ()%") for _ in range(40))
        assert list(pii._number_tokens(t)) == [m.span() for m in re.finditer(number, t)], t
        assert list(pii._at_words(t)) == [m.span() for m in re.finditer(at, t)], t


def test_very_long_texts_take_linear_time():
    import time

    model = pii.SkipChainModel.start()
    for tail in ("a" * 10**6, "(" * 10**6, "1" * 300_000, "1.(" * 100_000, "a@" * 100_000, "@a" * 100_000, " " * 10**6, "1-" * 100_000, "x+" * 200_000, "a.b" * 200_000):
        began = time.process_time()
        pii.find_spans(["jo.doe@mail.example.com " + tail], model)
        assert time.process_time() - began < 60, tail[:6]  # a quadratic scan takes many minutes


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    L = pii.LABELS
    for trial in range(6):
        model = pii.SkipChainModel(rng.normal(size=(pii.N_FEATURES, L)), rng.normal(size=(L, L)), 1.5)
        model.chain = (model.chain + model.chain.T) / 2
        f = (rng.random((4, pii.N_FEATURES)) < 0.2).astype(float)
        f[:, pii.EVIDENCE] = 0
        if trial % 2:
            f[0, pii.EVIDENCE.start + trial % 4] = 1
        chain, skip = np.array([[0, 1], [2, 3]]), np.array([[1, 2]])  # a tree: passing is exact
        own = f @ model.unary
        own[:, 1:] += 20.0 * f[:, pii.EVIDENCE]
        want = np.zeros((4, L))
        top = None
        for y in itertools.product(range(L), repeat=4):
            e = sum(own[i, y[i]] for i in range(4)) + sum(model.chain[y[a], y[b]] for a, b in chain) + sum(model.skip_table()[y[a], y[b]] for a, b in skip)
            top = e if top is None else top
            for i in range(4):
                want[i, y[i]] += np.exp(e - top)
        want /= want.sum(1, keepdims=True)
        assert np.abs(model.marginals(f, chain, skip, rounds=60) - want).max() < 1e-6
        # With a loop the labels that are likeliest stay those of the enumeration where they are clear.
        loop = np.array([[1, 2], [0, 3]])
        p = model.marginals(f, chain, loop, rounds=60)
        assert p.shape == want.shape and np.allclose(p.sum(1), 1)


def test_the_sample_does_not_depend_on_repeated_rows(spark):
    rows = [(i, f"call +1 (826) 555-40{i:02d} or 826 555 40{i:02d}", "a", "en", 1, "", "") for i in range(30)]
    hot = [(5, "mail jo.doe@mail.example.com", "a", "en", 1, "", "")] * 300
    a, b = (pii.train_model(table(spark, r).repartition(n), most_docs=12) for r, n in ((rows + hot, 3), (hot[:1] + rows[::-1], 5)))
    assert np.array_equal(a.unary, b.unary) and a.skip == b.skip


def test_model_decides_without_base_spans(spark):
    t = "Call +1 (826) 555-4081 or 826 555 4081, mail Jo.Doe@mail.example.com or jo.doe@mail."
    model = pii.fit([pii.nodes_of(t, pii.base_spans(t))] * 20)
    texts = ["555-123-4567 then " * 3, "jo.doe@mail, " * 3, "lone 555-123-4567", "jo.doe@mail and 555-123-4567"]
    base, every = pii.find_spans(texts, model)
    assert base == [[], [], [], []] and [len(x) for x in every] == [3, 3, 0, 0]
    rows = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [rows[i].n_added for i in range(4)] == [3, 3, 0, 0] and rows[0].n_phone == 0


def test_find_personal_data(spark):
    d = table(spark, ODD)
    model = pii.train_model(d)
    rows = pii.find_personal_data(d, model).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_phone for r in rows}[6] == 1
    assert {r.doc_id: r.base_sha256 for r in rows}[1] == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.mask_documents(d, model).collect()}
    assert masked[6].text == "é😀 <PHONE> ▁" and masked[None].text is None and masked[6].score == ""
    empty = table(spark, [])
    assert pii.find_personal_data(empty, pii.train_model(empty)).count() == 0


# Quality


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train_model(docs, labels)
    rows = quality.score_documents(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) >= 0.9


def test_scores_do_not_depend_on_the_batch():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    texts = ["a a a", "a", "", "word " * 300_000, "é b", "x" * (quality.SLICE + 50), " \n ", "a b"]
    together = model.score(*quality._bytes_of(pa.array(texts)))
    alone = [model.score(*quality._bytes_of(pa.array([t])))[0] for t in texts]
    assert np.abs(together - alone).max() < 1e-9 and together[2] == together[6]


def brute_buckets(text):
    """Buckets of words, n-grams and repeated words, character by character in plain integers."""
    data = text.encode()
    white = b"\t\n\v\f\r "
    padded = bytes([32]) + bytes(32 if c in white else c for c in data) + bytes([32])
    out = []
    for k in quality.ORDERS:
        for i in range(len(padded) - k + 1):
            gram = padded[i : i + k]
            if 32 in gram[1:-1]:
                continue
            h = sum(c * int(quality._MULT[j]) for j, c in enumerate(gram)) % 2**32
            h = (h ^ h >> 15) * int(quality._FINAL) % 2**32
            out.append((h + k) * int(quality._FINAL) % 2**32 >> 32 - quality.BITS)
    before = None
    for w in padded.split(b" "):
        if not w:
            continue
        h = sum((c + 1) * pow(int(quality._BASE), j, 2**64) for j, c in enumerate(w)) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        out.append(h >> 64 - quality.BITS)
        if h == before:
            out.append(quality.REPEATED)
        before = h
    return out


def test_scores_equal_brute_force():
    import math

    import pyarrow as pa

    model = quality.QualityModel(np.random.default_rng(2).normal(size=1 << quality.BITS).astype(np.float32), -0.3)
    rng = random.Random(8)
    texts = [None, "", " ", "a", "a a", "ab  ab\tab", "é\u00a0é ü"] + ["".join(rng.choice("abé  \n.") for _ in range(rng.choice([5, 30, 200]))) for _ in range(40)]
    got = model.score(*quality._bytes_of(pa.array(texts)))
    for t, x in zip(texts, got):
        found = brute_buckets(t or "")
        z = (sum(float(model.weight[b]) for b in found) / len(found) if found else 0.0) + model.bias
        assert abs(x - 1 / (1 + math.exp(-z))) < 1e-9, t


def test_slices_change_no_score(monkeypatch):
    import pyarrow as pa

    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dddd"]) for _ in range(rng.choice([3, 40, 400]))) + rng.choice(["", "  ", "\n"]) for _ in range(60)]
    whole = model.score(*quality._bytes_of(pa.array(texts)))
    monkeypatch.setattr(quality, "SLICE", 50)
    assert np.abs(model.score(*quality._bytes_of(pa.array(texts))) - whole).max() < 1e-9


def test_quality_odd_tables(spark):
    d = table(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train_model(d, none)
    assert {r.score for r in quality.score_documents(d, model).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in (0, 1, 2, 3, 4, 5, 6, 7, None)], "doc_id long, quality int, toxic int")
    only = quality.train_model(d, one_kind)
    assert all(r.score > 0.5 for r in quality.score_documents(d, only).collect())
    assert quality.score_documents(table(spark, []), model).count() == 0


# Mixing


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]] if total else []
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            full.add(s)
            left -= cap * sizes[s]


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = list(ODD) + [(i, "w " * rng.choice([1, 5, 60, 3000 if i < 12 else 9]), rng.choice(["a", "a", "a", "b", "c", "d", None]), "en", 1, "", "") for i in range(10, 150)]
    got = mixing.mix_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    d = mixing.mix_documents(table(spark, rows), keep=("n_chars",), keep_source=True).collect()
    by = {}
    for r in d:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    target = brute_targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0].target - target[s]) < 1e-6 and abs(sum(r.taken for r in rs) - target[s]) <= 2 * mixing.BLOCK_WORDS, s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(table(spark, rows[::-1]).repartition(7)).collect()), key=str)


def test_shards_of_the_mix_hold_their_quotas(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 7, 40, 90]), rng.choice("aaabc"), "en", 1, "", "") for i in range(300)] + [(7, "w x", "a", "en", 1, "", ""), (7, "y z", "a", "en", 1, "", "")]
    got = mixing.mix_documents(table(spark, rows), keep=("text",), keep_source=True, n_shards=5).collect()
    sizes = {s: sum(r.size for r in got if r.source == s) for s in "abc"}
    quotas = {(r.source, r.shard): r.quota * 16 for r in mixing.source_quotas(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 5).collect()}
    for s in "abc":
        due = sum(quotas[s, k] for k in range(1, 6))
        assert sum(r.taken for r in got if r.source == s) == due
        # Documents that begin in a shard hold its quota but for the parts that reach over its ends.
        once = [r for r in got if r.source == s and r.taken and r.passes == 0]
        longest = max(r.size for r in got)
        if due <= sizes[s]:
            for k in range(1, 6):
                assert abs(sum(r.taken for r in once if r.shard == k) - quotas[s, k]) <= longest, (s, k)
    assert all((r.shard is None) == (r.taken == 0) and (r.shard is None or 1 <= r.shard <= 5) for r in got)
    again = mixing.mix_documents(table(spark, rows[::-1]).repartition(7), keep=("text",), keep_source=True, n_shards=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_documents(table(spark, rows), n_shards=1).collect())


def test_quotas_of_shards_add_up_and_equal_brute_force(spark):
    sizes = {"a": 10_000, "b": 700, "c": 90, "d": 3, "e": 5000}
    s = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = mixing.source_quotas(s, n_shards=5, block_words=16).collect()
    target = brute_targets(sizes)
    blocks = sum(sizes.values()) // 16
    for shard in range(1, 6):
        seats = {k: 0 for k in sizes}
        order = sorted(((-(target[k] / (2 * i + 1)), j, k) for j, k in enumerate(sorted(sizes)) for i in range(3 * sizes[k] // 16)))
        for _, _, k in order[: blocks * shard // 5]:
            seats[k] += 1
        assert {r.source: r.seats for r in rows if r.shard == shard} == seats
    assert all(r.quota >= 0 for r in rows)
    assert mixing.mix_documents(table(spark, [])).count() == 0
