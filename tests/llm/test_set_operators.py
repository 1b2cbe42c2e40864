"""Sharding, vectors, substrings, near duplicates, archives and components against brute force and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("wardline.llm")
from wardline.llm import common, jaccard, sharding, substring, vectors, warc

DOCS = "doc_id long, text string, label string, salt int, root string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


# Components and keys


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(random.randrange(200, 400), random.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Sharding


@pytest.mark.parametrize("n", [0, 1, 23, 24, 500])
def test_shards(spark, n):
    rows = [(i if i % 50 else None, None if i % 40 == 39 else "hot" if i % 3 == 0 else f"pair {i // 2}") for i in range(n)]
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == n
    if not n:
        return
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = {zlib.crc32((t or "").encode()): len((t or "").encode()) + 8 for _, t in rows}
    assert all(texts[r.text_crc32] == r.size and r.law == "rows" and r.grown_shard is None for r in got)


def test_groups_stay_together(spark):
    rows = [(i, f"group {i // 4}" if i < 2000 else f"single {i}") for i in range(4000)]
    got = sharding.shard_documents(table(spark, rows)).collect()
    where = {}
    for r in got:
        if r.group_rows > 1:
            where.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(where) == 500 and all(len(x) == 1 for x in where.values())
    again = sharding.shard_documents(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def shards_of(got):
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, Counter())[r.shard] += 1
    return where


def check_cut_links(got):
    where = shards_of(got)
    for r in got:
        own = where[r.text_crc32]
        assert r.cut_links == sum(own.values()) - own[r.shard] and r.group_rows == sum(own.values())


@pytest.mark.parametrize("n,size", [(200, 4), (1000, 20), (1000, 40)])
def test_groups_of_a_part_of_a_quota_are_not_cut(spark, n, size):
    got = sharding.shard_documents(table(spark, [(i, f"group {i // size}" if i < n // 2 else f"single {i}") for i in range(n)])).collect()
    check_cut_links(got)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and not any(r.cut_links for r in got)


def fewest_cut_links(sizes, rooms):
    """Over all ways to put groups into rooms, splitting them as one likes, the fewest links between rooms (in both directions)."""
    best = [10**9]

    def place(i, rooms, cost):
        if cost >= best[0]:
            return
        if i == len(sizes):
            best[0] = cost
            return
        n = sizes[i]

        def share(j, left, taken):
            if j == len(rooms):
                if not left:
                    place(i + 1, [r - t for r, t in zip(rooms, taken)], cost + n * n - sum(t * t for t in taken))
                return
            for t in range(min(left, rooms[j]), -1, -1):
                share(j + 1, left - t, [*taken, t])

        share(0, n, [])

    place(0, rooms, 0)
    return best[0]


@pytest.mark.parametrize("sizes,single", [([4, 3, 3, 2], 3), ([6, 3], 3), ([3, 3, 3, 3], 0)])
def test_cut_links_are_the_fewest(spark, sizes, single):
    texts = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(single)]
    got = sharding.shard_documents(table(spark, list(enumerate(texts))), n_shards=3).collect()
    check_cut_links(got)
    rooms = list(Counter(r.shard for r in got).values())
    assert sum(r.cut_links for r in got) == fewest_cut_links(sizes, rooms) and max(rooms) - min(rooms) <= 1


def test_groups_up_to_a_quota_are_not_cut(spark):
    # quota 100: groups of 100, 99, 60 and 30 fit whole; one of 250 needs three shards and no more
    sizes = [100, 99, 99, 60, 60, 30, 30, 30, 250]
    texts = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)] + [f"pair {i // 2}" for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts + [f"single {i}" for i in range(2400 - len(texts))])]
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert set(Counter(r.shard for r in got).values()) == {100}
    where = shards_of(got)
    for i, n in enumerate(sizes):
        held = where[zlib.crc32(f"group {i}".encode())]
        assert sum(held.values()) == n and len(held) == -(-n // 100), (n, held)
    assert all(len(where[zlib.crc32(f"pair {i}".encode())]) == 1 for i in range(300))
    check_cut_links(got)


def test_groups_that_fit_nowhere_whole_stay_close(spark):
    # 40 groups of 60 rows, quota 100: 24 fit whole, the others fill the 24 gaps of 40, each gap edge cutting one group
    rows = [(i, f"group {i // 60}") for i in range(2400)]
    got = sharding.shard_documents(table(spark, rows)).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts.values()) == {100}
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(100))
    held = [len(x) for x in shards_of(got).values()]
    assert held.count(1) >= 24 and sum(held) <= 40 + 23
    check_cut_links(got)
    alone = sharding.shard_documents(table(spark, [(i, "same") for i in range(245)])).collect()
    check_cut_links(alone)
    assert max(Counter(r.shard for r in alone).values()) == 11 and {r.group_rows for r in alone} == {245}


# Vectors


def brute_vectors(rows, c=0.95):
    """(vec_id, n_links, component_id, kept) of each row, row by row, lengths apart."""
    links, label = [0] * len(rows), list(range(len(rows)))
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n in {len(rows[i][1]) for i in ok}:
        at = np.array([i for i in ok if len(rows[i][1]) == n])
        u = np.array([rows[i][1] for i in at], float)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        near = (u[:, None, :] * u[None, :, :]).sum(-1) >= c
        np.fill_diagonal(near, False)
        own = at.copy()
        while True:
            new = np.minimum(own, np.where(near, own[None, :], 1 << 60).min(1))
            if (new == own).all():
                break
            own = new
        for k, i in enumerate(at):
            links[i], label[i] = int(near[k].sum()), int(own[k])
    ids = {}
    for i, (vec_id, _) in enumerate(rows):
        ids.setdefault(label[i], []).append(vec_id)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((vec_id, links[i], name[label[i]], vec_id == name[label[i]]) for i, (vec_id, _) in enumerate(rows)), key=str)


def linked(d, **sizes):
    return sorted(map(tuple, vectors.link_vectors(d, **sizes).collect()), key=str)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 3))
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(base[i % 150] * (1 + i % 4) + rng.normal(size=3) * 0.05 * (i % 3))) for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0, 0.0, 0.0]), (2003, [1.0, None, 1.0]), (2004, [float("nan"), 1.0, 1.0]), (2005, [float("inf"), 1.0, 1.0]), (2006, [1.0, 2.0])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, root string")
    for sizes in ({"tile_bytes": 500, "block_bytes": 1500}, {}):
        assert linked(d, **sizes) == brute_vectors(rows)
    wide = d.withColumn("embedding", d.embedding.cast("array<double>"))
    assert linked(wide) == brute_vectors(rows)
    assert vectors.link_vectors(spark.createDataFrame([], d.schema)).count() == 0
    assert linked(d.where("vec_id = 2000")) == [(2000, 0, 2000, True)]


def test_vectors_with_repeated_and_missing_ids_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 2.0]), (8, [3.0, 0.0]), (None, [3.0, 0.1]), (None, [-1.0, 0.0]), (None, [-2.0, 0.0]), (None, None), (None, [0.0])]
    rows += [(i % 17, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    rows += [(i % 7 if i % 5 else None, [float(x) for x in np.repeat([1.0, 3.0], 10) + rng.normal(size=20) * 0.8]) for i in range(200)]
    rows += [(300 + i, [float(i + 1)]) for i in range(4)] + [(400, [1.0] * 300), (401, [2.0] * 300), (402, [1.0] * 299 + [30.0])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node long")
    assert linked(d) == brute_vectors(rows) == linked(d.repartition(7), tile_bytes=100, block_bytes=300)
    assert [r for r in linked(d.limit(4))] == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False)]


def test_blocks_prune_and_decide_exactly(spark, monkeypatch):
    lo = [[float(10 * i), 0.0] for i in range(20)]
    d = spark.createDataFrame([(2, i, x, [x[0] + 1, 1.0]) for i, x in enumerate(lo)], "dim int, block long, lo array<double>, hi array<double>")
    assert sorted((r.a, r.b) for r in vectors.block_pairs(d, 0.3).collect()) == [(i, i) for i in range(20)]
    monkeypatch.setattr(vectors, "PART", 8)
    rng = np.random.default_rng(1)
    u = vectors.unit(rng.normal(size=(60, 12)))
    c = float(np.sort((u[:, None] * u[None]).sum(-1)[np.triu_indices(60, 1)])[-40])  # one pair is right on the threshold
    axes = vectors.Axes()
    axes.fitted[12] = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    side = lambda x: vectors._Side(x, np.ones(len(x), np.int64), axes)
    eps = np.sqrt(2 - 2 * c) + 1e-4
    near = np.triu((u[:, None] * u[None]).sum(-1) >= c, 1)
    whole, _ = vectors.join_blocks(side(u), None, c, eps)
    assert (whole == near.sum(0) + near.sum(1)).all() and near.sum() == 40
    a, b = side(u[:25]), side(u[25:])
    parts = [vectors.join_blocks(a, None, c, eps)[0], vectors.join_blocks(b, None, c, eps)[0]]
    assert (np.concatenate(parts) + vectors.join_blocks(a, b, c, eps)[0] == whole).all()


# Substrings


def brute_repeats(rows, n):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(b[s : s + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([q for q in bytes(gone).split(b"\0") if q]), hashlib.sha256(kept).hexdigest()))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("length,hot", [(100, 32), (100, 1), (33, 3), (8, 1)])
def test_substrings(spark, length, hot, monkeypatch):
    monkeypatch.setattr(substring, "PART", 700)
    monkeypatch.setattr(substring, "HOT_SHARDS", hot)
    rng = random.Random(length)
    rows = [(None, None), (None, "x" * 300), (1, ""), (2, "ab" * 200), (3, "ab" * 150 + "q" + "ab" * 90), (3, "zz"), (3, "ab" * 150), (5, "é" * 120), (6, "x" * 5000)]
    rows += [(i, "".join(rng.choice("ab") for _ in range(rng.choice([20, 60, 150])))) for i in range(10, 60)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows += [(i, "".join(rng.choice("ab ") for _ in range(30)) + passage + str(i)) for i in range(60, 90)]
    got = substring.remove_repeats(table(spark, rows), length=length, shard_bytes=1500, emit_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=KEY) == sorted(brute_repeats(rows, length), key=KEY)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert substring.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("size", [70, 95, 130])
def test_a_common_line_does_not_meet_in_one_task(spark, size, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SHARDS", 4)
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    line = text(size)
    rows = [(i, text(150) + line + text(150) if i % 3 == 0 else text(300)) for i in range(900)]
    d = table(spark, rows)
    _, _, runs = substring.runs_of(d, 100, 20_000)
    sent = {}
    for r in runs.collect():
        sent[r.part] = sent.get(r.part, 0) + len(r.bytes or b"") + len(r.windows or b"")
    assert len(sent) > 10 and max(sent.values()) <= 3 * float(np.median(list(sent.values())))
    got = substring.remove_repeats(d, shard_bytes=20_000).collect()
    assert sorted((tuple(r) for r in got), key=KEY) == sorted(brute_repeats(rows, 100), key=KEY)


def test_bytes_are_compared():
    data = np.frombuffer(b"abcdefabcdxyabc", np.uint8)
    a, b, n = np.array([0, 0, 0, 1]), np.array([6, 6, 12, 13]), np.array([4, 5, 3, 2])
    assert substring.same_bytes(data, a, b, n, n).tolist() == [True, False, True, True]
    assert substring.same_bytes(data, a, b, n, n + 1).tolist() == [False] * 4 and len(substring.same_bytes(data, a[:0], b[:0], n[:0], n[:0])) == 0
    big = np.tile(np.arange(250, dtype=np.uint8), 20_000)
    at, sizes = np.arange(0, 4_000_000, 250), np.full(16_000, 250)
    other = at + 250
    big[other[7777] + 3] += 1
    same = substring.same_bytes(big, at, other, sizes, sizes)
    assert np.flatnonzero(~same).tolist() == [7777, 7778]


def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90)))
        data = np.frombuffer(text, np.uint8)
        order = substring.suffix_order(data)
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        lcp = substring.common_prefixes(data, order, np.array([0]), np.array([len(text)]), 1 << 30)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[order[k]] == n


# Near duplicates


def brute_jaccard(rows, threshold=0.8, k=5):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x09-\x0d\x20]+", (t or "").lower()) if x]
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if w else frozenset())
    links, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and m >= threshold * (len(sets[i]) + len(sets[j]) - m) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(label[i], []).append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], links[i], name[label[i]]) for i in range(len(rows))), key=str)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # large groups are cut into blocks
    monkeypatch.setattr(jaccard, "VERIFY_ROWS", 16)
    monkeypatch.setattr(jaccard, "PART", 5)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, base = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "one two three four five")], None
    for i in range(6, 160):
        if i % 4 == 0 or base is None:
            base = [rng.choice(words) for _ in range(rng.choice([30, 60, 200]))]
        new = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            new[rng.randrange(len(new))] = rng.choice(words)
        rows.append((i, " ".join(new)))
    hot = [rng.choice(words) for _ in range(120)]
    for i in range(200, 260):
        new = list(hot)
        new[rng.randrange(len(new))] = f"x{i % 50}"
        rows.append((i, " ".join(new)))
    rows += [(2**60, " ".join(hot[:100]) + f" y{i}") for i in range(3)] + [(None, " ".join(hot[:100]) + f" z{i}") for i in range(3)] + [(None, "lone text"), (None, "lone  Text")]
    rows += [(1, "k " * 30), (1, " ".join(words[:80])), (2, "k " * 30 + "j"), (3, " ".join(words[:79])), (4, " ".join(words[:80]) + " last"), (None, None), (None, None)]
    got = jaccard.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_links, r.group_id) for r in got), key=str) == brute_jaccard(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.group, set()).add(r.group_id)
    assert all(len(x) == 1 for x in by.values())
    assert jaccard.near_duplicates(table(spark, [])).count() == 0
    twice = jaccard.near_duplicates(table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in twice) == [("1", 2), ("1", 2), ("None", 0), ("None", 2)]


def test_repeated_ids_do_not_merge_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = {(r.doc_id, r.n_shingles, r.n_links, r.group_id) for r in jaccard.near_duplicates(table(spark, [(1, a), (1, b), (2, a + " x"), (3, b + " y")])).collect()}
    assert got == {(1, 36, 1, 1), (2, 37, 1, 1), (3, 37, 1, 1)}


def test_pruning_bounds():
    least = jaccard.least_matches(0.8, 1e-6)
    assert len(least) == 8 and all(0 < m <= 16 * (i + 1) for i, m in enumerate(least)) and (np.diff(least) > 0).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (2000, jaccard.PERMS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint32)  # pairs at the threshold
    live = jaccard.prune(np.concatenate([a, b]), np.arange(2000), np.arange(2000, 4000), least)
    assert len(live) >= 1998
    c = np.where(rng.random(a.shape) < 0.3, a, a + 1).astype(np.uint32)
    assert len(jaccard.prune(np.concatenate([a, c]), np.arange(2000), np.arange(2000, 4000), least)) == 0


# Archives

EVIL = "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\ny"


@pytest.mark.parametrize("least", [0, 50])
def test_archives(spark, least):
    rows = [(1, "u", EVIL), (2, "u\n", EVIL), (3, None, None), (None, "q", "zz"), (5, "q", ""), (6, "q", "é\r\n\r\n"), (6, "q", "é\r\n\r\n"), (7, "q", EVIL), (8, "q", "z" * 100_000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string")
    got = warc.round_trip(d, least_bytes=least, file_records=3).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r.page_id]
        assert r.payload_bytes == len(texts[0].encode())
        revisit = r.payload_bytes >= least and first[texts[0]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[texts[0]]) if revisit else ("response", None))
    assert warc.round_trip(spark.createDataFrame([], d.schema)).count() == 0


def test_archives_keep_ids_of_any_bigint(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    d = spark.createDataFrame([(least, "u", "a"), (10**18, "u", "b"), (most, "u", "b"), (most - 1, "u", "a")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.refers_to) for r in warc.round_trip(d).collect())
    assert [x[0] for x in got] == [least, 10**18, most - 1, most] and [x[1] for x in got] == [None, None, least, 10**18]
    assert warc._number(b"9223372036854775808") is None and warc._number(b"-9223372036854775809") is None and warc._number(b"1x") is None


def test_only_reachable_records_count():
    import gzip

    body = EVIL.encode()
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    assert [r[1] for r in warc.records_of(one * 3)] == [len(body)] * 3
    assert len(list(warc.candidates([one * 3]))) > 3
    assert warc.records_of(b"junk" + one) == [] and warc.records_of(b"") == []
    at = np.arange(0, 5000, 5)
    assert warc.reachable(at, at + 5).all() and warc.reachable(at, at + 10).sum() == 500
    # However the text is cut into parts, and into gzip streams, edges are the same; digests are those of the payloads.
    rng = random.Random(2)
    bodies = [body, b"", b"z" * 5000, b"\r\n\r\n", body * 3, b"\r\n\r\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n" * 50]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(x), x) for i, x in enumerate(bodies * 3))
    whole = sorted(warc.candidates([data]))
    import base64

    assert [r[2] for r in warc.records_of(data)] == [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in bodies * 3]
    for _ in range(20):
        cuts = sorted(rng.randrange(len(data)) for _ in range(rng.choice([1, 5, 300])))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert sorted(warc.candidates(parts)) == whole
        zipped = b"".join(map(gzip.compress, parts))
        assert b"".join(warc.text_of(zipped, 1000)) == data and warc.records_of(zipped) == warc.records_of(data)
    assert warc.records_of(data[:-2]) == warc.records_of(data)[:-1]


def test_large_pages_and_files(spark, tmp_path):
    rows = [(i, f"http://x/{i % 5}", "é" * 700_000 + str(i // 2)) for i in range(8)] + [(100 + i, None, "small") for i in range(40)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.records_a_file(d) == 286 and warc.records_a_file(d.where("page_id < 8"), file_bytes=1) == 1 and warc.records_a_file(d.limit(0)) == 2000
    path = str(tmp_path / "out")
    warc.write_archives(warc.plan_records(d), path, 10)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.digest_ok) for r in got) == [(i, len(h.encode()), "response" if i in (0, 2, 4, 6, 100) else "revisit", True) for i, _, h in rows]
    import glob
    import gzip

    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) == len(rows) and text.count(b"WARC-Refers-To-Target-URI: http://x/") == 4 and text.count(b"WARC-Refers-To-Date: ") == 43


def test_digest_is_base32(spark):
    import base64

    texts = ["", "a", "é" * 999]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in d.select(warc.base32_sha1(d.t).alias("x")).collect()] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
