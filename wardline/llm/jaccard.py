"""Operator 9: near-duplicate documents by word shingles, with Bayesian pruning of candidates.

A document is the set of its runs of five words (lower case; all its words if it has fewer). Documents with the same set
are one class. Candidates come from 32 bands of 4 MinHash values (a pair at the threshold of 0.8 is missed with a chance
of 5e-8). Pairs of a bucket are compared 16 values at a time: after m matches out of n, the posterior of their similarity
under a flat prior is Beta(m + 1, n - m + 1), and a pair goes as soon as the chance that it reaches the threshold falls
below the tolerance. What is left is joined to components, and within a component every pair is verified exactly.

A class is a node of its own, whatever the ids of its documents; ids only name classes and groups at the end.

Scale: pairs are never rows. A bucket that appears with the same members in several bands is looked at once; buckets
beyond BLOCK members and components beyond VERIFY_ROWS members or VERIFY_BYTES of shingles are cut into blocks, and tasks
get pairs of blocks, so a group of m different near copies is sent m / VERIFY_ROWS times; what tasks give back is at most
one row for each member: its links and one edge of a spanning forest. Keys are handled as (key, salt) where a key can be
hot. Texts are shuffled once, for verification; sketches of 512 bytes do the rest.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, components, cut, forest, table

WORDS = 5
THRESHOLD = 0.8
PERMS = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 2048
VERIFY_ROWS = 2048
VERIFY_BYTES = 16 << 20
PART = 512

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_DOWN = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(90125)
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> np.ndarray:
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(np.diff(gap.astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_BASE, n), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_DOWN, n + 1)[starts])


def shingles(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's bytes; none for a text without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(words, len(w))
    m = len(w) - k + 1
    h = np.full(m, _U(k))
    for j in range(k):
        h += w[j : j + m] * _C[j % 8] + _U(j)
        h = _mix(h) if j == 3 else h
    return np.unique(_mix(h))


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PERMS values for each set; sets are not empty. A few thousand hashes at a time."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), PERMS), 0xFFFFFFFF, np.uint32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for a in range(0, len(flat), 2048):
        part, own = flat[a : a + 2048], owner[a : a + 2048]
        v = ((part[:, None] * _A + _B) >> _U(32)).astype(np.uint32)
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        who = own[new]
        out[who] = np.minimum(out[who], np.minimum.reduceat(v, new, axis=0))
    return out


def _texts(column):
    """UTF-8 bytes of each text, lower case; a few rows at a time."""
    for at in range(0, len(column), 512):
        part = column.slice(at, 512)
        low = pc.utf8_lower(pc.fill_null(part, ""))
        yield at, [np.frombuffer(x.as_buffer(), np.uint8) if len(x.as_py()) else np.zeros(0, np.uint8) for x in low]


SKETCH = "row bigint, doc_id bigint, th bigint, n bigint, k1 bigint, k2 bigint, sig binary"


def _sketch(words: int):
    def run(batches):
        for b in batches:
            for at, texts in _texts(b.column(3)):
                sets = [shingles(t, words) for t in texts]
                some = [s for s in sets if len(s)]
                sigs = iter(minhash(some)) if some else iter(())
                k1 = [int(np.bitwise_xor.reduce(s).astype(np.int64)) if len(s) else 0 for s in sets]
                k2 = [int(_mix(s * _C[0]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).slice(at, len(texts)) for i in range(3)], pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()),
                        pa.array(k2, pa.int64()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["row", "doc_id", "th", "n", "k1", "k2", "sig"],
                )

    return run


def _bands(batches):
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, PERMS // BAND, BAND).astype(np.uint64)
            key = reduce(lambda h, j: _mix(h * _C[j] + sig[:, :, j]), range(BAND), np.arange(PERMS // BAND, dtype=np.uint64)[None, :] + _U(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), key.shape[1])), pa.array(key.ravel().astype(np.int64))], ["id", "band"])


def least_matches(threshold: float, tolerance: float, perms: int = PERMS, step: int = STEP) -> np.ndarray:
    """For n = step, 2 * step, ... the fewest matches with which a pair is kept.

    With a flat prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, perms + 1, step):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray, step: int = STEP) -> np.ndarray:
    """Which of the pairs (i, j) of signature rows survive; values are compared `step` at a time."""
    live = np.arange(len(i))
    matches = np.zeros(len(i), np.int64)
    for r, need in enumerate(least):
        part = slice(r * step, (r + 1) * step)
        matches[live] += (sig[i[live], part] == sig[j[live], part]).sum(1)
        live = live[matches[live] >= need]
        if not len(live):
            break
    return live


def _pairs(sizes: np.ndarray):
    """Pairs (i, j), j < i, of the rows of groups that stand one after the other."""
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()))
    own = at - np.repeat(starts, sizes)
    i = np.repeat(at, own)
    j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(np.repeat(starts, sizes), own)
    return i, j


def _candidate_edges(least: np.ndarray):
    def run(key, t):
        """One group: a bucket, or two blocks of a large one. Surviving pairs come back as a spanning forest."""
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), PERMS)[order]
        own = t.column("own").to_numpy()[order]
        apart = own.min() != own.max()  # two blocks: pairs within one are for where it meets itself
        root = np.arange(len(ids))
        for a in range(0, len(ids), 128):  # rows against all before them; those that are connected already need no pair
            i, j = np.nonzero(np.tri(min(128, len(ids) - a), len(ids), a - 1, dtype=bool))
            i += a
            open_ = (root[i] != root[j]) & ((own[i] != own[j]) | (not apart))
            i, j = i[open_], j[open_]
            live = prune(sig, i, j, least)
            root = root[forest(len(ids), root[i[live]], root[j[live]])[root]]
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[some], "b": ids[root[some]]})

    return run


def _small_candidate_edges(least: np.ndarray):
    """Buckets of at most SMALL members come as lists, many in a batch: all their pairs are pruned together."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            members = b.column(0)
            sizes = members.value_lengths().to_numpy().astype(np.int64)
            flat = members.flatten()
            ids = flat.field("id").to_numpy()
            sig = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint32).reshape(len(ids), PERMS)
            i, j = _pairs(sizes)
            live = prune(sig, i, j, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[live]]), pa.array(ids[j[live]])], ["a", "b"])

    return run


SMALL = 8


def candidate_edges(ids: DataFrame, signatures: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that connect all classes (ids: id; signatures: id, sig, of these and others) whose pairs survive the pruning."""
    least = least_matches(threshold, tolerance)
    # Bands are made twice from the same exchange rather than kept: that costs less than writing them.
    bands = signatures.join(ids, "id", "left_semi").mapInArrow(_bands, "id bigint, band bigint")
    count = {"c": F.count("*"), "x": F.bit_xor(F.xxhash64("id")), "s": F.min("id")}, {"m": F.sum("c"), "x": F.bit_xor("x"), "s": F.min("s")}
    sized = attach_by_key(bands, ["band"], ["id"], *count, salts=8).where("m > 1")
    # Bands whose buckets have the same members: one of them is enough.
    sized = cut(sized)
    chosen = sized.where("id = s").groupBy("m", "x", "s").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    spread = chosen.select("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("salt"))
    picked = salted.join(spread, ["band", "salt"], "left_semi").select("band", "id", "m", F.when(F.col("m") > BLOCK, blocks).otherwise(1).alias("nb"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    placed = picked.withColumn("own", own).withColumn("other", other)
    placed = placed.select("band", "id", "m", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    full = placed.join(signatures, "id")
    small = full.where(F.col("m") <= SMALL).groupBy("band").agg(F.collect_list(F.struct("id", "sig")).alias("members"))
    few = small.select("members").mapInArrow(_small_candidate_edges(least), "a bigint, b bigint")
    many = full.where(F.col("m") > SMALL).groupBy("band", "x", "y").applyInArrow(_candidate_edges(least), "a bigint, b bigint")
    return few.unionByName(many).distinct()


def _shingle_rows(words: int):
    names = ["id", "root", "weight", "nb"]

    def run(batches):
        for b in batches:
            for at, texts in _texts(b.column(4)):
                sets = pa.array([shingles(t, words).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, len(texts)) for i in range(4)], sets], [*names, "set"])

    return run


def exact_links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets of a and of b with a Jaccard similarity of at least the threshold, from exact intersections.

    b is None: pairs j < i within a.
    """
    sets = a if b is None else [*a, *b]
    na, nb = len(a), len(a) if b is None else len(b)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    value, own = flat[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set only adds nothing
    column, own = column[often], own[often]
    common = np.zeros((na, nb), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype(np.int64)]))
        width = max(64, (1 << 22) // len(sets))
        for at in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            m = np.zeros((len(sets), width), np.float32)
            m[own[lo:hi], column[lo:hi] - at] = 1
            common += m @ m.T if b is None else m[:na] @ m[na:].T  # counts below 2^24 are exact
    inter = common.astype(np.float64)
    union = sizes[:na, None] + (sizes[None, :] if b is None else sizes[None, na:]) - inter
    hit = inter >= threshold * union - 1e-9
    return np.nonzero(np.tril(hit, -1) if b is None else hit)


def links_of(sets: list[np.ndarray], block: np.ndarray, threshold: float):
    """Linked pairs (i, j) of a group's sets, a few hundred by a few hundred; parts whose sizes are too far apart for any
    link are passed over. Of two blocks only pairs across count."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    apart = len(block) > 0 and block.min() != block.max()
    for p in range(0, len(order), PART):
        first = order[p : p + PART]
        for q in range(p, len(order), PART):
            second = order[q : q + PART]
            if sizes[first[-1]] < threshold * sizes[second[0]] - 1e-9:
                break
            i, j = exact_links([sets[k] for k in first], None if p == q else [sets[k] for k in second], threshold)
            i, j = first[i], second[j]
            if apart:
                across = block[i] != block[j]
                i, j = i[across], j[across]
            if len(i):
                yield i, j


def _verify(threshold: float):
    def run(key, t):
        ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        n = len(ids)
        links, docs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        for i, j in links_of(sets, t.column("block").to_numpy(), threshold):
            links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            np.add.at(docs, i, weight[j])
            np.add.at(docs, j, weight[i])
            root = root[forest(n, root[i], root[j])[root]]
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "docs": docs[some], "root": ids[root[some]]})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id, class_docs, class_links, n_links, group_id, kept, th, group.

    class_id: the smallest doc_id with the same set of shingles; class_links: other classes at or above the threshold;
    n_links: other documents at or above it, copies included; group_id: the smallest doc_id that links lead to; kept: whether
    the document's id is its group's. A text without words (null, empty, blank) links with nothing and is a class of its own.
    Every row is a document of its own: rows that repeat a doc_id, with the same text or another one, and rows without an
    id (which never name a class or group; one without any id has null, and all its rows are kept). group: a number of the
    group, its own even where names repeat; th: xxhash64 of the text. Empty input gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th"))
    numbered = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "th", "text")
    sketches = cut(numbered.mapInArrow(_sketch(words), SKETCH))  # the cut fixes the numbers
    some = sketches.where("n > 0")
    same = {"node": F.min("row"), "first": F.min("doc_id"), "c": F.count("*")}, {"node": F.min("node"), "class_id": F.min("first"), "class_docs": F.sum("c")}
    members = cut(attach_by_key(some.select("row", "doc_id", "th", "n", "k1", "k2"), ["n", "k1", "k2"], ["row"], *same).select("row", "doc_id", "th", "n", "node", "class_id", "class_docs"))
    reps = members.where("row = node").select(F.col("row").alias("id"), "doc_id", "th", "n", "class_id", F.col("class_docs").alias("weight"))
    near = components(candidate_edges(reps.select("id"), some.select(F.col("row").alias("id"), "sig"), threshold, tolerance))
    nodes = cut(near.join(reps, F.col("node") == F.col("id")).select("id", "root", "doc_id", "th", "n", "weight"))
    sized = attach_by_key(nodes, ["root"], ["id"], {"m": F.count("*"), "w": F.sum("n")}, {"m": F.sum("m"), "w": F.sum("w")})
    blocks = F.greatest(F.ceil(F.col("m") / VERIFY_ROWS), F.ceil(F.col("w") * 8 / VERIFY_BYTES)).cast("int")
    todo = sized.select("id", "root", "weight", blocks.alias("nb"), F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
    # Rows that repeat an id and its text are one here, whichever of them comes.
    texts = d.join(todo, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).dropDuplicates(["id"])
    sets = texts.select("id", "root", "weight", "nb", "text").mapInArrow(_shingle_rows(words), "id bigint, root bigint, weight bigint, nb int, set binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sets = sets.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "weight", "block", "set")
    found = cut(sets.groupBy("root", "x", "y").applyInArrow(_verify(threshold), "id bigint, links bigint, docs bigint, root bigint"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # A group is named by its smallest doc_id.
    named = cut(groups.join(reps.select(F.col("id").alias("node"), "class_id"), "node"))
    named = attach_by_key(named, ["root"], ["node"], {"name": F.min("class_id")}, {"name": F.min("name")})
    counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    linked = counts.join(named.select(F.col("node").alias("id"), "name", F.col("root").alias("group")), "id")
    # Back to the documents by (class, salt): a class may hold a large part of them.
    salt = F.pmod(F.xxhash64("row"), F.lit(32)).cast("int")
    spread = linked.withColumnRenamed("id", "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    out = members.withColumn("salt", salt).join(spread, ["node", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", "class_docs",
        F.coalesce("links", F.lit(0)).alias("class_links"),
        (F.coalesce("docs", F.lit(0)) + F.col("class_docs") - 1).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("class_id")).otherwise(F.col("name")).alias("group_id"),
        "th", F.coalesce("group", "node").alias("group"),
    )
    zero = F.lit(0).cast("bigint")
    blank = sketches.where("n = 0").select(
        "doc_id", zero.alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_docs"),
        zero.alias("class_links"), zero.alias("n_links"), F.col("doc_id").alias("group_id"), "th", F.col("row").alias("group"),
    )
    return out.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id"))).select(*RESULT, "th", "group")


RESULT = ("doc_id", "n_shingles", "class_id", "class_docs", "class_links", "n_links", "group_id", "kept")


def op9_jaccard_bayes(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", even=True)).select(*RESULT)


#: The same over all pairs of documents with a common shingle and the closure of their links.
OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x09-\\x0D\\x20]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
k AS (SELECT doc_id, least(doc_id, coalesce(min(y) FILTER (same), doc_id)) AS class_id, count(*) FILTER (same) + 1 AS class_docs, count(y) AS n_links FROM documents LEFT JOIN e ON x = doc_id GROUP BY doc_id),
l AS (SELECT x, count(DISTINCT class_id) AS class_links FROM e JOIN k ON k.doc_id = y WHERE NOT same GROUP BY x),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node),
g AS (SELECT doc_id, min(node) AS group_id FROM r GROUP BY doc_id)
SELECT k.doc_id, coalesce(n, 0) AS n_shingles, class_id, CAST(class_docs AS BIGINT) AS class_docs, coalesce(class_links, 0) AS class_links, n_links, group_id, k.doc_id = group_id AS kept
FROM k LEFT JOIN n USING (doc_id) JOIN g USING (doc_id) LEFT JOIN l ON l.x = k.doc_id
"""
