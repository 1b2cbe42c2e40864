"""Operator 5: quality classifier with supervised subword embeddings.

Each word and each character n-gram (3 to 5 bytes, within a word and its borders) hashes to one of 2^18 learned vectors;
a word that follows itself has one more.
A document is the mean of its vectors, followed by a softmax layer over two labels; numpy stochastic gradient descent
trains both. As the output layer is linear, a trained model folds into one number for each hash bucket, and scoring is a
gather and a mean over the bytes of the Arrow batch, without a Python object for any word.

Bounds: training takes at most `per_label` labelled rows of each label with texts of at most `most_bytes` (documented
parameters); label counts, which set the prior, cover all labels. The model that is sent out is 1 MB at any input size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BITS = 18
DIM = 8
ORDERS = (3, 4, 5)
SLICE = 1 << 20
REPEATED = (1 << BITS) - 1

_rng = np.random.default_rng(20240501)
_MULT = (_rng.integers(1, 1 << 31, 8).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_FINAL = np.uint32(0x9E3779B1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _tables["up"], _tables["down"] = _powers(_BASE, SLICE + 8), _powers(inverse, SLICE + 8)
    return _tables["up"], _tables["down"]


def features(data: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words and n-grams of some bytes (at most SLICE), and a byte of the word that each one is from.

    n-grams hold white space at their borders only. A pair of equal words that follow each other, whichever word it is,
    has a bucket of its own. begins: where texts begin, if the bytes are of more than one.
    """
    n = len(data)
    space = _SPACE[data]
    padded = np.empty(n + 2, np.uint32)
    padded[0] = padded[-1] = 32
    np.copyto(padded[1:-1], data)
    gaps = np.empty(n + 2, bool)
    gaps[0] = gaps[-1] = True
    gaps[1:-1] = space
    padded[gaps] = 32
    found, at = [], []
    for k in ORDERS:
        m = n + 2 - k + 1
        if m <= 0:
            continue
        h = padded[:m] * _MULT[0]
        for j in range(1, k):
            h += padded[j : m + j] * _MULT[j]
        bad = gaps[1 : m + 1].copy()
        for j in range(2, k - 1):
            bad |= gaps[j : m + j]
        ok = np.flatnonzero(~bad)
        h = h[ok]
        h ^= h >> np.uint32(15)
        h *= _FINAL
        h += np.uint32(k)
        found.append(((h * _FINAL) >> np.uint32(32 - BITS)).astype(np.uint32))
        at.append(ok)  # its second byte, which is never a border
    edges = np.flatnonzero(np.diff(gaps.astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]  # of words, in bytes of data
    if len(starts):
        up, down = _power_tables()
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        w = (sums[ends] - sums[starts]) * down[starts]
        w ^= w >> np.uint64(29)
        w *= np.uint64(0xBF58476D1CE4E5B9)
        found.append((w >> np.uint64(64 - BITS)).astype(np.uint32))
        at.append(starts)
        same = w[1:] == w[:-1]
        if begins is not None:
            text = np.searchsorted(begins, starts, "right")
            same &= text[1:] == text[:-1]
        again = starts[1:][same]
        found.append(np.full(len(again), REPEATED, np.uint32))
        at.append(again)
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(at)


def _slices(data: np.ndarray, begin: int, end: int):
    """Pieces of [begin, end) of at most SLICE bytes, cut at white space; only a word that is longer is cut as it comes."""
    while end - begin > SLICE:
        gaps = np.flatnonzero(_SPACE[data[begin + 1 : begin + SLICE]])
        cut = begin + 1 + int(gaps[-1]) if len(gaps) else begin + SLICE
        yield begin, cut
        begin = cut
    yield begin, end


def _outer_words(data: np.ndarray) -> tuple[bytes, bytes]:
    """The first and the last word of some bytes; empty if there is none."""
    word = np.flatnonzero(~_SPACE[data])
    if not len(word):
        return b"", b""
    gaps = np.flatnonzero(np.diff(word) > 1)
    first_end, last_start = (word[gaps[0]], word[gaps[-1] + 1]) if len(gaps) else (word[-1], word[0])
    return data[word[0] : first_end + 1].tobytes(), data[last_start : word[-1] + 1].tobytes()


@dataclass
class QualityModel:
    """weight: what a bucket adds to the log odds of label 1, before the mean; bias: the rest.

    both: whether it has learned from rows of both labels; otherwise its scores tell no text from another.
    """

    weight: np.ndarray
    bias: float
    both: bool = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts data[offsets[i]:offsets[i + 1]]; one without words has the prior's score."""
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        i = 0
        while i < n:
            j = i + 1  # as many whole texts as fit in a slice, one at least
            while j < n and offsets[j + 1] - offsets[i] <= SLICE:
                j += 1
            if j == i + 1:
                before = b""
                for b, e in _slices(data, int(offsets[i]), int(offsets[j])):
                    h, _ = features(data[b:e])
                    total[i] += self.weight[h].sum(dtype=np.float64)
                    count[i] += len(h)
                    if offsets[j] - offsets[i] > SLICE:  # a word may follow itself across a cut
                        first, last = _outer_words(data[b:e])
                        if first and first == before:
                            total[i] += float(self.weight[REPEATED])
                            count[i] += 1
                        before = last or before
            else:
                # Texts are set apart by a space, so that words of two texts never meet.
                sizes = np.diff(offsets[i : j + 1])
                own = np.repeat(np.arange(j - i), sizes)
                block = np.full(int(sizes.sum()) + (j - i), 32, np.uint8)
                block[np.arange(len(own)) + own] = data[offsets[i] : offsets[j]]
                begins = (offsets[i:j] - offsets[i]) + np.arange(j - i)
                if len(block) <= SLICE + 8:
                    h, at = features(block, begins)
                    which = np.searchsorted(begins, at, "right") - 1
                    total[i:j] += np.bincount(which, self.weight[h], j - i)
                    count[i:j] += np.bincount(which, minlength=j - i)
                else:
                    for t in range(i, j):
                        h, _ = features(data[offsets[t] : offsets[t + 1]])
                        total[t] += self.weight[h].sum(dtype=np.float64)
                        count[t] += len(h)
            i = j
        logit = np.divide(total, count, out=np.zeros(n), where=count > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(texts: list[bytes], labels: list[int], prior: float = 0.0, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> QualityModel:
    """Stochastic gradient descent over documents; prior: log odds of label 1 in all labels less those of the sample."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        h = np.concatenate([features(data[b:e])[0] for b, e in _slices(data, 0, len(data))])
        idx, counts = np.unique(h, return_counts=True)
        rows.append((idx, (counts / max(1, len(h))).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    output = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[idx]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output -= lr * np.outer(mean, p)
            bias -= lr * p
            # A bucket's step is scaled up by the number of buckets: each holds a small share of the mean.
            vectors[idx] -= np.outer(share, (lr * min(len(idx), 400)) * back)
    weight = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
    return QualityModel(weight, float(bias[1] - bias[0]) + prior)


def held_out(doc_id="doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_model(docs: DataFrame, labels: DataFrame, per_label: int = 1500, most_bytes: int = 32768) -> QualityModel:
    """Fits on at most `per_label` rows of each label, the first by a hash of doc_id. Without labels: score 0.5 throughout.

    A doc_id with several labels has the lowest, one with several texts the smallest of them; labels other than 0 and 1, and null ids, are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= most_bytes)
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in sample.collect())  # one for each picked id at most
    texts, marks = [r[1].encode() for r in rows], [r[2] for r in rows]
    if not rows or not all(counts.get(q) for q in (0, 1)):
        only = 0.0 if not counts or not rows else (4.0 if counts.get(1) else -4.0)
        return QualityModel(np.zeros(1 << BITS, np.float32), only, False)
    n1 = max(1, sum(marks))
    n0 = max(1, len(marks) - sum(marks))
    model = train(texts, marks, float(np.log(counts[1] / counts[0]) - np.log(n1 / n0)))
    model.both = len(set(marks)) == 2
    return model


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls have no bytes."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with a column score (0 to 1). Null and empty texts have the prior's score; other columns pass through, but for
    one of that name, which gives way."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        m = sent.value
        for b in batches:
            data, offsets = _bytes_of(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(data, offsets))], [*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op5_quality_subword(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents", even=True).select("doc_id", "text")
    model = train_model(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
