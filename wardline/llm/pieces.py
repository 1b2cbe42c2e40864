"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece can reach across (before a word's space mark, around characters that are no piece),
each distinct part is written once into one text, and that text is indexed by a suffix array over as many characters as
the longest piece has. Every piece of the vocabulary is binary-searched for its range of suffixes; the ranges are edges
(from, to, piece), which are sorted by where they end and relaxed from left to right.

The vocabulary is a byte-pair one, so relaxing asks which edge the merges would give: of the edges that end at a position,
exactly one is compatible with the last piece of the prefix it starts from (merging those two pieces' characters gives
these two pieces again). That needs no agenda of merges and equals the library's ids. Runs of space marks, whose pieces
rank below all others, are put together last, from the left.

Scale: a map over Arrow batches without a shuffle. What leaves the driver is the vocabulary's tables (about 1 MB); a
worker keeps parts it has seen, up to a fixed number of characters.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MOST_KEPT = 2_000_000
SLICE = 1 << 20


def _fields(data: bytes):
    """Field number and value of each field of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint(i):
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x, i

    while i < n:
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 1:
            v, i = data[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            v, i = data[i : i + size], i + size
        else:
            v, i = data[i : i + 4], i + 4
        yield key >> 3, v


def read_model(path: str = MODEL):
    """Pieces, scores and kinds (1 normal, 2 unknown, 3 control, 6 byte), and whether a space is put in front."""
    pieces, scores, kinds, front, model_type, squeeze = [], [], [], True, 1, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry.get(1, b"").decode())
                scores.append(float(np.frombuffer(entry[2], "<f4")[0]) if 2 in entry else 0.0)
                kinds.append(entry.get(3, 1))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                front, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if model_type != 2 or squeeze:
        raise ValueError("a byte-pair model without white-space squeezing is needed")
    return pieces, scores, kinds, front


class PieceVocabulary:
    """Tables for matching and for the compatibility of neighbouring pieces; built on the driver, sent to the workers.

    Pieces are numbered in the order in which merging would choose them, single characters first.
    """

    def __init__(self, path: str = MODEL):
        pieces, scores, kinds, self.front = read_model(path)
        self.unk = kinds.index(2) if 2 in kinds else -1
        self.byte_ids = np.full(256, self.unk, np.int32)
        self.shown: list[bytes] = [b""] * len(pieces)
        chars, merged, self.runs = {}, [], {}
        for i, (p, s, k) in enumerate(zip(pieces, scores, kinds)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.shown[i] = bytes([int(p[3:5], 16)])
            elif k == 1:
                self.shown[i] = p.replace(MARK, " ").encode()
                if len(p) == 1:
                    chars[p] = i
                elif set(p) == {MARK}:
                    self.runs[len(p)] = i
                else:
                    merged.append((-s, i, p))
            elif k == 2:
                self.shown[i] = " ⁇ ".encode()
        merged.sort()
        inside = [p for _, _, p in merged if MARK in p[1:]]
        if inside:
            raise ValueError("pieces that reach across words are not supported")
        self.alphabet = {c: n for n, c in enumerate(sorted(chars), 1)}
        names = [*sorted(chars), *(p for _, _, p in merged)]
        self.ids = np.array([*(chars[c] for c in sorted(chars)), *(i for _, i, _ in merged)], np.int32)
        self.n_chars = len(chars)
        number = {p: n for n, p in enumerate(names)}
        self.left, self.right = np.arange(len(names), dtype=np.int32), np.arange(len(names), dtype=np.int32)
        usable = np.ones(len(names), bool)
        for n in range(self.n_chars, len(names)):
            parts = merge([number[c] for c in names[n]], names, number, stop=n)
            if len(parts) == 2:
                self.left[n], self.right[n] = parts
            else:
                usable[n] = False
        pairs = {}
        for n in range(self.n_chars, len(names)):
            p = names[n]
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = n
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.maybe = np.zeros(1 << 22, bool)  # most pairs are none, and this says so without a search
        self.maybe[self._spot(self.pair_keys)] = True
        self.names, self.lengths, self.usable = names, np.array([len(p) for p in names]), usable
        self.longest = int(self.lengths.max())
        codes = np.zeros((len(names), -(-self.longest // 4) * 4), np.int64)
        for n, p in enumerate(names):
            codes[n, : len(p)] = [self.alphabet[c] for c in p]
        self.codes = codes
        self.run_of_mark = number[MARK]

    @staticmethod
    def _spot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b gives exactly a and b: no merge across may come before their own."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        order = lambda x: np.where(x < self.n_chars, -1, x)  # noqa: E731  characters need no merge
        while len(live):
            x, y = a[live], b[live]
            key = x << 20 | y
            across = np.full(len(key), 1 << 41, np.int64)
            some = np.flatnonzero(self.maybe[self._spot(key)])
            at = np.minimum(np.searchsorted(self.pair_keys, key[some]), len(self.pair_keys) - 1)
            across[some] = np.where(self.pair_keys[at] == key[some], self.pair_to[at].astype(np.int64), 1 << 41)
            bad = across < limit[live]
            out[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            both = (x < self.n_chars) & (y < self.n_chars)
            live, x, y = live[~both], x[~both], y[~both]
            # Undo whichever merge came last: before it, a merge across would have had to rank below it. Where both
            # could come at the same moment the left one goes first.
            undo_a = order(x) > order(y)
            limit[live] = np.where(undo_a, x, y + 1)
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_a, y, self.left[y])
        return out


def merge(parts: list[int], names: list[str], number: dict[str, int], stop: int | None = None) -> list[int]:
    """Plain byte-pair merging, the best pair first, the leftmost of equal ones. stop: this piece is not put together."""
    parts = list(parts)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            n = number.get(names[parts[i]] + names[parts[i + 1]])
            if n is not None and (best is None or n < best):
                best, at = n, i
        if best is None or (best == stop and len(parts) == 2):
            break
        parts[at : at + 2] = [best]
    return parts


def suffix_array(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `longest` characters, and the keys of four characters at each position."""
    n = len(codes)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = codes
    key = ((padded[:n] << 15 | padded[1 : n + 1]) << 15 | padded[2 : n + 2]) << 15 | padded[3 : n + 3]
    order = np.argsort(key)
    step = 4
    while step < longest:
        sorted_key = key[order] if step == 4 else rank[order]
        new = np.empty(n, np.int64)
        if step == 4:
            change = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            new[order] = change
            rank = new
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        both = rank * (n + 2) + after
        order = np.argsort(both)
        sorted_both = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_both[1:] != sorted_both[:-1])])
        step *= 2
    return order, key


def ranges(vocabulary: PieceVocabulary, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes begin with it, four characters at a time."""
    v, n = vocabulary, len(order)
    padded_key = np.concatenate([key, np.zeros(4 * v.codes.shape[1], np.int64)])
    lo, hi = np.zeros(len(v.names), np.int64), np.full(len(v.names), n, np.int64)
    pack = lambda c: ((c[:, 0] << 15 | c[:, 1]) << 15 | c[:, 2]) << 15 | c[:, 3]
    for level in range(0, v.codes.shape[1], 4):
        some = np.flatnonzero((v.lengths > level) & (lo < hi))
        if not len(some):
            break
        part = v.codes[some, level : level + 4]
        open_end = np.where(part == 0, (1 << 15) - 1, part)
        for wanted, right, target in ((pack(part), False, "lo"), (pack(open_end), True, "hi")):
            a, b = lo[some].copy(), hi[some].copy()
            while True:
                go = a < b
                if not go.any():
                    break
                mid = (a + b) >> 1
                have = padded_key[order[np.minimum(mid, n - 1)] + level]
                below = (have <= wanted) if right else (have < wanted)
                a = np.where(go & below, mid + 1, a)
                b = np.where(go & ~below, mid, b)
            if target == "lo":
                first = a
            else:
                lo[some], hi[some] = first, a
    return lo, hi


class _Numbers(dict):
    """Parts and their numbers; a part that is asked for and new gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.fresh.append(part)
        return n


def _ranges_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + size) of each range, one after the other."""
    skip = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + skip


class PieceEncoder:
    """Encodes batches; keeps the pieces of parts it has seen."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.v = vocabulary
        known = "".join(re.escape(c) for c in vocabulary.alphabet if c != MARK)
        self.cut = re.compile(f"{MARK}?[{known}]+|{MARK}|.", re.S)
        self.clear()

    def clear(self):
        self.number = _Numbers()
        self.kept = 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Pieces of new parts, through one suffix array over all of them; other characters are bytes."""
        v = self.v
        plain = np.fromiter((p[-1] in v.alphabet for p in parts), bool, len(parts))
        sizes = np.zeros(len(parts), np.int64)
        some = [p for p, k in zip(parts, plain) if k]
        ids, sizes[plain] = self._relaxed(some) if some else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        raw = [v.byte_ids[np.frombuffer(parts[i].encode("utf-8", "surrogatepass"), np.uint8)] for i in np.flatnonzero(~plain)]
        sizes[~plain] = [len(x) for x in raw]
        ends = np.cumsum(sizes)
        new = np.zeros(int(ends[-1]), np.int32)
        new[_ranges_of((ends - sizes)[plain], sizes[plain])] = ids
        for i, x in zip(np.flatnonzero(~plain), raw):
            new[ends[i] - sizes[i] : ends[i]] = x
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.flat = np.concatenate([self.flat, new])
        self.kept += sum(map(len, parts))

    def _relaxed(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each one has."""
        v = self.v
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le"), np.uint32)
        letters = np.array([ord(c) for c in v.alphabet], np.uint32)
        by = np.argsort(letters)
        numbers = np.arange(1, len(letters) + 1)[by]
        at = np.minimum(np.searchsorted(letters[by], text), len(letters) - 1)
        codes = np.where(text == 0, 0, numbers[at]).astype(np.int64)
        order, key = suffix_array(codes, v.longest)
        lo, hi = ranges(v, order, key)
        count = np.where(v.usable, hi - lo, 0)
        # Edges are several times the text: 32-bit numbers do, as an index covers a slice.
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        begin = order.astype(np.int32)[_ranges_of(lo, count)]
        end = begin + v.lengths.astype(np.int32)[piece]
        # Edges by how far into its part each one ends: all parts are relaxed side by side.
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        depth = end - np.repeat(first, sizes + 1).astype(np.int32)[begin]
        by_depth = np.argsort(depth)
        begin, end, piece, depth = begin[by_depth], end[by_depth], piece[by_depth], depth[by_depth]
        is_first = np.zeros(len(text) + 1, bool)
        is_first[first] = True
        last = np.full(len(text) + 1, -1, np.int64)  # the piece that ends here, of the merged prefix
        bounds = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        for d in range(len(bounds) - 1):
            a, b = bounds[d], bounds[d + 1]
            s, e, p = begin[a:b], end[a:b], piece[a:b]
            start = is_first[s]
            ok = start.copy()
            inner = np.flatnonzero(~start & (last[s] >= 0))
            ok[inner] = v.compatible(last[s[inner]], p[inner])
            last[e[ok]] = p[ok]
        # Walk back from the ends, again side by side.
        at = first + sizes
        live = np.arange(len(parts))
        seen_part, seen_piece = [], []
        while len(live):
            p = last[at[live]]
            seen_part.append(live)
            seen_piece.append(p)
            at[live] -= v.lengths[p]
            live = live[at[live] > first[live]]
        part, chosen = np.concatenate(seen_part)[::-1], np.concatenate(seen_piece)[::-1]
        by_part = np.argsort(part, kind="stable")
        return v.ids[chosen[by_part]], np.bincount(part, minlength=len(parts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them; an empty text has none."""
        if self.kept > MOST_KEPT:
            self.clear()
        v, number = self.v, self.number
        front = MARK if v.front else ""
        found = [list(map(number.__getitem__, self.cut.findall(front + t.replace(" ", MARK)))) if t else [] for t in texts]
        if number.fresh:
            self.learn(number.fresh)
            number.fresh = []
        mark_id = v.ids[v.run_of_mark]
        out = []
        for row in found:
            r = np.array(row, np.int64)
            ids = self.flat[_ranges_of(self.starts[r], self.starts[r + 1] - self.starts[r])]
            out.append(self._runs(ids, mark_id) if len(ids) > 1 and v.runs else ids)
        return out

    def _runs(self, ids: np.ndarray, mark_id: int) -> np.ndarray:
        """Lone space marks side by side are merged last, from the left, into pieces as long as there are."""
        lone = ids == mark_id
        if not (lone[1:] & lone[:-1]).any():
            return ids
        longest = max(self.v.runs)
        out, i = [], 0
        change = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
        for a, b in zip(change[0::2], change[1::2]):
            out.append(ids[i:a])
            left = int(b - a)
            while left:
                k = min(left, longest)
                while k > 1 and k not in self.v.runs:
                    k -= 1
                out.append(np.array([self.v.runs[k] if k > 1 else mark_id], np.int32))
                left -= k
            i = b
        return np.concatenate([*out, ids[i:]])

    def decode(self, ids) -> str:
        """The text of some ids: bytes that are no UTF-8 become U+FFFD; the space put in front goes."""
        text = b"".join(map(self.v.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.front and text.startswith(" ") else text


def _slices(texts):
    """(first row, rows) of parts of at most SLICE bytes, or of one text: the arrays of an index follow these."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64))
    at, have = 0, 0.0
    for i, n in enumerate(sizes):
        if i > at and have + n > SLICE:
            yield at, i - at
            at, have = i, 0.0
        have += n
    if len(sizes):
        yield at, len(sizes) - at


SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the ids decoded again), round_trip (whether that is the text).

    Null and empty texts have no ids. A space mark (U+2581) in a text decodes to a space, which round_trip shows. Repeated
    rows are rows of their own; columns other than doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(PieceVocabulary(model))

    def run(batches):
        encoder = PieceEncoder(sent.value)
        for b in batches:
            for at, rows in _slices(b.column(1)):
                part = b.slice(at, rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(texts)
                back = [encoder.decode(x.tolist() if len(x) else []) for x in ids]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([x == t for x, t in zip(back, texts)]),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def op1_pieces_suffix_array(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", even=True))
