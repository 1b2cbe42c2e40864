"""Operator 8: repeated substrings, by suffix arrays over shards of the text.

A byte goes if a string of `length` bytes over it also starts earlier. Every such window has a key, the smallest of the
32-byte hashes inside it (leftmost of equal ones), and equal windows have equal keys at equal places. So windows that
follow each other with the same key place form a run, and only runs whose key occurs again anywhere can hold repeats:

1. Documents are dealt to shards of about 2 MB by a hash of their id. A shard sorts its keys and cuts the list by binary
   search at the bounds of the merging tasks; a merging task tells each shard which of its keys occur again.
2. A shard sends the runs with such keys (the bytes that their windows cover) to the merging tasks, cut by binary search
   again; runs that are the same throughout are sent once a shard.
   A key that more than HOT_SHARDS shards name (a line that very many documents share, say) is not brought together: its
   windows are sent one by one, by a hash of their bytes, so they spread evenly; a shard sends a window once.
3. A merging task joins equal runs, which are compared by their bytes. Where a key has different runs, it builds a suffix array over them: Larsson-Sadakane
   refinement (only groups that are still tied are sorted again), then Kasai's common prefixes, walked over all runs side
   by side, and neighbours that share `length` bytes are one class whose earliest window stays.
4. A shard takes the windows that repeat, removes the bytes they cover and hashes the rest.

Scale: the texts are shuffled once, and that exchange serves steps 1, 2 and 4. A passage in many documents is a key that a
shard names twice at most and a run that it sends once, so a merging task gets a few rows of it for each shard; beyond
HOT_SHARDS shards they are 36 bytes for each window and shard, dealt by the windows' hashes (two of 64 bits decide there).
A window costs about fifteen times its share of a run, so HOT_SHARDS is no lower than a task's memory asks for: what a few
hundred shards send of one key is tens of megabytes at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LENGTH = 100
GRAM = 32
SHARD_BYTES = 2 << 20
PART = 1 << 18
HOT_SHARDS = 512

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_U = np.uint64


def _powers(base, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, at least n of each; kept by the worker."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        have = _tables[int(base)] = _powers(base, n), _powers(_U(pow(int(base), -1, 1 << 64)), n)
    return have


class RangeHash:
    """Hashes of any ranges of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, base):
        n = len(data)
        up, self.down = _power_tables(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + size) of each range, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and at b are the same, range by range, about a megabyte at a time."""
    out = size_a == size_b
    live = np.flatnonzero(out)
    ends = np.cumsum(size_a[live])
    for lo in np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, 1 << 20), "right")):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        some = live[lo:hi]
        differ = data[_ranges(a[some], size_a[some])] != data[_ranges(b[some], size_a[some])]
        out[some] = np.add.reduceat(differ, np.cumsum(size_a[some]) - size_a[some]) == 0
    return out


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    n = len(key) - width + 1
    m, span = key, 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[width - span : width - span + n])


class Shard:
    """The texts of a shard as bytes, rows by (doc_id, text) with null ids last, and the runs of their windows."""

    def __init__(self, t: pa.Table, length: int = LENGTH):
        ids = t.column("doc_id").to_pylist()
        texts = [(x or "").encode() for x in t.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        texts = [texts[i] for i in order]
        self.rank = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.data, self.length = np.frombuffer(b"".join(texts), np.uint8), length
        self._runs(length)

    def _runs(self, length: int) -> None:
        """start (of the first window), count (of windows), key, and two hashes of the bytes the windows cover.

        A few documents at a time, and a long one in parts: memory follows PART, whatever a shard holds.
        """
        found, i, begin = [], 0, 0
        while i < len(self.ends):
            j = i + 1
            while j < len(self.ends) and begin == self.begins[i] and self.ends[j] - begin <= PART:
                j += 1
            last = min(begin + PART, self.ends[i]) if j == i + 1 else self.ends[j - 1]
            stop = min(last + length - 1, self.ends[i]) if j == i + 1 else last  # windows that start before `last`
            found.append(self._part(begin, int(stop), length))
            if last < self.ends[j - 1]:
                begin = int(last)
            else:
                i, begin = j, int(last)
        names = ("start", "count", "row", "key", "g1", "g2")
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        for k, (name, kind) in enumerate(zip(names, kinds)):
            setattr(self, name, np.concatenate([np.zeros(0, kind), *[f[k] for f in found if f]]))
        self.offset = self.start - (self.begins[self.row] if len(self.row) else 0)

    def _part(self, begin: int, stop: int, length: int):
        data = self.data[begin:stop]
        n, gram = len(data), min(GRAM, length)
        if n < length:
            return None
        h1 = RangeHash(data, _B1)
        at = np.arange(n - gram + 1)
        h = h1(at, at + gram)
        place = _window_min((h >> _U(32) << _U(32)) | at.astype(np.uint64), length - gram + 1) & _U(0xFFFFFFFF)
        starts = np.arange(len(place))
        row = np.searchsorted(self.ends, starts + begin, "right")
        ok = starts + begin + length <= self.ends[row]
        starts, place, row = starts[ok], place[ok].astype(np.int64), row[ok]
        if not len(starts):
            return None
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
        start, count = starts[new], np.diff(np.append(new, len(starts)))
        end = start + count + length - 1
        # The smallest of many hashes is small: mixed again, keys are spread evenly over the merging tasks.
        return start + begin, count, row[new], _mix(h[place[new]]), h1(start, end), RangeHash(data, _B2)(start, end)

    def later_copies(self) -> np.ndarray:
        """Runs that are the same throughout as an earlier one of this shard."""
        order = np.lexsort((self.start, self.g2, self.g1, self.key))
        k, a, b = self.key[order], self.g1[order], self.g2[order]
        out = np.zeros(len(order), bool)
        like = np.flatnonzero((k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        one, two, size = order[like], order[like + 1], self.count + self.length - 1
        out[two[same_bytes(self.data, self.start[one], self.start[two], size[one], size[two])]] = True
        return out

    def windows(self, runs: np.ndarray):
        """Starts of the windows of some runs with two hashes of their bytes, sorted by these, and which of them are the
        first of their like."""
        at = _ranges(self.start[runs], self.count[runs])
        h = np.empty((2, len(at)), np.uint64)
        powers = [_power_tables(base, self.length)[0][: self.length] for base in (_B1, _B2)]
        for a in range(0, len(at), 8192):
            m = self.data[at[a : a + 8192, None] + np.arange(self.length)].astype(np.uint64) + _U(1)
            for i, p in enumerate(powers):
                h[i, a : a + 8192] = _mix((m * p).sum(1, dtype=np.uint64))
        order = np.lexsort((at, h[1], h[0]))
        at, h = at[order], h[:, order]
        return at, h, np.concatenate([[True], (h[0, 1:] != h[0, :-1]) | (h[1, 1:] != h[1, :-1])]) if len(at) else np.zeros(0, bool)


def _cuts(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the merging tasks' ranges begin in a sorted list of keys, by binary search."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, bounds), [len(sorted_keys)]])


def _by_part(cuts: np.ndarray):
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), int(cuts[p]), int(cuts[p + 1])


KEYS = "part int, shard int, keys binary"
AGAIN = "part int, shard int, keys binary, hot binary"
_AGAIN_FIELDS = [("part", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())]


def _send_keys(parts: int, length: int):
    def run(key, t):
        s = Shard(t, length)
        k, n = np.unique(s.key, return_counts=True)
        rows = []
        for p, a, b in _by_part(_cuts(k, parts)):
            rows.append((p, key[0].as_py(), np.sort(np.concatenate([k[a:b], k[a:b][n[a:b] > 1]])).tobytes()))
        return _table(rows, [("part", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary())])

    return run


def _table(rows, fields) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))


def _repeated_keys(most: int):
    def run(key, t):
        """For each shard those of its keys that occur again, hot ones apart."""
        lists = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        k, n = np.unique(np.concatenate(lists), return_counts=True)
        own = [np.unique(x) for x in lists]
        named, shards = np.unique(np.concatenate(own), return_counts=True)
        hot = named[shards > most]
        again = np.setdiff1d(k[n > 1], hot, assume_unique=True)
        rows = []
        for shard, x in zip(t.column("shard").to_pylist(), own):
            some, warm = np.intersect1d(x, again, assume_unique=True), np.intersect1d(x, hot, assume_unique=True)
            if len(some) or len(warm):
                rows.append((key[0].as_py(), shard, some.tobytes(), warm.tobytes()))
        return _table(rows, _AGAIN_FIELDS)

    return run


RUNS = "part int, shard int, runs binary, bytes binary, windows binary"
_RUN_FIELDS = [("part", pa.int32()), ("shard", pa.int32()), ("runs", pa.binary()), ("bytes", pa.binary()), ("windows", pa.binary())]
_RUN = np.dtype([("key", "<u8"), ("g1", "<u8"), ("g2", "<u8"), ("rank", "<i8"), ("row", "<i4"), ("offset", "<i8"), ("count", "<i8")])
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("rank", "<i8"), ("row", "<i4"), ("offset", "<i8")])


def _numbers_in(column) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint64))


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _send_runs(parts: int, length: int):
    def run(key, docs, keys):
        if not keys.num_rows or not docs.num_rows:
            return _table([], _RUN_FIELDS)
        s, shard = Shard(docs, length), key[-1].as_py()
        fresh = ~s.later_copies()
        some = np.flatnonzero(_among(_numbers_in(keys.column("keys")), s.key) & fresh)
        some = some[np.argsort(s.key[some], kind="stable")]
        out = np.zeros(len(some), _RUN)
        for name, values in (("key", s.key), ("g1", s.g1), ("g2", s.g2), ("row", s.row), ("offset", s.offset), ("count", s.count)):
            out[name] = values[some]
        out["rank"] = s.rank[s.row[some]]
        size = s.count[some] + length - 1
        data = s.data[_ranges(s.start[some], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = [(p, shard, out[a:b].tobytes(), data[ends[a] : ends[b]].tobytes(), None) for p, a, b in _by_part(_cuts(out["key"], parts))]
        at, h, first = s.windows(np.flatnonzero(_among(_numbers_in(keys.column("hot")), s.key) & fresh))
        at, h = at[first], h[:, first]
        wide = np.zeros(len(at), _WINDOW)
        row = np.searchsorted(s.ends, at, "right")
        wide["h1"], wide["h2"], wide["rank"], wide["row"], wide["offset"] = h[0], h[1], s.rank[row], row, at - s.begins[row]
        rows += [(p, shard, None, None, wide[a:b].tobytes()) for p, a, b in _by_part(_cuts(wide["h1"], parts))]
        return _table(rows, _RUN_FIELDS)

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of some bytes in order: Larsson-Sadakane refinement.

    The first sort is by seven bytes; then groups that are still tied are sorted by the place of what follows, which
    doubles the bytes that count. A suffix's place is the first of its group, so untied ones keep theirs.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + _U(1)
    key = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits a byte: the end is less than any byte
        key = (key << _U(9)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = head
    step = 7
    while step < n:
        size = np.bincount(place, minlength=n)
        tied = np.flatnonzero(size[place[order]] > 1)
        if not len(tied):
            break
        who = order[tied]
        after = np.where(who + step < n, place[np.minimum(who + step, n - 1)] + 1, 0)
        by = np.lexsort((after, place[who]))
        who, after = who[by], after[by]
        own = place[who]
        order[tied] = who
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        place[who] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffix at each position shares with the one before it in the order, `most` at most.

    Kasai's walk: what position i shares is at least what i - 1 shares, less one. All runs are walked side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    have = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    t = 0
    while True:
        live = live[sizes[live] > t]
        if not len(live):
            return out
        at = starts[live] + t
        other = before[at]
        h = np.where(other >= 0, have[live], 0)
        grow = np.flatnonzero(other >= 0)
        while len(grow):
            i, j, g = at[grow], other[grow], h[grow]
            inside = (g < most) & (i + g < n) & (j + g < n)
            grow, i, j, g = grow[inside], i[inside], j[inside], g[inside]
            same = text[i + g] == text[j + g]
            grow = grow[same]
            h[grow] += 1
        out[at] = h
        have[live] = np.maximum(h - 1, 0)
        t += 1


REPEATS = "part int, shard int, repeats binary"
_REPEAT = np.dtype([("row", "<i4"), ("offset", "<i8"), ("count", "<i8")])


def repeats_of(runs: np.ndarray, data: np.ndarray, shard: np.ndarray, length: int = LENGTH):
    """(run, window, count) of windows that also start earlier, for runs of any shards with their bytes."""
    size = runs["count"] + length - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((runs["offset"], runs["row"], runs["rank"], runs["g2"], runs["g1"], runs["key"]))
    k, a, b = runs["key"][order], runs["g1"][order], runs["g2"][order]
    copy = np.zeros(len(order), bool)
    like = np.flatnonzero((k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    copy[like + 1] = same_bytes(data, begin[order[like]], begin[order[like + 1]], size[order[like]], size[order[like + 1]])
    found = [np.stack([order[copy], np.zeros(copy.sum(), np.int64), runs["count"][order[copy]]], 1)]
    kept = order[~copy]
    keys = runs["key"][kept]
    several = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)
    several[:-1] |= several[1:]
    some = kept[several]
    if len(some):
        some = some[np.lexsort((runs["offset"][some], runs["row"][some], runs["rank"][some]))]  # by where they start
        sizes = size[some]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        skip = _ranges(np.zeros(len(sizes), np.int64), sizes)
        text = data[_ranges(begin[some], sizes)]
        sa = suffix_order(text)
        lcp = common_prefixes(text, sa, starts, sizes, length)
        window = skip < np.repeat(runs["count"][some], sizes)  # where a whole window begins
        group = np.cumsum(lcp[sa] < length)
        mask = window[sa]
        pos, group = sa[mask], group[mask]  # positions are in the order of where windows start
        first = np.full(int(group[-1]) + 1 if len(group) else 1, len(text), np.int64)
        np.minimum.at(first, group, pos)
        late = np.zeros(len(text), np.int8)
        late[pos[pos > first[group]]] = 1
        owner = np.repeat(np.arange(len(some)), sizes)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], late, [0]])))
        a, b = edges[0::2], edges[1::2]
        found.append(np.stack([some[owner[a]], skip[a], b - a], 1))
    return np.concatenate(found)


def _later_windows(t):
    """(shard, row, offset) of the windows that also start earlier, of those that came one by one."""
    lists = [(shard, np.frombuffer(x, _WINDOW)) for shard, x in zip(t.column("shard").to_pylist(), t.column("windows").to_pylist()) if x]
    w = np.concatenate([np.zeros(0, _WINDOW), *[x for _, x in lists]])
    shard = np.repeat(np.array([i for i, _ in lists], np.int64), [len(x) for _, x in lists])
    order = np.lexsort((w["offset"], w["row"], w["rank"], w["h2"], w["h1"]))
    w, shard = w[order], shard[order]
    later = np.flatnonzero((w["h1"][1:] == w["h1"][:-1]) & (w["h2"][1:] == w["h2"][:-1])) + 1
    out = np.zeros(len(later), _REPEAT)
    out["row"], out["offset"], out["count"] = w["row"][later], w["offset"][later], 1
    return shard[later], out


def _merge(length: int):
    def run(key, t):
        lists = [(shard, np.frombuffer(x, _RUN)) for shard, x in zip(t.column("shard").to_pylist(), t.column("runs").to_pylist()) if x]
        runs = np.concatenate([np.zeros(0, _RUN), *[x for _, x in lists]])
        shard = np.repeat(np.array([i for i, _ in lists], np.int64), [len(x) for _, x in lists])
        data = np.frombuffer(b"".join(x or b"" for x in t.column("bytes").to_pylist()), np.uint8)
        found = repeats_of(runs, data, shard, length)
        out = np.zeros(len(found), _REPEAT)
        out["row"] = runs["row"][found[:, 0]]
        out["offset"] = runs["offset"][found[:, 0]] + found[:, 1]
        out["count"] = found[:, 2]
        to, more = _later_windows(t)
        to, out = np.concatenate([shard[found[:, 0]], to]), np.concatenate([out, more])
        by = np.argsort(to, kind="stable")
        out, to = out[by], to[by]
        rows = []
        if len(to):
            new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            rows = [(key[0].as_py(), int(to[a]), out[a:b].tobytes()) for a, b in zip(new[:-1], new[1:])]
        return _table(rows, [("part", pa.int32()), ("shard", pa.int32()), ("repeats", pa.binary())])

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
RESULT_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _remove(length: int, emit_text: bool):
    def run(key, docs, repeats):
        fields = [*RESULT_FIELDS, *([("kept", pa.binary())] if emit_text else [])]
        if not docs.num_rows:
            return _table([], fields)
        s = Shard(docs, length)
        delta = np.zeros(len(s.data) + 1, np.int64)
        late = s.later_copies()
        np.add.at(delta, s.start[late], 1)
        np.add.at(delta, s.start[late] + s.count[late] + length - 1, -1)
        at, _, first = s.windows(np.flatnonzero(_among(_numbers_in(repeats.column("hot")), s.key) & ~late))
        np.add.at(delta, at[~first], 1)
        np.add.at(delta, at[~first] + length, -1)
        for x in repeats.column("repeats").to_pylist():
            r = np.frombuffer(x or b"", _REPEAT)
            at = s.begins[r["row"]] + r["offset"]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + r["count"] + length - 1, -1)
        gone = np.cumsum(delta[:-1]) > 0
        rows = []
        for i, doc_id in enumerate(s.ids):
            g = gone[s.begins[i] : s.ends[i]]
            d = s.data[s.begins[i] : s.ends[i]]
            kept = d[~g].tobytes() if g.any() else d.tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (g[0] if len(g) else 0))
            rows.append((doc_id, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if emit_text else [])))
        return _table(rows, fields)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, emit_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document (and kept, the bytes themselves, if asked for).

    Null texts count as empty, null ids come last. Rows that repeat a doc_id are documents of their own, in the order of
    their texts. Empty input gives an empty result; columns other than doc_id and text are ignored.
    """
    by_shard, again, runs = runs_of(docs, length, shard_bytes)
    repeats = runs.groupBy("part").applyInArrow(_merge(length), REPEATS)
    told = repeats.unionByName(again.select("part", "shard", "hot").where("length(hot) > 0"), allowMissingColumns=True)
    return by_shard.cogroup(told.groupBy("shard")).applyInArrow(_remove(length, emit_text), RESULT + (", kept binary" if emit_text else ""))


def runs_of(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES):
    """The documents by shard, which keys of a shard occur again, and what the shards send to the merging tasks."""
    d = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    by_shard = d.groupBy("shard")
    keys = by_shard.applyInArrow(_send_keys(n, length), KEYS)
    again = keys.groupBy("part").applyInArrow(_repeated_keys(HOT_SHARDS), AGAIN)
    return by_shard, again, by_shard.cogroup(again.groupBy("shard")).applyInArrow(_send_runs(n, length), RUNS)


def op8_substring_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The same over every window of 100 bytes.
OP8_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i AS s, b[i + 1 : i + 100] AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM b)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
i AS (SELECT *, sum(CASE WHEN s <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM f)),
r AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY doc_id, island),
k AS (SELECT r.doc_id, a, e, hex(b[coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1 : a]) AS piece, max(e) OVER (PARTITION BY r.doc_id) AS last, b FROM r JOIN b USING (doc_id)),
d AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || hex(any_value(b)[any_value(last) + 1 :]) AS kept FROM k GROUP BY doc_id)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN d.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM b LEFT JOIN d ON d.doc_id = b.doc_id
"""
