"""Operator 6: near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of at least c are within eps = sqrt(2 - 2c) of each other. Vectors are turned onto their
principal axes (from the covariance of all of them), cut into grid cells of eps on the leading ones, and sorted by cell.
Intervals of that sequence are joined recursively: a pair of intervals is cut into pairs of parts unless their bounding
boxes are further apart than eps. On the cluster the recursion runs over a tree of blocks (joins by parent); inside a task
it goes on over smaller parts, down to matrix products in single precision. What these put near the threshold, by more
than their error, is decided in double precision.

Scale: rows with the same vector are one node, whatever their ids, found by (hash, salt). The sequence is carried as tiles
(rows of packed bytes); a block is a run of tiles, an eighth of the vectors of its length but BLOCK_BYTES at most, so a
table of any size up to eight blocks sends each vector to at most nine tasks. What a pair of blocks gives back is at most one row
for each of its vectors (links counted, and one edge of a spanning forest), never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, components, cut, table

TILE_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 8
PART = 512
LEADING = 8
BOX = 16
FAN = 8
MOST_AXES = 256  # components that axes are fitted to; the others are axes of their own
MOST_LENGTHS = 8  # lengths, the most frequent ones, that have fitted axes


def _usable(v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _by_length(batch):
    """(length, rows, matrix) for each length among the lists of a batch's column v."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = v.value_lengths().to_numpy()
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        some = v if len(rows) == len(v) else v.take(pa.array(rows))
        yield int(n), rows, some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    scaled = m / np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Axes:
    """Orthonormal axes for each length: by falling variance where they are fitted, those of the components elsewhere."""

    def __init__(self):
        self.fitted: dict[int, np.ndarray] = {}

    def turn(self, u: np.ndarray) -> np.ndarray:
        axes = self.fitted.get(u.shape[1])
        if axes is None:
            return u
        k = len(axes)
        return u @ axes if k == u.shape[1] else np.concatenate([u[:, :k] @ axes, u[:, k:]], 1)


def principal_axes(reps: DataFrame, lengths: list[int]) -> Axes:
    """Partitions add up their products; the driver gets MOST_AXES squared numbers for each length at most."""

    def run(batches):
        sums = {n: np.zeros((min(n, MOST_AXES), min(n, MOST_AXES) + 2)) for n in lengths}
        for b in batches:
            for n, _, m in _by_length(b):
                if n in sums:
                    u = unit(m)[:, :MOST_AXES]
                    sums[n][:, :-2] += u.T @ u
                    sums[n][:, -2] += u.sum(0)
                    sums[n][:, -1] += len(u)
        for n, m in sums.items():
            if m.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), n)), pa.array(np.arange(len(m))), pa.array(list(m))], ["n", "i", "row"])

    out = Axes()
    rows = reps.select("v").mapInArrow(run, "n bigint, i bigint, row array<double>")
    rows = rows.select("n", "i", F.posexplode("row").alias("j", "x")).groupBy("n", "i", "j").agg(F.sum("x").alias("x"))
    found = rows.groupBy("n", "i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("row")).collect()
    for n in lengths:
        m = np.array([[x["x"] for x in r["row"]] for r in sorted((r for r in found if r["n"] == n), key=lambda r: r["i"])])
        if len(m):
            mean = m[:, -2] / m[0, -1]
            _, axes = np.linalg.eigh(m[:, :-2] / m[0, -1] - np.outer(mean, mean))
            out.fitted[n] = axes[:, ::-1]
    return out


class _Forest:
    """Components of the vectors of a pair of blocks, as linked pairs come in."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


class _Side:
    """A block in a task: its vectors as they came, unit ones in single precision, and the boxes of its parts."""

    def __init__(self, v: np.ndarray, weight: np.ndarray, axes: Axes):
        self.v, self.weight = v, weight
        self.u = np.empty(v.shape, np.float32)
        self.starts = np.arange(0, len(v), PART)
        self.lo, self.hi = (np.empty((len(self.starts), v.shape[1])) for _ in range(2))
        for k, a in enumerate(self.starts):
            u = unit(v[a : a + PART])
            self.u[a : a + PART] = u
            x = axes.turn(u)
            self.lo[k], self.hi[k] = x.min(0), x.max(0)


def _gap2(lo1, hi1, lo2, hi2):
    d = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return (d * d).sum(-1)


def join_blocks(a: _Side, b: _Side | None, cosine: float, eps: float):
    """Links between the vectors of two blocks, or within one (b is None): counts by weight, and roots within the pair."""
    same = b is None
    b = a if same else b
    shift = 0 if same else len(a.v)
    links = np.zeros(shift + len(b.v))
    weight = b.weight if same else np.concatenate([a.weight, b.weight])
    forest = _Forest(len(links))
    error = max(1e-6, a.v.shape[1] * 1.2e-7)  # of a product in single precision, with room to spare
    stack = [(0, len(a.starts), 0, len(b.starts))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue
        if _gap2(a.lo[a0:a1].min(0), a.hi[a0:a1].max(0), b.lo[b0:b1].min(0), b.hi[b0:b1].max(0)) > eps * eps:
            continue  # provably distant
        if a1 - a0 > 1 or b1 - b0 > 1:
            ma, mb = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            for p in [(a0, ma), (ma, a1)] if a1 - a0 > 1 else [(a0, a1)]:
                for q in [(b0, mb), (mb, b1)] if b1 - b0 > 1 else [(b0, b1)]:
                    stack.append((*p, *q))
            continue
        if same and b0 < a0:
            continue
        i0, j0 = a.starts[a0], b.starts[b0]
        c = a.u[i0 : i0 + PART] @ b.u[j0 : j0 + PART].T
        hit = c >= cosine - error
        if not hit.any():
            continue
        i, j = np.nonzero(hit)
        if same and a0 == b0:
            i, j = i[i < j], j[i < j]
        close = np.flatnonzero(c[i, j] < cosine + error)
        if len(close):
            exact = (unit(a.v[i[close] + i0]) * unit(b.v[j[close] + j0])).sum(1) >= cosine
            keep = np.ones(len(i), bool)
            keep[close] = exact
            i, j = i[keep], j[keep]
        i, j = i + i0, j + j0 + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        forest.add(i, j)
    return links.astype(np.int64), forest.roots(np.arange(len(links)))


def link_vectors(vectors: DataFrame, cosine: float = 0.95, tile_bytes: int = TILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing and is its own
    component; vectors of different lengths never link. Every other row counts as a vector of its own: rows that repeat a
    vec_id, with the same vector or another one, and rows without an id. A component is named by the smallest id in it
    (null if it has none), and kept says whether a row's id is that name. Empty input gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, dtype = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    width = np.dtype(dtype).itemsize
    v = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(kind).alias("v"))
    good = F.coalesce(_usable(F.col("v")), F.lit(False))
    unlinked = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Rows have numbers of their own from here on; the cut fixes them.
    rows = cut(v.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(17), "v").alias("k2")))
    # Rows with the same vector are one node, the first of them, and weigh as many.
    groups = {"node": F.min("row"), "first": F.min("vec_id"), "n": F.count("*")}, {"node": F.min("node"), "first": F.min("first"), "n": F.sum("n")}
    members = cut(attach_by_key(rows.select("row", "vec_id", "k1", "k2"), ["k1", "k2"], ["row"], *groups).select("row", "vec_id", "node", "first", "n"))
    reps = cut(rows.select("row", "v").join(members.where("row = node").select("row", "first", "n"), "row"))
    lengths = reps.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("count"))
    most = lengths.where("count > 1").orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    total = lengths.agg(F.sum(F.col("dim") * F.col("count") * width)).first()[0] or 0
    axes = principal_axes(reps, sorted(r["dim"] for r in most))
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-4

    def to_cells(batches):
        for b in batches:
            cells = np.empty(b.num_rows, object)
            for n, at, m in _by_length(b):
                for i, c in zip(at, np.floor(axes.turn(unit(m))[:, :LEADING] / eps).astype(np.int32)):
                    cells[i] = c
            sizes = b.column(1).value_lengths()
            yield pa.RecordBatch.from_arrays([*b.columns, sizes, pa.array(list(cells), pa.list_(pa.int32()))], ["row", "v", "n", "dim", "cell"])

    gridded = reps.select("row", "v", "n").mapInArrow(to_cells, f"row bigint, v {kind}, n bigint, dim int, cell array<int>")
    # The sequence in grid order, in ranges; a range is packed into tiles.
    order = ["dim", "cell", "row"]
    ordered = gridded.repartitionByRange(max(1, -(-int(total) // (4 * tile_bytes))), *order).sortWithinPartitions(*order)

    def to_tiles(batches):
        from pyspark import TaskContext

        part, k, dim, held = TaskContext.get().partitionId(), 0, 0, []

        def tiles(last: bool):
            nonlocal k, held
            size = max(1, tile_bytes // (dim * width)) if dim else 1
            while sum(len(h[0]) for h in held) >= size or (last and held):
                i, m, n = (np.concatenate(x) for x in zip(*held))
                x = axes.turn(unit(m[:size]))[:, :BOX]
                columns = [
                    pa.array([part << 32 | k], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([i[:size].tobytes()]),
                    pa.array([m[:size].astype(dtype).tobytes()]), pa.array([n[:size].tobytes()]), pa.array([x.min(0)]), pa.array([x.max(0)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["tile", "dim", "rows", "ids", "vs", "ns", "lo", "hi"])
                k += 1
                held = [(i[size:], m[size:], n[size:])] if len(i) > size else []

        for b in batches:
            for n, at, m in _by_length(b):  # lengths ascend, as the order has them first
                if n != dim:
                    yield from tiles(True)
                    dim = n
                held.append((b.column(0).to_numpy()[at], m, b.column(2).to_numpy()[at]))
                yield from tiles(False)
        yield from tiles(True)

    tiles = cut(ordered.select("row", "v", "n").mapInArrow(to_tiles, "tile bigint, dim int, rows bigint, ids binary, vs binary, ns binary, lo array<double>, hi array<double>"))
    # Blocks are runs of tiles; the windows go over one narrow row for each tile.
    of_dim = Window.partitionBy("dim")
    most_rows = F.greatest(F.lit(1024), F.least(F.ceil(F.sum("rows").over(of_dim) / LEAST_BLOCKS), F.floor(F.lit(block_bytes) / (F.col("dim") * width))))
    before = F.coalesce(F.sum("rows").over(of_dim.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tiles.select("tile", "dim", "rows").withColumn("block", F.floor(before / most_rows).cast("long")).select("tile", "block")
    tiles = tiles.join(placed, "tile")
    pairs = block_pairs(tiles.select("dim", "block", "lo", "hi"), eps)
    side = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block")
    payload = pairs.select("dim", "a", "b", side).join(tiles.select("dim", "block", "tile", "ids", "vs", "ns"), ["dim", "block"])

    def join_pair(key, t):
        dim, blocks = key[0].as_py(), t.column("block").to_numpy()
        sides, ids = [], []
        for block in np.unique(blocks):
            at = np.flatnonzero(blocks == block)
            at = at[np.argsort(t.column("tile").to_numpy()[at])]
            unpack = lambda name, kind: np.concatenate([np.frombuffer(t.column(name)[int(i)].as_py(), kind) for i in at])
            ids.append(unpack("ids", np.int64))
            sides.append(_Side(unpack("vs", dtype).reshape(-1, dim), unpack("ns", np.int64), axes))
        links, roots = join_blocks(sides[0], sides[1] if len(sides) > 1 else None, cosine, eps)
        ids = np.concatenate(ids)
        some = np.flatnonzero(links)
        return pa.table({"node": ids[some], "links": links[some], "root": ids[roots[some]]})

    found = cut(payload.groupBy("dim", "a", "b").applyInArrow(join_pair, "node bigint, links bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = roots.join(members.where("row = node").select("node", "first"), "node")
    named = attach_by_key(cut(linked), ["root"], ["node"], {"name": F.min("first")}, {"name": F.min("name")})
    by_node = counts.join(named.select("node", "name"), "node", "left")
    # Back to all rows: a node's result is joined by (node, salt), so a hot one is not brought together.
    m = members.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(32)).cast("int"))
    spread = by_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    out = m.join(spread, ["node", "salt"], "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("name", "first").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(unlinked)


def block_pairs(tiles: DataFrame, eps: float) -> DataFrame:
    """(dim, a, b), a <= b, of the blocks of a length whose boxes are within eps; tiles: dim, block, lo, hi.

    Goes down from the root of a tree over the sequence: a node is FAN parts of it, and a pair of nodes that are not
    provably distant gives pairs of their children, by joins on the parents.
    """
    sides = [F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in range(BOX)], [F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in range(BOX)]
    up = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(BOX)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(BOX)]
    levels = [cut(tiles.groupBy("dim", F.col("block").alias("at")).agg(*sides[0], *sides[1]))]
    n = (levels[0].agg(F.max("at")).first()[0] or 0) + 1
    while n > 1:
        levels.append(levels[-1].groupBy("dim", F.floor(F.col("at") / FAN).alias("at")).agg(*up))
        n = -(-n // FAN)
    gap = lambda i: F.coalesce(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), F.lit(0.0))
    far = sum((gap(i) * gap(i) for i in range(BOX)), F.lit(0.0)) > eps * eps
    pairs = levels[-1].select("dim", F.col("at").alias("p"), F.col("at").alias("q"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("parent", F.floor(F.col("at") / FAN))
        joined = pairs.join(child.alias("x"), (pairs["dim"] == F.col("x.dim")) & (F.col("p") == F.col("x.parent"))).drop(pairs["dim"])
        joined = joined.join(child.alias("y"), (F.col("x.dim") == F.col("y.dim")) & (F.col("q") == F.col("y.parent")))
        pairs = joined.where((F.col("x.at") <= F.col("y.at")) & ~far).select(F.col("x.dim").alias("dim"), F.col("x.at").alias("p"), F.col("y.at").alias("q"))
    return cut(pairs.select("dim", F.col("p").alias("a"), F.col("q").alias("b")))


def op6_vectors_grid_order(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


#: The same over all pairs and the closure of their links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, p.y FROM r JOIN p ON p.x = r.node),
c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON x = c.vec_id
"""
