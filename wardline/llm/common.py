"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import spread


def table(spark: SparkSession, sf_dir: str, name: str, even: bool = False) -> DataFrame:
    """even: a table of a few small files is dealt over all cores, for what is done to its rows one by one."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if even else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the session names or has set; on a local master else a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wardline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach_by_key(df: DataFrame, keys: list[str], salt_by: list[str], partial: dict, final: dict, salts: int = 32) -> DataFrame:
    """df joined with aggregates over all rows of the same keys, without ever bringing a key's rows together.

    Rows are dealt by (keys, salt); partial aggregates (name: column) are per salt and final ones (name: column over the
    partial names) per key, over at most `salts` rows; the result goes back to each (keys, salt). Keys are never null.
    The partial step reads df once and the join once more: cut df first if it is costly.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    cells = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    groups = cells.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()], F.collect_list("_salt").alias("_salts"))
    back = groups.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The root (smallest row) of each of n rows that the pairs connect."""
    parent = np.arange(n)
    a, b = i, j
    while len(a):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return parent


HELD_EDGES = 1 << 20


def _contracted(batches):
    """Edges of a partition as stars (node, smallest node it reaches in here), about HELD_EDGES at a time."""
    held: list[np.ndarray] = []

    def stars():
        e = np.concatenate(held)
        nodes, at = np.unique(e, return_inverse=True)
        root = forest(len(nodes), *at.reshape(-1, 2).T)
        some = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["a", "b"])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))
        if sum(map(len, held)) >= HELD_EDGES:
            yield stars()
            held.clear()
    if held:
        yield stars()


def components(edges: DataFrame, salts: int = 32, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: bigint): node, root (the smallest node that can be reached).

    Alternates two kinds of round: nodes point their larger neighbours, then their smaller ones, at the smallest node they
    know, until nothing changes (a logarithmic number of rounds for paths). Before and after, each partition replaces what
    edges it happens to hold by stars. A hub's edges are only handled as (hub, salt). Each round is cut through the
    checkpoint folder; only counts reach the driver.
    """
    least = {"low": F.min("b")}, {"low": F.min("low")}

    def round_of(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            seen = attach_by_key(both, ["a"], ["b"], *least, salts).withColumn("low", F.least("a", "low"))
            out = seen.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            seen = attach_by_key(down, ["a"], ["b"], *least, salts)
            out = seen.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(seen.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first())

    contracted = lambda e: cut(e.mapInArrow(_contracted, "a bigint, b bigint"))
    e = contracted(edges.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct())
    before = state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        e = contracted(round_of(cut(round_of(e, True)), False))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
