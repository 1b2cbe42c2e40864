"""Sources: messages of all surfaces in one shape, from tables or streams, and the tables of configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charmap import CharMap, parse_charmap

SCHEMA = "msg_id bigint, user_id string, user_name string, surface string, text string, seq bigint, ts timestamp"
SURFACES = ("chat", "command", "prefix", "sign", "book", "anvil", "shout")


def as_messages(rows: DataFrame, surface: str, **columns) -> DataFrame:
    """Rows in the shape of SCHEMA. columns: expressions for its columns; others are null; empty texts go (no event)."""
    fields = [f.split() for f in SCHEMA.split(", ")]
    exprs = {"surface": F.lit(surface)} | {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}
    out = rows.select(*[exprs.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    return out.where(F.col("text").isNotNull() & (F.col("text") != "")) if surface in ("chat", "command", "prefix", "shout") else out


def union(*sources: DataFrame) -> DataFrame:
    """All sources as one stream or table, by name; a connector that is absent is simply not given."""
    return reduce(lambda a, b: a.unionByName(b), [s for s in sources if s is not None])


def read(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Messages from files, of a schema that is stated and not inferred."""
    reader = (spark.readStream if stream else spark.read).format(fmt).schema(SCHEMA).options(**options)
    return reader.load(path)


def conversations_as_chat(conversations: DataFrame) -> DataFrame:
    """Turns as the messages of one user for each conversation, a second apart."""
    ts = F.timestamp_seconds(F.col("turn"))
    key = F.xxhash64("conv_id", "turn", "role")
    return as_messages(conversations, "chat", msg_id=key, user_id=F.col("conv_id").cast("string"), user_name=F.col("role"), text="text", seq="turn", ts=ts)


def read_catalog(spark: SparkSession, nested: dict, lang: str, fallback: dict | None = None) -> DataFrame:
    """Message templates (lang, key, template) with dotted keys; the fallback counts only if there are none."""
    flat = flatten(nested) or flatten(fallback or {})
    return spark.createDataFrame([(lang, k, v) for k, v in flat.items()], "lang string, key string, template string")


def flatten(nested: dict, at: str = "") -> dict[str, str]:
    out = {}
    for k, v in nested.items():
        out |= flatten(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": str(v)}
    return out


def read_charmap(spark: SparkSession, paths: dict[str, str]) -> CharMap:
    """Character tables by kind ('chinese', 'english' or others) from text files. They are small and read on the driver."""
    return parse_charmap((kind, [r["value"] for r in spark.read.text(p).collect()]) for kind, p in paths.items())
