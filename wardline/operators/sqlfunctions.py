"""SQL functions over a configuration: redact, detect, contains_banned, normalize_text, redact_word.

A function is a SQL expression around a Python kernel: the native condition of detection says which texts the kernel sees, the
others get their answer without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.matching import contains_any, normalize_whole, redact, redact_word
from .detect import DETECTION, may_match_sql

FOUND = "ARRAY<STRUCT<word: STRING, level: STRING>>"
ASCII = r"t RLIKE r'\A[\x00-\x25\x27-\x3B\x3D-\x7F]*\z'"  # no markup


def register(spark: SparkSession, config: EngineConfig) -> None:
    """Makes the functions known to a session; registering again replaces them (a reload). Null texts give null."""
    rules = config.rules()
    options = {"fuzzy": rules.fuzzy, "allow": rules.allow, "charmap": rules.charmap}

    def texts(fn, kind: str):
        @F.pandas_udf(kind)
        def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([None if t is None else fn(t) for t in b])

        return kernel

    @F.pandas_udf(DETECTION)
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [None if t is None else redact(t, rules) for t in b]
            yield pd.DataFrame({"filtered": [d and d.filtered for d in found], "detected": [d and [{"word": w, "level": x} for w, x in d.found] for d in found]})

    @F.pandas_udf("string")
    def one_word(t: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([redact_word(x, y, **options) for x, y in zip(t, w)])

    spark.udf.register("wardline_redact", texts(lambda t: redact(t, rules).filtered, "string"))
    spark.udf.register("wardline_banned", texts(lambda t: contains_any(t, rules), "boolean"))
    spark.udf.register("wardline_normal", texts(normalize_whole, "string"))
    spark.udf.register("wardline_detect", detect)
    spark.udf.register("redact_word", one_word)
    seen = f"CASE WHEN {may_match_sql('t', rules)} THEN t END"
    for name, kind, body in (
        ("redact", "STRING", f"coalesce(wardline_redact({seen}), t)"),
        ("contains_banned", "BOOLEAN", f"CASE WHEN t IS NOT NULL THEN coalesce(wardline_banned({seen}), false) END"),
        ("normalize_text", "STRING", f"coalesce(wardline_normal(CASE WHEN NOT {ASCII} THEN t END), CASE WHEN {ASCII} THEN lower(t) END)"),
        (
            "detect",
            f"STRUCT<filtered: STRING, detected: {FOUND}>",
            f"""CASE WHEN t IS NOT NULL THEN named_struct('filtered', coalesce(wardline_detect({seen}).filtered, t),
                'detected', coalesce(wardline_detect({seen}).detected, CAST(array() AS {FOUND}))) END""",
        ),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
