"""Detection and redaction over DataFrames.

The kernel runs over Arrow batches; what goes there is first narrowed by a native condition, and rows that cannot match
are passed as nulls, which cost nothing. The condition is sound: in a text that normalisation leaves as it is but for case,
a match is an embedding of some word with gaps of at most the largest limit, as the text stands or with repeats taken
together; texts with markup or other characters always go to the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import columns as C
from ..functions.charmap import CharMap
from ..functions.columns import embedding_pattern
from ..functions.matching import GapLimits, Rules, contains_any, normalize_word, redact, redact_once, redact_word
from ..functions.units import from_units, to_units

DETECTION = "filtered string, detected array<struct<word:string,level:string>>"


#: Characters that normalisation leaves alone but for their case; everything else, and markup, is for the kernel.
PLAIN = r"\x00-\x7FÀ-ÿ¡¿«»©®°"
MOST_PATTERNS = 400


SMALL_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores where a table is in fewer files than there are cores and holds fewer than
    SMALL_BYTES for each: its few row groups would keep the others idle. Larger tables stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES * cores and len(df.inputFiles()) < cores else df


def _patterns(rules: Rules) -> list[str]:
    """For each spelling of each word a pattern that finds it, or more: every gap may be as long as the largest limit."""
    out = []
    for word, _, limits, both in rules.words:
        for spelling in [word, word[::-1]] if both and len(to_units(word)) >= 2 else [word]:
            needle = normalize_word(spelling, rules.charmap)
            if needle:
                # The native side counts characters, of which a gap has no more than units.
                out.append(embedding_pattern(from_units(needle), limits.most if rules.fuzzy else 0))
    return list(dict.fromkeys(out))


def _unusual() -> str:
    return f"[^{PLAIN}]|[<&§]"


def may_match(text, rules: Rules) -> Column:
    """False only where the kernel would find nothing: one scan for all words, and one more with repeats taken together."""
    t = F.col(text) if isinstance(text, str) else text
    low = C.fold(F.lower(t), rules.charmap)
    patterns = _patterns(rules)
    if not patterns:
        return F.lit(False)
    if len(patterns) > MOST_PATTERNS:  # too long an alternation: then the kernel sees every text
        return t.isNotNull()
    every = "(?s)" + "|".join(patterns)
    hit = low.rlike(every)
    if rules.fuzzy:
        hit = hit | C.compress(low).rlike(every)
    return t.rlike(_unusual()) | hit


def may_match_sql(text: str, rules: Rules) -> str:
    """may_match as SQL text, for functions that are defined in SQL."""
    raw = lambda p: "r'" + p.replace("'", r"\x27") + "'"
    plain = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    patterns = _patterns(rules)
    if not patterns:
        return "false"
    if len(patterns) > MOST_PATTERNS:
        return f"{text} IS NOT NULL"
    low, keys = f"lower({text})", "".join(rules.charmap.replace)
    if keys:
        low = f"translate({low}, {plain(keys)}, {plain(''.join(rules.charmap.replace[k] for k in keys))})"
    every = raw("(?s)" + "|".join(patterns))
    tests = [f"{text} RLIKE {raw(_unusual())}", f"{low} RLIKE {every}"]
    if rules.fuzzy:
        tests.append(f"regexp_replace({low}, r'(?s)(.)\\1+', '$1') RLIKE {every}")
    return "(" + " OR ".join(tests) + ")"


def detection(text, rules: Rules, recheck: bool = True) -> Column:
    """struct<filtered, detected> of a text; null where nothing can match."""
    run = redact if recheck else redact_once

    @F.pandas_udf(DETECTION)
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [None if t is None else run(t, rules) for t in texts]
            yield pd.DataFrame({"filtered": [d and d.filtered for d in found], "detected": [d and [{"word": w, "level": x} for w, x in d.found] for d in found]})

    t = F.col(text) if isinstance(text, str) else text
    # Not that it were random: a condition on the result must not make the optimizer run the kernel a second time.
    return kernel.asNondeterministic()(F.when(may_match(t, rules), t))


def redact_messages(messages: DataFrame, config: EngineConfig, text: str = "text", recheck: bool = True) -> DataFrame:
    """Adds filtered, detected, first_word, first_level and changed (which alone makes a violation)."""
    d = messages.withColumn("_d", detection(text, config.rules(), recheck))
    return (
        d.withColumn("filtered", F.coalesce("_d.filtered", text))
        .withColumn("detected", F.coalesce("_d.detected", F.array().cast("array<struct<word:string,level:string>>")))
        .withColumn("first_word", F.coalesce(F.get("detected", F.lit(0))["word"], F.lit("")))
        .withColumn("first_level", F.coalesce(F.get("detected", F.lit(0))["level"], F.lit("")))
        .withColumn("changed", F.col("filtered").isNotNull() & (F.col("filtered") != F.col(text)))
        .drop("_d")
    )


def flagged(messages: DataFrame, config: EngineConfig, text: str = "text") -> DataFrame:
    """Messages with any word of the lexicon, as it is or reversed (a semi-join with the lexicon)."""
    rules = config.rules()

    @F.pandas_udf("boolean")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t is not None and contains_any(t, rules) for t in texts])

    # Not that it were random: the optimizer must not move the kernel in front of what deals out the rows.
    return messages.where(kernel.asNondeterministic()(F.when(may_match(text, rules), F.col(text))))


def detections_long(redacted: DataFrame, key: str) -> DataFrame:
    """One row for each detected word: key, word, level, place."""
    return redacted.select(key, F.posexplode("detected").alias("place", "d")).select(key, "d.word", "d.level", "place")


def redact_one_word(messages: DataFrame, word: str, text: str = "text", **options) -> DataFrame:
    """Adds filtered: every match of one word masked. options: those of redact_word."""
    rules = Rules(((word, "", options.get("limits", GapLimits()), False),), (), options.get("fuzzy", True), options.get("charmap", CharMap()))

    @F.pandas_udf("string")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact_word(t, word, **options) for t in texts])

    return messages.withColumn("filtered", F.coalesce(kernel(F.when(may_match(text, rules), F.col(text))), F.col(text)))


def words_in(messages: DataFrame, config: EngineConfig, key: str, text: str = "text") -> DataFrame:
    """Theta join of messages and lexicon on exact containment: key, level, word. One pass over the text: the lexicon is
    part of the expression, so nothing is multiplied before the test."""
    low = F.lower(F.col(text))
    hits = [F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(level).alias("level"), F.lit(w).alias("word"))) for level, ws in config.words.items() for w in ws]
    return messages.select(key, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).select(key, "x.level", "x.word")


def drop_allowed(matches: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Anti join: matches (key, start, end) that no cover (key, start, end) holds."""
    c = covers.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return matches.join(c, (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left_anti")


def select_spans(spans: Column) -> Column:
    """From an array of struct<start: bigint, end: bigint, ...>: left to right, longer first, those that do not overlap what is chosen."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("ord"), s.alias("span"))))
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.filter(spans, lambda s: F.lit(False)).alias("kept"))
    step = lambda acc, x: F.when(
        x["start"] >= acc["end"], F.struct(x["span"]["end"].alias("end"), F.concat(acc["kept"], F.array(x["span"])).alias("kept"))
    ).otherwise(acc)
    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])
