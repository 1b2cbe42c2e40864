"""Documents of several parts: signs of four lines, books of pages with a title and an author, and names of items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .detect import DETECTION, detection, may_match, redact_messages


def combine(parts) -> Column:
    """Parts joined by line feeds; null parts are empty."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), "\n")


def starts(parts) -> Column:
    """0-based start of each part in the combined text, in characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(F.coalesce(p, F.lit(""))) + 1).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def split(text, at, count) -> Column:
    """The parts of a text of the same length again: from each start to the next, less the line feed between them."""
    n = F.length(text)

    def part(i: Column) -> Column:
        begin = F.coalesce(F.get(at, i), n)
        end = F.when(i < count - 1, F.coalesce(F.get(at, i + 1), n)).otherwise(n)
        piece = F.substr(text, begin + 1, F.greatest(end - begin, F.lit(0)))
        return F.when((i < count - 1) & F.endswith(piece, F.lit("\n")), F.left(piece, F.length(piece) - 1)).otherwise(piece)

    return F.transform(F.sequence(F.lit(0), count - 1), part)


def collect_parts(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """key and parts, an array in order, from a row for each part."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p")).select(key, F.transform("p", lambda p: p[text]).alias("parts"))


def redact_signs(signs: DataFrame, config: EngineConfig, parts: str = "parts") -> DataFrame:
    """Adds lines, detected and changed. Lines are redacted one by one; what only their combination shows counts over
    that. The combination is of the lines as they are, or as they have been redacted, as the profile says."""
    rules, reread = config.rules(), config.profile.reread_redacted

    @F.pandas_udf(f"lines array<string>, {DETECTION}")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from ..functions.matching import redact

        for rows in batches:
            out = []
            for lines in rows:
                if lines is None:
                    out.append((None, None, None))
                    continue
                lines = [x or "" for x in lines]
                each = [redact(x, rules) for x in lines]
                new = [d.filtered for d in each]
                found = list(dict.fromkeys(w for d, x in zip(each, lines) if d.filtered != x for w in d.found))
                base = new if reread else lines
                whole = "\n".join(base)
                both = redact(whole, rules)
                if both.filtered != whole:
                    new = split_text(both.filtered, base)
                    found = list(dict.fromkeys([*found, *both.found]))
                out.append((new, "\n".join(new), [{"word": w, "level": x} for w, x in found]))
            yield pd.DataFrame(out, columns=["lines", "filtered", "detected"])

    # What a line holds its combination with the others holds too, so that says which signs the kernel need not see.
    plain = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    d = signs.withColumn("_plain", plain).withColumn("_whole", combine("_plain"))
    d = d.withColumn("_d", kernel.asNondeterministic()(F.when(may_match("_whole", rules), F.col("_plain"))))
    none = F.array().cast("array<struct<word:string,level:string>>")
    d = d.withColumn("lines", F.coalesce("_d.lines", "_plain")).withColumn("detected", F.coalesce("_d.detected", none))
    return d.withColumn("changed", F.col("lines") != F.col("_plain")).drop("_d", "_plain", "_whole")


def split_text(text: str, parts: list[str]) -> list[str]:
    """split, in Python: masking is one for one in units, so parts keep their sizes."""
    from ..functions.units import from_units, to_units

    units, out, at = to_units(text), [], 0
    for p in parts:
        n = len(to_units(p))
        out.append(from_units(units[at : at + n]))
        at += n + 1
    return out


def _split_units(text: Column, parts: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, list(p)) for t, p in zip(texts, lists)])

    return run(text, parts)


def redact_books(books: DataFrame, config: EngineConfig) -> DataFrame:
    """books: parts (pages), title, author. Adds pages, new_title, new_author, detected (pages, then title, then author,
    not merged), first_word and changed. Pages are checked together, so words across page ends are found."""
    rules, author = config.rules(), config.profile.author
    d = books.withColumn("_whole", combine(F.coalesce("parts", F.array().cast("array<string>"))))
    d = d.withColumn("_p", detection("_whole", rules)).withColumn("_t", detection("title", rules))
    d = d.withColumn("_a", detection("author", rules) if author else F.lit(None).cast("struct<filtered:string,detected:array<struct<word:string,level:string>>>"))
    filtered = F.coalesce("_p.filtered", "_whole")
    # Masks are one for one in units: texts with characters of two units are split by units.
    wide = F.col("_whole").rlike(r"[^\x{0}-\x{FFFF}]") & (filtered != F.col("_whole"))
    empty = F.array().cast("array<string>")
    none = F.transform(F.coalesce("parts", empty), lambda p: F.coalesce(p, F.lit("")))
    native = F.when(F.size("parts") > 0, split(filtered, starts(F.col("parts")), F.size("parts"))).otherwise(empty)
    by_units = _split_units(F.when(wide, filtered), F.when(wide, none))
    d = d.withColumn("pages", F.when(wide, by_units).when(filtered == F.col("_whole"), none).otherwise(native))
    d = d.withColumn("new_title", F.coalesce("_t.filtered", "title")).withColumn("new_author", F.coalesce("_a.filtered", "author"))
    none = F.array().cast("array<struct<word:string,level:string>>")
    d = d.withColumn("detected", F.concat(*[F.coalesce(f"{x}.detected", none) for x in ("_p", "_t", "_a")]))
    d = d.withColumn("first_word", F.coalesce(F.get("detected", F.lit(0))["word"], F.lit("")))
    changed = (filtered != F.col("_whole")) | ~F.col("new_title").eqNullSafe(F.col("title")) | ~F.col("new_author").eqNullSafe(F.col("author"))
    return d.withColumn("changed", changed).drop("_whole", "_p", "_t", "_a")


def redact_names(names: DataFrame, config: EngineConfig) -> DataFrame:
    """Item names (user_id, bypass, name): those without a name or of users with the bypass permission go."""
    some = names.where(F.col("name").isNotNull() & (F.col("name") != "") & ~F.coalesce("bypass", F.lit(False)))
    return redact_messages(some, config, "name")
