"""Column functions: markup, folding and matching as native expressions, where they need no positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup
from .charmap import HAN, CharMap
from .matching import GapLimits


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_codes(text) -> Column:
    """Colour codes go, in the fixed order; tags stay."""
    text = col(text)
    for p in (markup.SPREAD_HEX, markup.SHORT_HEX, markup.LEGACY, markup.HEX_TAG):
        text = F.regexp_replace(text, p, "")
    return text


def canonical_hex(text) -> Column:
    """Both spellings of hexadecimal colours as <#...>."""
    spread = F.regexp_replace(col(text), markup.SPREAD_HEX, "<#$1$2$3$4$5$6>")
    return F.regexp_replace(spread, markup.SHORT_HEX, "<#$1>")


def spread_hex(text) -> Column:
    """Only the spelling with one code for each digit."""
    return F.regexp_replace(col(text), markup.SPREAD_HEX, "<#$1$2$3$4$5$6>")


def strip_tags(text) -> Column:
    return F.regexp_replace(col(text), f"(?s){markup.TAG}", "")


def strip_everything(text) -> Column:
    """Codes and tags go, payloads with them."""
    text = col(text)
    for p in (markup.SPREAD_HEX, markup.SHORT_HEX, f"(?s){markup.TAG}", markup.LEGACY):
        text = F.regexp_replace(text, p, "")
    return text


def any_tags(text) -> Column:
    """Everything that looks like a tag, whatever its name."""
    return F.regexp_extract_all(col(text), F.lit(markup.ANY_TAG), F.lit(0))


def fold(text, charmap: CharMap) -> Column:
    """The character map, character by character."""
    keys = "".join(charmap.replace)
    return F.translate(col(text), keys, "".join(charmap.replace[k] for k in keys)) if keys else col(text)


def compress(text) -> Column:
    return F.regexp_replace(col(text), r"(?s)(.)\1+", "$1")


def class_counts(text) -> Column:
    """struct<chinese, english, others> of a text's characters."""
    t = col(text)
    han, latin = F.regexp_count(t, F.lit(f"[{HAN}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.struct(han.alias("chinese"), latin.alias("english"), (F.length(t) - han - latin).alias("others"))


def contains_exact(text, word: str) -> Column:
    """Whether the lower-case text has the word, allow-list aside."""
    return F.contains(F.lower(col(text)), F.lit(word.lower()))


def positions(text, word: str) -> Column:
    """0-based starts of all occurrences in the lower-case text, overlapping ones too: the text is split before each one."""
    t, w = F.lower(col(text)), F.lit(word.lower())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        begins = (acc["at"] > 0) | F.startswith(t, w)  # the first piece may be what stands before all of them
        found = F.when(begins, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), found.alias("found"))

    pieces = F.split(t, f"(?={re.escape(word.lower())})", -1)
    return F.when(contains_exact(text, word), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(F.array().cast("array<int>"))


def _unit(c: str) -> str:
    return re.escape(c) if c.isascii() else c


def embedding_pattern(word: str, most: int) -> str:
    """The earliest embedding of a word with at most so many characters in each gap; it never backtracks into a gap."""
    return _unit(word[0]) + "".join((f"[^{_unit(c)}]{{0,{most}}}" if most else "") + _unit(c) for c in word[1:])


def gap_pattern(word: str, limits: GapLimits) -> str:
    """Look-ahead with the earliest embedding of a word from each start; windows are filtered by gap_matches."""
    return f"(?s)(?=({embedding_pattern(word, limits.most)}))"


def gap_matches(text, word: str, limits: GapLimits) -> Column:
    """Windows of a (normalised) text that match a word within the limits."""
    found = F.regexp_extract_all(col(text), F.lit(gap_pattern(word, limits)), F.lit(1))
    charmap = CharMap()
    kinds = [charmap.classify(c) for c in word]

    def keeps(m: Column) -> Column:
        n = class_counts(m)
        gap = [n["chinese"] - kinds.count(0), n["english"] - kinds.count(1), n["others"] - kinds.count(2)]
        return (F.length(m) - len(word) <= limits.most) & (gap[0] <= limits.chinese) & (gap[1] <= limits.english) & (gap[2] <= limits.others)

    return F.filter(found, keeps)


def contains_gap(text, word: str, limits: GapLimits) -> Column:
    """As it stands, or with repeated characters taken together."""
    return (F.size(gap_matches(text, word, limits)) > 0) | (F.size(gap_matches(compress(text), word, limits)) > 0)


def mask_exact(text, word: str) -> Column:
    """Every occurrence of a word, whatever its case, as asterisks; for texts without markup."""
    return F.regexp_replace(col(text), f"(?i){re.escape(word)}", "*" * len(word))


def render(template, values: dict) -> Column:
    """%key% gives way to its value, one key after the other; a null value leaves an empty place."""
    out = col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"%{k}%"), F.coalesce(col(v).cast("string"), F.lit("")))
    return out


def shortest_common_suffix(text, word) -> Column:
    """Length of the shortest end of the text that the word ends with too; null if there is none."""
    t, w = F.lower(col(text)), F.lower(col(word))
    n = F.least(F.length(t), F.length(w))
    return F.array_min(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.right(t, i) == F.right(w, i)))
