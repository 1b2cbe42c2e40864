"""Commands: which route a message takes, what part of it is checked, and how the message is put together again.

Routes are a few rows of configuration, so routing is one native expression over the message, first enabled route first;
no join multiplies messages by routes. `strict` mends two traits of the compatible mode: arguments to the end begin at the
first listed one (not after it), and a command is only cut off at a word's end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, Route

WORD_END = r"[\t-\r\x1c-\x20  -  -    　]"
GAP = r"[ \t\n\x0B\f\r]+"


def _begins(text: Column, command: str) -> Column:
    return F.startswith(F.lower(text), F.lit(command.lower()))


def matches_command(text: Column, route: Route) -> Column:
    """Starts with a slash and one of the commands, whatever the case, followed by white space or nothing."""
    hit = F.lit(False)
    for c in route.commands:
        after = F.substr(text, F.lit(len(c) + 1), F.lit(1))
        hit = hit | (_begins(text, c) & ((F.length(text) == len(c)) | after.rlike(WORD_END)))
    return F.startswith(text, F.lit("/")) & hit


def matches_prefix(text: Column, route: Route) -> Column:
    hit = F.lit(False)
    for p in route.prefixes:
        hit = hit | F.startswith(text, F.lit(p))
    return hit


def matches(text: Column, route: Route) -> Column:
    return (matches_prefix(text, route) | matches_command(text, route)) if route.prefix_mode else matches_command(text, route)


def route_name(text, config: EngineConfig) -> Column:
    """The first enabled route that takes a message, or null."""
    text = F.col(text) if isinstance(text, str) else text
    out = None
    for r in config.routes:
        if r.enabled:
            out = F.when(matches(text, r), r.name) if out is None else out.when(matches(text, r), r.name)
    return F.lit(None).cast("string") if out is None else out


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _split(text: Column) -> Column:
    """Words between white space; empty ones at the end go, one at the start stays, and an empty text is one empty word."""
    parts = F.split(F.regexp_replace(text, f"{GAP}$", ""), GAP, -1)
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(parts)


def _cases(text: Column, route: Route, strict: bool, inside, otherwise: Column) -> Column:
    """inside(command) for the first command that the message begins with."""
    out = None
    for c in route.commands:
        test = _begins(text, c)
        if strict:
            after = F.substr(text, F.lit(len(c) + 1), F.lit(1))
            test = test & ((F.length(text) == len(c)) | after.rlike(WORD_END))
        out = F.when(test, inside(c)) if out is None else out.when(test, inside(c))
    return otherwise if out is None else out.otherwise(otherwise)


def _dropped(rest: Column, count: int) -> tuple[Column, Column]:
    """What stands before and after the `count`-th white-space character; all is after it where there are fewer."""
    pattern = rf"(?s)^((?:[^{WORD_END[1:-1]}]*{WORD_END}){{{count - 1}}}[^{WORD_END[1:-1]}]*){WORD_END}(.*)$"
    return F.regexp_extract(rest, pattern, 1), F.when(rest.rlike(pattern), F.regexp_extract(rest, pattern, 2)).otherwise(rest)


def extract(text, route: Route, strict: bool = False) -> Column:
    """The part of a routed message that is checked."""
    text = F.col(text) if isinstance(text, str) else text

    def inside(c: str) -> Column:
        rest = _trim(F.substr(text, F.lit(len(c) + 1)))
        if not route.args:
            return rest
        if route.extend:
            n = min(route.args) - (1 if strict else 0)
            return _dropped(rest, n)[1] if n > 0 else rest
        words = _split(rest)
        picked = F.array(*[F.get(words, F.lit(a - 1)) for a in route.args])
        return F.array_join(F.filter(picked, lambda x: x.isNotNull()), " ")

    slash = F.startswith(text, F.lit("/"))
    plain = F.when(slash, _cases(text, route, strict, inside, _trim(F.substr(text, F.lit(2))))).otherwise(text)
    if not route.prefix_mode:
        return plain
    out = None
    for p in route.prefixes:
        value = _trim(F.substr(text, F.lit(len(p) + 1)))
        out = F.when(F.startswith(text, F.lit(p)), value) if out is None else out.when(F.startswith(text, F.lit(p)), value)
    return out.otherwise(plain if strict else text)


def rebuild(text, filtered, route: Route, strict: bool = False) -> Column:
    """The message with the checked part replaced."""
    text = F.col(text) if isinstance(text, str) else text
    filtered = F.col(filtered) if isinstance(filtered, str) else filtered

    def inside(c: str) -> Column:
        head = F.left(text, F.lit(len(c)))
        rest = _trim(F.substr(text, F.lit(len(c) + 1)))
        if not route.args:
            return F.concat(head, F.lit(" "), filtered)
        if route.extend:
            n = min(route.args) - (1 if strict else 0)
            if n <= 0:
                return F.concat(head, F.lit(" "), filtered)
            before, after = _dropped(rest, n)
            return F.when(after == rest, F.concat(head, F.lit(" "), filtered)).otherwise(F.concat(head, F.lit(" "), before, F.lit(" "), filtered))
        new = _split(filtered)
        listed = sorted(set(route.args))
        place = lambda i: F.size(F.filter(F.array(*[F.lit(a) for a in listed]), lambda a: a <= i))
        words = F.transform(
            _split(rest),
            lambda w, i: F.when((i + 1).isin(*listed) & (place(i + 1) <= F.size(new)), F.get(new, place(i + 1) - 1)).otherwise(w),
        )
        return F.concat(head, F.lit(" "), F.array_join(words, " "))

    plain = F.when(F.startswith(text, F.lit("/")), _cases(text, route, strict, inside, text)).otherwise(text)
    if not route.prefix_mode:
        return plain
    out = None
    for p in route.prefixes:
        value = F.concat(F.lit(p), filtered)
        out = F.when(F.startswith(text, F.lit(p)), value) if out is None else out.when(F.startswith(text, F.lit(p)), value)
    return out.otherwise(plain if strict else text)


def _by_route(name: str, config: EngineConfig, make) -> Column:
    out = None
    for r in config.routes:
        out = F.when(F.col(name) == r.name, make(r)) if out is None else out.when(F.col(name) == r.name, make(r))
    return F.lit(None).cast("string") if out is None else out


def route_messages(messages: DataFrame, config: EngineConfig, text: str = "text") -> DataFrame:
    """Routed messages with route and checked; others go (they are not commands of interest)."""
    routed = messages.withColumn("route", route_name(text, config)).where(F.col("route").isNotNull())
    return routed.withColumn("checked", _by_route("route", config, lambda r: extract(text, r, config.strict)))


def rebuild_messages(routed: DataFrame, config: EngineConfig, filtered: str = "filtered", text: str = "text") -> DataFrame:
    return routed.withColumn("rebuilt", _by_route("route", config, lambda r: rebuild(text, filtered, r, config.strict)))


def has_permission(messages: DataFrame, grants: DataFrame, permission: str, user: str = "user_id", without: bool = False) -> DataFrame:
    """Messages whose user holds a permission (or does not)."""
    holders = grants.where(F.col("permission") == permission).select(F.col("user_id").alias(user)).distinct()
    return messages.join(holders, user, "left_anti" if without else "left_semi")


def command_pattern(route: Route) -> str:
    """The same test as a regular expression, for other engines."""
    return "(?i)^(?:" + "|".join(re.escape(c) for c in route.commands) + r")(?:\s|$)"
