"""Configuration: lexicon, limits, flags, allow-list, routes and escalation, from a dictionary or a YAML file.

Order counts: levels, words and routes keep the order in which they are written, and every table carries it. With
`hash_order` levels and routes come in the order that a hash table of strings with 32-bit string hashes would give.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.charmap import CharMap
from .functions.matching import GapLimits, Rules
from .functions.units import to_units


@dataclass(frozen=True)
class Profile:
    """Where the three hosts differ. fuzzy_default: without a fuzzy section; reread_redacted: signs are combined after
    redaction by line; author: book authors are checked; sweep_seconds: how often counters start anew."""

    name: str
    fuzzy_default: bool = True
    reread_redacted: bool = False
    author: bool = True
    sweep_seconds: int = 15
    mask_commands_raw: bool = True
    commands_need_permission: bool = True


PROFILES = {
    "server": Profile("server"),
    "proxy": Profile("proxy", sweep_seconds=30, mask_commands_raw=False),
    "mod": Profile("mod", fuzzy_default=False, reread_redacted=True, author=False, commands_need_permission=False),
}


@dataclass(frozen=True)
class Route:
    name: str
    enabled: bool = True
    args: tuple[int, ...] = ()
    extend: bool = False
    commands: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()

    @property
    def prefix_mode(self) -> bool:
        return bool(self.prefixes)


def parse_limits(value) -> GapLimits:
    """A map of classes (2 for each that is missing), or one number for all."""
    if isinstance(value, dict):
        return GapLimits(*(int(value.get(k, 2)) for k in ("chinese", "english", "others")))
    return GapLimits() if value is None else GapLimits.uniform(int(value))


def parse_args(value) -> tuple[int, ...]:
    """Comma-separated argument numbers; what is no positive number is dropped."""
    if value is None:
        return ()
    parts = value if isinstance(value, list) else str(value).split(",")
    return tuple(n for p in parts for t in [str(p).strip()] if t.lstrip("+").isascii() and t.lstrip("+").isdigit() for n in [int(t)] if n > 0)


def string_hash(text: str) -> int:
    h = 0
    for c in to_units(text):
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h


def hash_order(keys: list[str]) -> list[str]:
    """Keys by bucket of a chained hash table that starts with 16 buckets and doubles beyond three quarters."""
    size = 16
    while len(keys) > size * 0.75:
        size *= 2
    spread = lambda k: (h := string_hash(k)) ^ h >> 16
    return sorted(keys, key=lambda k: spread(k) & size - 1)


@dataclass(frozen=True)
class EngineConfig:
    words: dict[str, list[str]] = field(default_factory=dict)
    allow: tuple[str, ...] = ()
    fuzzy: bool = True
    limits: dict[str, GapLimits] = field(default_factory=dict)
    chatbox_gap: dict[str, int] = field(default_factory=dict)
    reverse: bool = True
    reverse_levels: dict[str, bool] = field(default_factory=dict)
    routes: tuple[Route, ...] = ()
    punish: dict[str, dict[int, list[str]]] = field(default_factory=dict)
    language: str = "en_US"
    charmap: CharMap = CharMap()
    profile: Profile = PROFILES["server"]
    strict: bool = False

    def limits_of(self, level: str) -> GapLimits:
        return self.limits.get(level, GapLimits())

    def gap_of(self, level: str) -> int:
        return self.chatbox_gap.get(level, 0)

    def reversed_too(self, level: str) -> bool:
        return self.reverse and self.reverse_levels.get(level, True)

    def rules(self) -> Rules:
        words = tuple((w, level, self.limits_of(level), self.reversed_too(level)) for level, ws in self.words.items() for w in ws if w)
        return Rules(words, self.allow, self.fuzzy, self.charmap, self.strict)

    # Tables, for joins.

    def lexicon(self, spark: SparkSession) -> DataFrame:
        rows = [(level, i, w, j) for i, (level, ws) in enumerate(self.words.items()) for j, w in enumerate(ws)]
        return spark.createDataFrame(rows, "level string, level_ord int, word string, word_ord int")

    def limits_table(self, spark: SparkSession) -> DataFrame:
        rows = [(level, (g.chinese, g.english, g.others)) for level, g in self.limits.items()]
        return spark.createDataFrame(rows, "level string, gap struct<chinese:int,english:int,others:int>")

    def routes_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.name, i, r.enabled, list(r.args), r.extend, list(r.commands), list(r.prefixes)) for i, r in enumerate(self.routes)]
        return spark.createDataFrame(rows, "name string, ord int, enabled boolean, args array<int>, extend boolean, commands array<string>, prefixes array<string>")

    def punish_table(self, spark: SparkSession) -> DataFrame:
        rows = [(level, n, i, c) for level, by in self.punish.items() for n, cs in by.items() for i, c in enumerate(cs)]
        return spark.createDataFrame(rows, "level string, threshold int, cmd_ord int, command string")

    def allow_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w,) for w in self.allow], "word string")


def from_dict(d: dict, profile: str = "server", ordered_by_hash: bool = False, charmap: CharMap = CharMap(), strict: bool = False) -> EngineConfig:
    p = PROFILES[profile]
    order = hash_order if ordered_by_hash else (lambda keys: keys)
    words = {str(k): [str(w) for w in v or []] for k, v in (d.get("banned-words") or {}).items()}
    fuzzy = d.get("fuzzy-match")
    levels = (fuzzy or {}).get("levels") or {}
    reverse = d.get("reverse-match") or {}
    plugins = d.get("external-plugins") or {}
    routes = {
        str(k): Route(
            str(k), bool(v.get("enable", True)), parse_args(v.get("args-number")), bool(v.get("extend-to-end", False)),
            tuple(map(str, v.get("commands") or [])), tuple(map(str, v.get("prefixes") or [])),
        )
        for k, v in plugins.items()
    }
    punish = (d.get("punish-commands") or {}).get("levels") or {}
    return EngineConfig(
        words={k: words[k] for k in order(list(words))},
        allow=tuple(str(w) for w in d.get("whitelist") or [] if w is not None),
        fuzzy=p.fuzzy_default if fuzzy is None else bool(fuzzy.get("enable", True)),
        limits={str(k): parse_limits(v.get("max-char-gap")) for k, v in levels.items()},
        chatbox_gap={str(k): int(v.get("max-chatbox-gap", 0)) for k, v in levels.items()},
        reverse=bool(reverse.get("enable", True)),
        reverse_levels={str(k): bool(v) for k, v in (reverse.get("levels") or {}).items()},
        routes=tuple(routes[k] for k in order(list(routes))),
        punish={str(k): {int(n): [str(c) for c in cs] for n, cs in v.items() if str(n).isdigit()} for k, v in punish.items()},
        language=str(d.get("language", "en_US")),
        charmap=charmap,
        profile=p,
        strict=strict,
    )


def load(path: str, defaults: dict | None = None, **options) -> EngineConfig:
    """The configuration in a YAML file on the driver; where there is none and defaults are given, they are written first."""
    import yaml

    if defaults is not None and not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(defaults, f, allow_unicode=True, sort_keys=False)
    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {}, **options)


class Engine:
    """What a host keeps: the configuration, its file, and the two verbs of an administrator."""

    def __init__(self, config: EngineConfig | None = None, path: str | None = None, **options):
        self.path, self.options = path, options
        self.config = config if config is not None else load(path, **options)

    def reload(self) -> EngineConfig:
        """The configuration read again from its file; without one it stays."""
        if self.path:
            self.config = load(self.path, **self.options)
        return self.config

    def info(self) -> dict:
        """Words are counted in every level that has them."""
        return {"words": sum(map(len, self.config.words.values())), "levels": len(self.config.words), "routes": len(self.config.routes), "profile": self.config.profile.name}

    def missing(self, installed, wanted) -> list[str]:
        """Wanted connectors that are not installed, in the order in which they are wanted."""
        return [w for w in wanted if w not in set(installed)]
