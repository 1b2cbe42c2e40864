"""Words that are spread over consecutive messages of a user.

One pure step works on a message and the user's states; the batch operator folds it over rows sorted by user and time,
batch by batch, so a user's messages are never held together; the streaming twin keeps the states in the state store.
Times are event times: states idle for more than a minute go when the next message comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.charmap import CharMap
from ..functions.markup import visible
from ..functions.matching import GapLimits, Rules, contains_word, mask_raw_suffix, mask_suffix, redact, reverse_word
from ..functions.units import to_units
from .detect import redact_messages

IDLE_MS = 60_000


@dataclass(frozen=True)
class TrackRules:
    """words: (word, level, limits, reversed too, gap in messages) in order."""

    words: tuple[tuple[str, str, GapLimits, bool, int], ...]
    allow: tuple[str, ...]
    fuzzy: bool
    charmap: CharMap
    redact: Rules
    mask_raw: bool = False

    @staticmethod
    def of(config: EngineConfig, commands: bool = False) -> TrackRules:
        rules = config.rules()
        words = tuple((w, level, limits, both, config.gap_of(level)) for w, level, limits, both in rules.words)
        return TrackRules(words, rules.allow, rules.fuzzy, rules.charmap, rules, commands and config.profile.mask_commands_raw)


@dataclass
class State:
    """place: how much of the word has come; quiet: messages since; done: whether all of it has, with its own counter."""

    word: int
    place: int
    quiet: int = 0
    after: int = 0
    done: bool = False
    seen: int = 0

    def pack(self) -> list:
        return [self.word, self.place, self.quiet, self.after, self.done, self.seen]


def _single(shown: str, rules: TrackRules, k: int) -> str | None:
    """The word or its reverse, whichever the message has by itself."""
    word, _, limits, both, _ = rules.words[k]
    for w in (word, reverse_word(word)) if both and len(to_units(word)) >= 2 else (word,):
        if contains_word(shown, w, limits, rules.fuzzy, rules.allow, rules.charmap):
            return w
    return None


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def step(text: str | None, now: int, states: list[State], rules: TrackRules):
    """The first hit of a message, as (word, level, whether it came over several messages) or None; and the states after it."""
    alive = lambda ss: [s for s in ss if now - s.seen <= IDLE_MS]
    if not text:
        return None, alive(states)
    shown = rules.charmap.normalize(visible(to_units(text)).lower())
    targets = [rules.charmap.normalize(to_units(w).lower()) for w, *_ in rules.words]
    hits = [(found, level, False) for k, (_, level, *_) in enumerate(rules.words) if (found := _single(shown, rules, k))]
    left = []
    for s in states:
        word, level, _, _, gap = rules.words[s.word]
        target = targets[s.word]
        if s.done:
            s.after += 1
            if gap <= 0 or s.after > gap:
                continue
            alone = _single(shown, rules, s.word)
            if alone or any(target.endswith(shown[-i:]) for i in range(1, min(len(shown), len(target)) + 1)):
                hits.append((alone or word, level, True))
        else:
            n = _common(shown, target[s.place :])
            if n:
                s.place, s.quiet = s.place + n, 0
                if s.place >= len(target):
                    hits.append((word, level, True))
                    s.done, s.after = True, 0
            else:
                s.quiet += 1
                if gap <= 0 or s.quiet > gap:
                    continue
        s.seen = now
        left.append(s)
    if not hits:
        for k, (_, _, _, _, gap) in enumerate(rules.words):
            target = targets[k]
            if gap > 0 and target:
                at = shown.find(target[0])
                while at >= 0:
                    n = _common(shown[at:], target)
                    if n < len(target):
                        left.append(State(k, n, seen=now))
                        break
                    at = shown.find(target[0], at + 1)
    return (hits[0] if hits else None), alive(left)


def outcome(text: str | None, hit, rules: TrackRules):
    """What becomes of a message: filtered text, detections (a hit first), and whether anything is reported."""
    masked = text
    if hit and hit[2]:
        masked = (mask_raw_suffix if rules.mask_raw else mask_suffix)(text, hit[0], rules.charmap) if not rules.mask_raw else mask_raw_suffix(text, hit[0])
        if rules.mask_raw:
            return masked, [hit[:2]]
    d = redact(masked, rules.redact)
    found = ([hit[:2]] if hit else []) + [x for x in d.found if not hit or x != hit[:2]]
    return d.filtered, (found if hit or d.filtered != masked else [])


TRACKED = "filtered string, hit_word string, hit_level string, crossed boolean, detected array<struct<word:string,level:string>>"


def _row(text, hit, rules):
    filtered, found = outcome(text, hit, rules)
    return filtered, hit[0] if hit else None, hit[1] if hit else None, bool(hit and hit[2]), [{"word": w, "level": x} for w, x in found]


def track_messages(messages: DataFrame, config: EngineConfig, user: str = "user_id", text: str = "text", order: tuple[str, ...] = ("ts", "seq"), reset: str | None = None, commands: bool = False) -> DataFrame:
    """Adds filtered, hit_word, hit_level, crossed and detected to messages (order[0] is a timestamp).

    One shuffle by user; rows of a partition are sorted and stream through the step, so memory follows the states. A user's
    messages are one after the other by nature; users are independent. reset: a boolean column; such rows clear the
    user's states and give no hit of their own (violations elsewhere do that). A message without a user is on its own.
    """
    rules = TrackRules.of(config, commands)
    ms = F.unix_millis(F.col(order[0]).cast("timestamp"))
    d = messages.withColumn("_ms", ms).withColumn("_reset", F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False))
    # Messages without a user belong to nobody: they have no states, and lie wherever there is room.
    nobody = F.when(F.col(user).isNull(), F.pmod(F.xxhash64(*order, text), F.lit(4096)))
    d = d.repartition(F.col(user), nobody).sortWithinPartitions(user, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, states, begun = None, [], False
        for b in batches:
            rows = []
            for u, t, now, clear in zip(b[user], b[text], b["_ms"], b["_reset"]):
                u = None if pd.isna(u) else u
                if not begun or u is None or u != who:
                    who, states, begun = u, [], True
                t = None if t is None or t != t else t
                if clear:
                    states = []
                    rows.append((t, None, None, False, []))
                    continue
                hit, states = step(t, 0 if pd.isna(now) else int(now), states, rules)
                rows.append(_row(t, hit, rules))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in TRACKED.split(", ")], index=b.index)
            yield pd.concat([b.drop(columns=["_ms", "_reset"]), out], axis=1)

    return d.mapInPandas(run, f"{fields}, {TRACKED}")


def shout_messages(messages: DataFrame, online: DataFrame, config: EngineConfig, user: str = "user_id", text: str = "text", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The entry for other programs: senders that are online are tracked; for others a message is redacted on its own and
    nothing is reported. online: a column of users; it may be any size, so the join is left to the optimizer."""
    here = online.select(F.col(user)).distinct().withColumn("_here", F.lit(True))
    d = messages.join(here, user, "left")
    tracked = track_messages(d.where(F.col("_here")).drop("_here").select(*messages.columns), config, user, text, order)
    alone = redact_messages(d.where(F.col("_here").isNull()).select(*messages.columns), config, text)
    none = F.lit(None).cast("string")
    quiet = F.array().cast("array<struct<word:string,level:string>>")
    alone = alone.select(*messages.columns, "filtered", none.alias("hit_word"), none.alias("hit_level"), F.lit(False).alias("crossed"), quiet.alias("detected"))
    return tracked.unionByName(alone)
