"""Streaming twins: words across messages with keyed state, redaction, and violation counters by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EngineConfig
from ..operators.alerts import render
from ..operators.detect import redact_messages
from ..operators.track import IDLE_MS, TRACKED, State, TrackRules, _row, step


def redact_stream(messages: DataFrame, config: EngineConfig) -> DataFrame:
    """Redaction has no state: the batch operator works on streams as it is."""
    return redact_messages(messages, config)


def track_stream(messages: DataFrame, config: EngineConfig, lateness: str = "1 minute", reset: str | None = None, commands: bool = False) -> DataFrame:
    """track_messages over a stream: msg_id, user_id, text, seq, ts and the columns of TRACKED.

    States live in the state store by user. A user's rows of a micro-batch are put in order of (ts, seq); states go when the
    watermark has left them behind for a minute, or when a message comes that late. reset: a boolean column; such rows (a
    sign, a book or a name that was masked, say) clear their user's states. Messages without a user have no states.
    """
    rules = TrackRules.of(config, commands)
    columns = ["msg_id", "user_id", "text", "seq", "ts"]
    clear = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    nobody = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("msg_id"), F.lit(4096)))
    d = messages.withWatermark("ts", lateness).select(*columns, F.unix_millis("ts").alias("ms"), clear.alias("clear"), nobody.alias("nobody"))
    schema = f"msg_id bigint, user_id string, text string, seq bigint, ts timestamp, {TRACKED}"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        states = [State(*x) for x in json.loads(state.get[0])] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for t, now, gone in zip(rows["text"], rows["ms"], rows["clear"]):
            if gone:
                states = []
                out.append((t, None, None, False, []))
                continue
            hit, after = step(t, int(now), states, rules)
            states = after if key[0] is not None else []
            out.append(_row(t, hit, rules))
        if states:
            state.update((json.dumps([s.pack() for s in states]),))
            state.setTimeoutTimestamp(max(max(s.seen for s in states) + IDLE_MS + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        found = pd.DataFrame(out, columns=[x.split()[0] for x in TRACKED.split(", ")], index=rows.index)
        yield pd.concat([rows[columns], found], axis=1)

    return d.groupBy("user_id", "nobody").applyInPandasWithState(run, schema, "states string", "append", GroupStateTimeout.EventTimeTimeout)


def escalate_events(violations: DataFrame, config: EngineConfig, lateness: str = "1 minute", reset: str | None = None) -> DataFrame:
    """alerts.escalate over a stream, violation by violation: event_id, user_id, level, number, cmd_ord, command.

    violations: event_id, user_id, level, ts. A user's counters live in the state store, for the sweep interval that the user's last
    violation fell in; one of a later interval starts them anew, and so does a row with reset. Rows of a micro-batch are
    put in order of (ts, event_id); of an interval that has gone by they are counted by themselves.
    """
    seconds, punish = config.profile.sweep_seconds, config.punish
    clear = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    d = violations.withWatermark("ts", lateness).select("event_id", "user_id", "level", "ts", clear.alias("clear"), F.floor(F.unix_seconds("ts") / seconds).alias("bucket"))
    schema = "event_id bigint, user_id string, level string, number bigint, cmd_ord int, command string"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counters = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out, latest = [], 0
        for event, level, gone, bucket in zip(rows["event_id"], rows["level"], rows["clear"], rows["bucket"]):
            if gone:
                counters = {}
                continue
            at, n = counters.get(level, (bucket, 0))
            n = n + 1 if at == bucket else 1
            if bucket >= at:
                counters[level] = (int(bucket), n)
            latest = max(latest, int(bucket))
            out += [(event, key[0], level, n, i, c.replace("%player%", key[0] or "")) for i, c in enumerate(punish.get(level, {}).get(n, []))]
        if counters:
            state.update((json.dumps(counters),))
            state.setTimeoutTimestamp(max((max(latest, *(at for at, _ in counters.values())) + 1) * seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "level", "number", "cmd_ord", "command"])

    return d.groupBy("user_id").applyInPandasWithState(run, schema, "counters string", "append", GroupStateTimeout.EventTimeTimeout)


def escalate_stream(violations: DataFrame, config: EngineConfig, lateness: str = "1 minute") -> DataFrame:
    """Counters by user, level and sweep interval; a row for each command of a threshold that an interval reached.

    violations: user_id, level, ts. Intervals tumble by event time and are closed by the watermark; then a count of n has
    passed every threshold up to n once.
    """
    seconds = config.profile.sweep_seconds
    rows = [(lv, n, i, c) for lv, by in config.punish.items() for n, cs in by.items() for i, c in enumerate(cs)]
    punish = violations.sparkSession.createDataFrame(rows, "level string, threshold int, cmd_ord int, command string")
    counts = violations.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "user_id", "level").agg(F.count("*").alias("n"))
    due = counts.join(punish, "level").where(F.col("n") >= F.col("threshold"))
    return due.select("user_id", "level", F.col("w.start").alias("bucket"), "threshold", "cmd_ord", render("command", {"player": F.col("user_id")}).alias("command"))
