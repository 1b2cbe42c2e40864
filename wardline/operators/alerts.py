"""Alerts and escalation: templates, who gets them, and what follows from repeated violations. Actions are rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import render


def template(catalog: dict[str, str], level, kind: str) -> Column:
    """Of a level if the catalogue has one, else the general one, else the key itself."""
    level = F.col(level) if isinstance(level, str) else level
    general = f"warnings.{kind}"
    held = F.create_map(*[F.lit(x) for k, v in catalog.items() for x in (k, v)]) if catalog else F.create_map(F.lit(""), F.lit(""))
    return F.coalesce(F.try_element_at(held, F.concat(F.lit("levels."), level, F.lit(f".{kind}"))), F.try_element_at(held, F.lit(general)), F.lit(general))


def context_name(names: dict[str, str], kind) -> Column:
    """The shown name of a surface or route; without one (or an empty one) its own."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    if not names:
        return kind
    held = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.coalesce(F.nullif(F.try_element_at(held, kind), F.lit("")), kind)


def player_alerts(violations: DataFrame, catalog: dict[str, str]) -> DataFrame:
    """violations: msg_id, user_id, user_name, context, first_level, detected. One warning for each violation."""
    text = template(catalog, "first_level", "player-warning")
    return violations.select("msg_id", "user_id", F.lit("player").alias("audience"), text.alias("text"))


def admin_texts(violations: DataFrame, catalog: dict[str, str]) -> DataFrame:
    words = F.array_join(F.transform("detected", lambda d: d["word"]), ", ")
    text = render(template(catalog, "first_level", "admin-warning"), {"player": F.col("user_name"), "context": F.col("context"), "bannedword": words, "level": F.col("first_level")})
    return violations.select("msg_id", text.alias("text"))


def admin_alerts(violations: DataFrame, catalog: dict[str, str], admins: DataFrame) -> DataFrame:
    """Every online administrator gets every alert: that is what a broadcast is, and admins are few."""
    return admin_texts(violations, catalog).join(admins.select(F.col("user_id").alias("audience")), F.lit(True)).select("msg_id", "audience", "text")


def violation_numbers(violations: DataFrame, seconds: int, order: tuple[str, ...] = ("ts",), user: str = "user_id", level: str = "level", reset: str | None = None) -> DataFrame:
    """Adds bucket and number: how many violations of a level the user has had in this sweep interval, this one included.

    reset: a boolean column; such rows are no violations but start the user's counters anew, and are left out.
    """
    bucket = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")["start"]
    d = violations.withColumn("bucket", bucket)
    if not reset:
        return d.withColumn("number", F.row_number().over(Window.partitionBy(user, level, "bucket").orderBy(*order)))
    clear = F.coalesce(F.col(reset), F.lit(False))
    since = Window.partitionBy(user, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_era", F.sum(clear.cast("int")).over(since)).where(~clear)
    return d.withColumn("number", F.row_number().over(Window.partitionBy(user, level, "bucket", "_era").orderBy(*order))).drop("_era")


def violation_counts(violations: DataFrame, seconds: int, user: str = "user_id", level: str = "level") -> DataFrame:
    """Counters as they stand at the end of each interval: user, level, bucket, n."""
    bucket = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")["start"].alias("bucket")
    return violations.groupBy(user, level, bucket).agg(F.count("*").alias("n"))


def escalate(violations: DataFrame, punish: DataFrame, seconds: int, order: tuple[str, ...] = ("ts",), user: str = "user_id", level: str = "level") -> DataFrame:
    """One row for each command that a violation sets off: its number equals a threshold of its level."""
    numbered = violation_numbers(violations, seconds, order, user, level)
    due = punish.select(F.col("level").alias(level), F.col("threshold").alias("number"), "cmd_ord", "command")
    out = numbered.join(due, [level, "number"])
    return out.withColumn("command", render("command", {"player": F.coalesce(F.col("user_name") if "user_name" in violations.columns else F.col(user).cast("string"), F.col(user).cast("string"))}))


def merge_detections(hit, detected) -> Column:
    """A tracker's hit (a struct, may be null) before the detections of the text, each word and level once."""
    return F.array_distinct(F.concat(F.filter(F.array(hit), lambda x: x.isNotNull()), detected))


def first_of(detected, name: str) -> Column:
    return F.coalesce(F.get(detected, F.lit(0))[name], F.lit(""))


def words_of(detected) -> Column:
    return F.array_join(F.transform(detected, lambda d: d["word"]), ", ")
