"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment (native).

Targets: sources share all words by weight; none goes beyond `cap` times its own words, the excess being shared
again (closed form of water filling). The words are dealt out as blocks of `block_words`: seats go to the highest
quotients target / (2s + 1). Seats are house-monotone, so the apportionments at the shards' ends give every source integer
quotas for each of the mix's shards. A source's documents lie on a line in a seeded hash order; its blocks are taken along
that line from a seeded block on, around its end as often as its seats ask for, the quota of the first shard first. So a
shard's blocks are runs of whole documents but for the two at its ends. `shard` says where a document comes first.

Scale: a source is only handled as (source, one of 4096 hash buckets), so a source with a third of all rows is dealt
out evenly; positions on the line are bucket offsets plus a running sum within a bucket. Windows over sources hold one row
for each source, and N_SHARDS for the quotas, in one task: meant for some hundreds of thousands of sources at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK_WORDS = 16
N_SHARDS = 24
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _targets(sources: DataFrame, cap: int) -> DataFrame:
    """sources: source, source_size. Adds ord, weight, target. One row for each source: small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sources.withColumn("ord", F.row_number().over(by_name)).withColumn("weight", ((F.col("ord") - 1) % 3 + 1).cast("long"))
    s = s.withColumn("cap", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("all_words"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)).alias("weight_before"),
    )
    full = F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("all_words") - F.col("cap_before"))
    s = s.withColumn("full", full)
    s = s.withColumn("left_words", F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    s = s.withColumn("left_weight", F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("left_words")).cast("double") / F.col("left_weight").cast("double")
    )
    return s.withColumn("target", target)


def source_quotas(sources: DataFrame, n_shards: int = 1, block_words: int = BLOCK_WORDS, cap: int = 3) -> DataFrame:
    """source, source_size, target, shard (1 to n_shards), seats (of the mix up to this shard's end), quota (of this shard).

    Only quotients near a source's fair share are ranked: with n sources, rounding and caps move at most 2n + 2 seats,
    which fall to sources in proportion; seats further below are certain, seats further above are out of reach.
    """
    every = Window.partitionBy("shard")
    s = _targets(sources, cap).withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    s = s.withColumn("seats_in_all", F.floor(F.floor(F.col("all_words") / block_words) * F.col("shard") / n_shards))
    s = s.withColumn("most", F.floor(F.col("cap") / block_words))
    s = s.withColumn("share", F.when(F.col("all_words") > 0, F.col("target") / F.col("all_words")).otherwise(0.0) * F.col("seats_in_all"))
    s = s.withColumn("n", F.count("*").over(every))
    s = s.withColumn("open", F.greatest(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("share"))).over(every), F.lit(1.0)))
    reach = (F.ceil(F.col("share") / F.when(F.col("full"), F.greatest(F.col("seats_in_all"), F.lit(1))).otherwise(F.col("open")) * (2 * F.col("n") + 2)) + 2).cast("long")
    s = s.withColumn("reach", reach)
    s = s.withColumn("low", F.least(F.col("most"), F.greatest(F.lit(0), F.floor("share") - F.col("reach"))).cast("long"))
    s = s.withColumn("high", F.least(F.col("most"), F.floor("share") + F.col("reach")).cast("long"))
    s = s.withColumn("to_rank", F.col("seats_in_all") - F.sum("low").over(every))
    ranked = s.where("high > low").select("shard", "ord", "to_rank", "target", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("seat"))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "ord", "seat")
    won = ranked.withColumn("place", F.row_number().over(best)).where("place <= to_rank").groupBy("shard", "ord").agg(F.count("*").alias("won"))
    s = s.join(won, ["shard", "ord"], "left").withColumn("seats", F.col("low") + F.coalesce("won", F.lit(0)))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("ord").orderBy("shard"))
    return s.select("source", "ord", "source_size", "target", "shard", "seats", (F.col("seats") - before).alias("quota"))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, cap: int = 3, seed: str = SEED, keep: tuple[str, ...] = (), keep_source: bool = False, n_shards: int = N_SHARDS) -> DataFrame:
    """docs and what the mix takes of each: doc_id, size, source_size, target, taken, shard, passes, part_from, part_to, part_wrap.

    A document is taken `passes` times in full and once more its words [part_from, part_to) and, where the run wraps
    around within it, [0, part_wrap). shard: of the mix, 1 to n_shards, in which its first word comes; null if none does. Null texts have no words; a null source is a source of its own, the last.
    Repeated rows are documents of their own. keep: further columns that the result carries along, keep_source: and source.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    d = docs.select(
        "doc_id", "source", key.alias("sk"), order.alias("h"), *keep,
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("th"),
    ).withColumn("bucket", F.substring("h", 1, 3))
    cells = d.groupBy("sk", "source", "bucket").agg(F.sum("size").alias("words"))
    sources = cells.groupBy("sk", "source").agg(F.sum("words").alias("source_size"))
    quotas = source_quotas(sources.select("source", "source_size"), n_shards, block_words, cap).withColumn("sk", key)
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"] * block_words)
    quotas = quotas.groupBy("sk").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), ends.alias("quotas"))
    due = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    quotas = quotas.select("sk", "source_size", "target", due.alias("due"), "quotas")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))
    first = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("sk")).cast("binary")), 1, 8), 16, 10).cast("long"), blocks)
    quotas = quotas.withColumn("run_from", first * block_words)
    line = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("words").over(line), F.lit(0))).join(quotas, "sk")
    cells = cells.select("sk", "bucket", "offset", "source_size", "target", "due", "run_from", "quotas")
    inner = Window.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inner)).join(cells, ["sk", "bucket"])
    d = d.withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).withColumn("end", F.col("offset") + F.col("upto"))
    some = F.col("source_size") > 0
    d = d.withColumn("passes", F.when(some, F.floor(F.col("due") / F.col("source_size"))).otherwise(0).cast("long"))
    d = d.withColumn("run_to", F.col("run_from") + F.col("due") - F.col("passes") * F.col("source_size"))
    inside = lambda x: F.least(F.greatest(x - F.col("start"), F.lit(0)), F.col("size"))
    d = d.withColumn("part_from", inside(F.col("run_from"))).withColumn("part_to", inside(F.col("run_to")))
    d = d.withColumn("part_wrap", F.when(some, inside(F.col("run_to") - F.col("source_size"))).otherwise(0).cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("part_to") - F.col("part_from") + F.col("part_wrap")
    # Where a document's first word comes in what is taken of its source, and so in which shard.
    first_word = F.when((F.col("start") < F.col("run_from")) & (F.col("run_from") < F.col("end")), 0).otherwise(F.pmod(F.col("start") - F.col("run_from"), F.greatest("source_size", F.lit(1))))
    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(1).alias("shard"))
    step = lambda acc, x: F.struct((acc["end"] + x).alias("end"), (acc["shard"] + (acc["end"] + x <= F.col("first_word")).cast("int")).alias("shard"))
    d = d.withColumn("taken", taken.cast("long")).withColumn("first_word", first_word)
    d = d.withColumn("shard", F.when(F.col("taken") > 0, F.aggregate("quotas", nothing, step, lambda acc: acc["shard"])))
    return d.select("doc_id", "size", "source_size", "target", "taken", "shard", "passes", "part_from", "part_to", "part_wrap", *keep, *(["source"] if keep_source else []))


def op7_mix_sainte_lague(spark, sf_dir: str) -> DataFrame:
    """All of `documents` mixed: weights 1, 2, 3 repeating over the sources, nothing beyond three times its size. Shard 0: not taken."""
    return mix_documents(table(spark, sf_dir, "documents", even=True)).select("doc_id", "size", "source_size", "target", "taken", F.coalesce("shard", F.lit(0)).alias("shard"))


#: The same by brute force: every quotient of every source is ranked.
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS sk,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT sk, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s0),
s2 AS (SELECT *, (ord - 1) % 3 + 1 AS weight FROM s1),
s3 AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_words, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
         CAST(coalesce(sum(cap) OVER r, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER r, 0) AS BIGINT) AS weight_before
  FROM s2 WINDOW r AS (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap * (all_weight - weight_before) <= weight * (all_words - cap_before) AS is_full FROM s3),
s5 AS (
  SELECT *, all_words - CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS BIGINT) AS left_words,
         all_weight - CAST(sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS BIGINT) AS left_weight
  FROM s4),
s6 AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * left_words AS DOUBLE) / CAST(left_weight AS DOUBLE) END AS target FROM s5),
seats AS (SELECT sk, ord, target, all_words, unnest(range(0, cap // {BLOCK_WORDS})) AS seat FROM s6),
placed AS (SELECT sk, all_words // {BLOCK_WORDS} AS blocks, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, ord, seat) AS place FROM seats),
by_shard AS (
  SELECT sk, CAST(ceil(CAST(place AS DECIMAL(38, 0)) * {N_SHARDS} / blocks) AS INTEGER) AS shard, count(*) AS quota
  FROM placed WHERE place <= blocks GROUP BY ALL),
won AS (SELECT sk, sum(quota) AS seats FROM by_shard GROUP BY sk),
ends AS (SELECT sk, shard, sum(quota) OVER (PARTITION BY sk ORDER BY shard) * {BLOCK_WORDS} AS ending FROM by_shard),
q AS (
  SELECT s6.sk, source_size, target, coalesce(seats, 0) * {BLOCK_WORDS} AS due,
         CAST('0x' || substr(md5('{SEED}|' || s6.sk), 1, 8) AS BIGINT) % greatest(1, (source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS}) * {BLOCK_WORDS} AS run_from
  FROM s6 LEFT JOIN won USING (sk)),
p AS (
  SELECT d.doc_id, d.sk, size, source_size, target, run_from,
         CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS passes,
         due - CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END * source_size AS rest,
         CAST(sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN q USING (sk)),
t AS (
  SELECT *, CAST(passes * size
         + greatest(0, least(upto, run_from + rest) - greatest(upto - size, run_from))
         + CASE WHEN source_size > 0 THEN greatest(0, least(upto, run_from + rest - source_size) - (upto - size)) ELSE 0 END AS BIGINT) AS taken,
         CASE WHEN upto - size < run_from AND run_from < upto THEN 0 ELSE (upto - size - run_from + source_size) % greatest(1, source_size) END AS first_word
  FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN (SELECT min(shard) FROM ends e WHERE e.sk = t.sk AND e.ending > first_word) ELSE 0 END AS shard
FROM t
"""
