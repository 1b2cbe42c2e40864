"""Operator 4: balanced label propagation over document shards (native).

Documents with equal texts are linked; what a group of them must agree on is a shard label. Every document starts with a
hashed label. Then, in rounds: blocks (groups, or quota-sized runs of a larger one) are joined with the labels of all
documents they are linked to, and move to the label that most of those hold among the shards with room for the whole
block; capacity quotas let in what fits, larger blocks first; a block that is let in carries its label into the next
round's votes, one that was refused looks for room elsewhere and then votes again. Rounds end when no block that is left
fits anywhere. Such blocks are laid out group after group over the room that is left, and documents without links fill the
shards to counts that differ by one at most (the law `rows`). `cut_links` says how many of a document's links lead into
other shards.

Scale: a row's group is only ever handled as (group, salt), so a group that holds a third of all rows is spread
over 64 pieces; votes are pre-aggregated before each shuffle. Only a group larger than a shard's quota is cut, into
blocks of a whole quota and a rest: runs of its documents in the order of (salt, doc_id). What reaches the driver is one
row for each shard and round.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SALTS = 64
CELLS = 256
BUCKETS = 1024
LARGE = 16  # blocks of more than a LARGEth of a quota are placed before all others


def _lookup(cumulative: list[int], value):
    """How many of the (few) ascending bounds are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cumulative]), lambda c: c <= value))


def _pick(values: list[int], index):
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), (index + 1).cast("int"))


def _settle(blocks: DataFrame, votes: DataFrame, load: list[int], quota: int, rounds: int, few: bool) -> DataFrame:
    """Rounds of voting and letting in, until all blocks are settled or fit nowhere whole; `load` is brought up to date.

    blocks: g, start, rows, parts; votes: g, label, v (documents of g that start with the label). Adds label and settled.
    few: blocks are that few that each has a place of its own in the order of letting in.
    """
    n_shards = len(load)
    blocks = blocks.select("g", "start", "rows", "parts", F.lit(-1).alias("label"), F.lit(False).alias("settled"), F.lit(0).alias("refused"))
    for r in range(rounds):
        free = [quota - x for x in load]
        # The votes: labels of linked documents, those of settled blocks as they are now, where the block has room.
        settled = blocks.where("settled and parts > 1").select("g", "label", F.col("rows").alias("v"))
        heard = blocks.where("not settled").select("g", "start", "rows").join(votes.unionByName(settled).groupBy("g", "label").agg(F.sum("v").alias("v")), "g")
        ballot = F.sort_array(F.collect_list(F.struct("v", F.xxhash64("g", "label").alias("h"), "label")), asc=False)
        heard = heard.where(_pick(free, F.col("label")) >= F.col("rows")).groupBy("g", "start").agg(ballot.alias("ballot"))
        turn = F.pmod((F.col("start") / F.greatest(F.col("rows"), F.lit(quota))).cast("int"), F.size("ballot"))  # blocks of one group ask for different shards
        wanted = F.get("ballot", turn)["label"]

        # Elsewhere: shards by free room, most first; those that can take the block whole are the first `fit` of them.
        order = sorted(range(n_shards), key=lambda s: (-free[s], s))
        bounds = list(accumulate(max(0, free[s]) for s in order))
        fit = F.size(F.filter(F.array(*[F.lit(free[s]).cast("long") for s in order]), lambda f: f >= F.col("rows")))
        total = F.greatest(_pick([0, *bounds], fit), F.lit(1))
        place = F.least(_lookup(bounds, F.pmod(F.xxhash64("g", "start", F.lit(r)), total)), F.lit(n_shards - 1))
        elsewhere = F.when(fit > 0, _pick(order, place))
        asked = F.when(F.col("settled"), F.col("label")).when(F.col("refused") % 2 == 1, elsewhere).otherwise(F.coalesce(wanted, elsewhere))
        if few:
            cell = F.row_number().over(Window.orderBy("settled", F.desc("rows"), F.xxhash64("g", "start", F.lit(r)), "g", "start"))
        else:
            cell = (252 - F.floor(4 * F.log2("rows"))) * CELLS + F.pmod(F.xxhash64("g", "start", F.lit(r)), F.lit(CELLS))
        blocks = cut(blocks.join(heard, ["g", "start"], "left").withColumn("asked", asked.cast("int")).withColumn("cell", cell.cast("int")).drop("ballot"))

        # Quotas: in each shard blocks are let in by cell, larger ones first, while the count stays within the quota.
        w = Window.partitionBy("asked").orderBy("cell")
        waiting = blocks.where("not settled and asked is not null").groupBy("asked", "cell").agg(F.sum("rows").alias("rows"))
        granted = (
            waiting.withColumn("sum", F.sum("rows").over(w))
            .where(F.col("sum") <= _pick(free, F.col("asked")))
            .groupBy("asked")
            .agg(F.max("cell").alias("cell"), F.max("sum").alias("rows"))
            .collect()  # one row for each shard at most
        )
        limit = [-1] * n_shards
        for row in granted:
            limit[row["asked"]] = row["cell"]
            load[row["asked"]] += row["rows"]
        entered = ~F.col("settled") & F.coalesce(F.col("cell") <= _pick(limit, F.col("asked")), F.lit(False))
        blocks = blocks.withColumn("entered", entered).select(
            "g", "start", "rows", "parts", F.when(F.col("entered"), F.col("asked")).otherwise(F.col("label")).alias("label"),
            (F.col("settled") | F.col("entered")).alias("settled"), (F.col("refused") + (~F.col("entered")).cast("int")).alias("refused"),
        )
        if blocks.where((~F.col("settled")) & (F.col("rows") <= quota - min(load))).isEmpty():
            break
    return blocks


def shard_documents(docs: DataFrame, n_shards: int = 24, rounds: int = 60, seed: int = 7) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows, cut_links.

    Null texts count as empty ones and are linked with them. Rows that repeat a doc_id are rows of their own.
    Empty input gives an empty result; columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select("doc_id", text.alias("t")).select(
            "doc_id",
            (F.octet_length("t") + 8).cast("long").alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2("t", 256)).alias("g"),
            F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)).cast("int").alias("salt"),
            F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(n_shards)).cast("int").alias("start"),
        )
    )
    n_rows = base.count()
    quota, extra = divmod(n_rows, n_shards)
    block_rows = max(1, quota)

    # Documents of a group by salt: at most SALTS rows a group.
    of_group = Window.partitionBy("g")
    before_salt = of_group.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = base.groupBy("g", "salt").agg(F.count("*").alias("c")).select(
        "g", "salt", F.sum("c").over(of_group).alias("n"), F.coalesce(F.sum("c").over(before_salt), F.lit(0)).alias("offset")
    )

    votes = cut(base.groupBy("g", F.col("start").alias("label")).agg(F.count("*").alias("v")))
    groups = votes.groupBy("g").agg(F.sum("v").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    blocks = groups.select("g", "n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    begin = F.col("j").cast("long") * block_rows
    blocks = cut(blocks.select("g", "parts", begin.alias("start"), F.least(F.lit(block_rows).cast("long"), F.col("n") - begin).alias("rows")))
    votes = votes.join(groups.select("g"), "g", "left_semi")
    load = [0] * n_shards
    large = F.col("rows") * LARGE > quota  # fewer than LARGE * (n_shards + 1)
    blocks = _settle(blocks.where(large), votes, load, quota, rounds, True).unionByName(_settle(blocks.where(~large), votes, load, quota, rounds, False))

    # What is not settled lies in the order of groups before the documents without links, in two levels as the ranks below.
    rest_of = Window.partitionBy("b").orderBy("g", "start").rowsBetween(Window.unboundedPreceding, -1)
    left = cut(blocks.where("not settled").withColumn("b", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")))
    n_left = left.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    starts = left.groupBy("b").agg(F.sum("rows").alias("c")).select(
        "b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o")
    )  # at most BUCKETS rows
    left = left.withColumn("fill", F.coalesce(F.sum("rows").over(rest_of), F.lit(0))).join(F.broadcast(starts), "b").select(
        "g", "start", "rows", F.lit(n_shards + 1).alias("label"), (F.col("fill") + F.col("o")).alias("fill")
    )
    spans = blocks.where("settled").select("g", "start", "rows", "label", F.lit(0).cast("long").alias("fill")).unionByName(left)
    spans = spans.groupBy("g").agg(F.collect_list(F.struct("start", "rows", "label", "fill")).alias("spans"))

    labels = pieces.where("n > 1").join(spans, "g")
    at = F.col("offset") + F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id")) - 1
    placed = base.join(labels, ["g", "salt"], "left").withColumn("at", at)
    placed = placed.withColumn("span", F.filter("spans", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["start"] + x["rows"])))
    placed = placed.withColumn("span", F.get("span", F.lit(0)))
    whole = (F.size("spans") == 1) & (F.get("spans", F.lit(0))["label"] < n_shards)
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.coalesce("n", F.lit(1)).alias("group_rows"),
        F.when(~whole, F.col("spans")).alias("spans"),
        F.coalesce("span.label", F.lit(n_shards)).alias("part"),
        (F.col("span.fill") + F.col("at") - F.col("span.start")).alias("fill"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    placed = cut(placed)

    # Ranks within a shard in two levels: offsets of buckets (at most BUCKETS rows for each part), then rows in a bucket.
    before = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part", "bucket")
        .agg(F.count("*").alias("c"))
        .select("part", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    )
    inner = Window.partitionBy("part", "bucket").orderBy("doc_id", "text_crc32", "size")
    rest = [quota + (s < extra) - load[s] for s in range(n_shards)]
    order = sorted(range(n_shards), key=lambda s: (-rest[s], s))
    bounds = list(accumulate(rest[s] for s in order))
    ranked = placed.withColumn("r", F.row_number().over(inner)).join(
        F.broadcast(offsets), ["part", "bucket"]  # at most (n_shards + 2) * BUCKETS rows
    )
    ranked = ranked.withColumn("r", F.col("r") - 1 + F.col("offset"))
    ranked = ranked.withColumn(
        "r", F.when(F.col("part") == n_shards, F.col("r") + n_left).when(F.col("part") > n_shards, F.col("fill")).otherwise(F.col("r"))
    )
    loose = F.col("part") >= n_shards
    into = _pick(order, _lookup(bounds, F.col("r")))
    slot_base = F.array(*[F.lit(load[s] - (bounds[order.index(s)] - rest[s])).cast("long") for s in range(n_shards)])
    out = ranked.withColumn("shard", F.when(loose, into).otherwise(F.col("part")).cast("int"))
    # Of its group in the same shard: settled blocks with that label, and what of the others lies within the shard's loose room.
    upto = _pick([bounds[order.index(s)] for s in range(n_shards)], F.col("shard"))
    since = upto - _pick(rest, F.col("shard"))
    overlap = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["fill"] + x["rows"], upto) - F.greatest(x["fill"], since))
    held = lambda x: F.when(x["label"] == F.col("shard"), x["rows"]).when(x["label"] > n_shards, overlap(x)).otherwise(F.lit(0).cast("long"))
    together = F.when(F.col("spans").isNotNull(), F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + held(x))).otherwise(F.col("group_rows"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.when(loose, F.col("r") + F.element_at(slot_base, F.col("shard") + 1)).otherwise(F.col("r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_rows",
        (F.col("group_rows") - together).alias("cut_links"),
    )


def op4_shard_label_propagation(spark, sf_dir: str) -> DataFrame:
    """All of `documents` into shards 0 to 23, counts at most one apart, copies kept together."""
    return shard_documents(table(spark, sf_dir, "documents"))
