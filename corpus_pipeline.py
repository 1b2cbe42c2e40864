"""Corpus pipeline over `documents`: each stage is one operator of wardline.llm, and its decisions take effect.

Rejected documents go (quality), one document of each group of near copies stays, personal data is replaced, sources are
mixed to their target weights, and what is left is encoded to pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, jaccard, mixing, pieces, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # learned models and piece ids are beyond SQL; tests hold the stages against brute force


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5, by a model fitted on the labels. Without labels of both kinds all stay.

    Null and empty texts have the score of the model's prior; rows that repeat another share its fate.
    """
    model = quality.train_model(docs, common.table(spark, sf_dir, "labels"))
    if not model.both:
        return docs.select(*COLUMNS)
    return quality.score_documents(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id (null only if none has one).

    Of several rows of a group with that id one text stays, and one of the rows that repeat it. Texts without words (null,
    empty, blank) are groups of their own; rows that repeat such a one are one row afterwards.
    """
    kept = jaccard.near_duplicates(docs).where("kept").groupBy("group", "doc_id").agg(F.min("th").alias("th"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    own = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    named = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left_semi")
    return named.dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)


def mask_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets; n_chars follows. Null texts, and their n_chars,
    stay as they are; repeated rows are rows of their own."""
    masked = pii.mask_documents(docs.select(*COLUMNS), pii.train_model(docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it in full, and once more the words it takes in part.

    Documents of which the mix takes nothing, those without words among them, go.
    """
    mixed = mixing.mix_documents(docs, keep=("text", "lang", "n_chars"), keep_source=True)
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    some = lambda a, b: F.when(b > a, F.array(F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    again = F.when(F.col("size") > 0, F.array_repeat("text", F.col("passes").cast("int"))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(again, some(F.col("part_from"), F.col("part_to")), some(F.lit(0), F.col("part_wrap")))
    out = mixed.where("taken > 0").select("doc_id", F.explode(parts).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def encode_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip of each row of the mix, repeated ones too; null and empty texts
    have no ids."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is cut off before the next one works on it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
