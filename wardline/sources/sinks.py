"""Sinks: rewritten messages, alerts and actions, from batches or streams. Commands are written, never run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewritten(redacted: DataFrame, key: str = "msg_id", text: str = "text") -> DataFrame:
    """Only messages that change: key, old and new text."""
    return redacted.where(F.col("filtered") != F.col(text)).select(key, F.col(text).alias("old_text"), F.col("filtered").alias("new_text"))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def start(stream: DataFrame, path: str, checkpoint: str, each_batch=None, output_mode: str = "append", trigger: dict | None = None):
    """Starts a streaming write of files, or of what each_batch(batch, id) does with every micro-batch."""
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return w.foreachBatch(each_batch).start() if each_batch else w.format("parquet").start(path)


def refilter(stored: DataFrame, redact) -> DataFrame:
    """A deferred second pass over stored documents: redaction is idempotent once stable, so it may run at any time."""
    return redact(stored).where("changed")
