"""Usage records as a stream: idempotent ingest, windowed totals, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str = "dedupe_key", at: str = "recorded_at", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_totals(stream: DataFrame, by: list[str], at: str, value: str, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Calls and null-aware sums per time window; late rows within ``delay`` still count."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = stream.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "calls", "total")


def sessions(rows: DataFrame, by: list[str], at: str, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Sessions of rows less than ``gap`` apart; for streams give ``delay``."""
    source = rows.withWatermark(at, delay) if delay else rows
    out = source.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def ingest(stream: DataFrame, ledger_path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], key: str = "dedupe_key") -> StreamingQuery:
    """Append each micro-batch's new keys to a Parquet ledger, one batch after the other.

    A batch that runs again after a failure finds its keys there and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        from quern.operators.usage import insert_new

        spark = batch.sparkSession
        fresh = prepare(batch)
        # The first batch finds no ledger yet.
        fresh.limit(0).write.mode("append").parquet(ledger_path)
        known = spark.read.schema(fresh.schema).parquet(ledger_path)
        insert_new(known, fresh.withColumn("ordinal", F.monotonically_increasing_id()), key).drop("ordinal").write.mode("append").parquet(ledger_path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
