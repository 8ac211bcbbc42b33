"""Minute boards as a stream: upsert, five-minute samples, bars, completeness."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidemark.functions.grid import CLOSE, MINUTES, POINTS, on_five_minute_grid, on_minute_grid
from tidemark.functions.scalars import clock_minute
from tidemark.session import held
from tidemark.sources.folders import Folder
from tidemark.sources.minutes import append_minute_board
from tidemark.sources.tables import read_table, replace_partitions

LATENESS = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def batch_name(checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch: streams with checkpoints of their own never share one."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id:012d}"


def upsert_minute_boards(boards: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends each micro-batch to the minute log, read by ``read_minute_board``.

    A batch costs its own rows, and replaying it replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_minute_board(batch, path, batch_name(checkpoint, batch_id))

    return boards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def five_minute_samples(boards: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "snapshot_at",
                        lateness: str = LATENESS) -> DataFrame:
    """Last cumulative value of every five-minute bucket (bucket ends on the grid point).

    Works on a stream (append mode) or a batch alike; state is one row per key
    and open bucket.
    """
    timed = boards.withWatermark(at, lateness) if boards.isStreaming else boards
    bucket = F.window(at, "5 minutes", "5 minutes", "1 minute")
    return (timed.groupBy(*keys, bucket)
            .agg(*[F.max_by(v, at).alias(v) for v in values], F.max(at).alias("sampled_at"))
            .select(*keys, F.col("window.start").alias("bucket_start"), F.col("window.end").alias("bucket_end"),
                    "sampled_at", *values))


def on_grid_samples(boards: DataFrame, at: str = "snapshot_at") -> DataFrame:
    """Rows standing exactly on five-minute grid points (the archive's sampling rule)."""
    return boards.filter(on_five_minute_grid(clock_minute(F.col(at))))


def stream_bars(ticks: DataFrame, keys: Sequence[str], price: str, volume: str, order: Sequence[str],
                at: str = "ts", width: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """OHLCV bars in tumbling windows, for streams and batches."""
    timed = ticks.withWatermark(at, lateness) if ticks.isStreaming else ticks
    stamp = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return (timed.groupBy(*keys, F.window(at, width))
            .agg(F.min_by(price, stamp).alias("open_price"), F.max(price).alias("high_price"),
                 F.min(price).alias("low_price"), F.max_by(price, stamp).alias("close_price"),
                 F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("tick_count"))
            .select(*keys, F.col("window.start").alias("bucket_start"), "open_price", "high_price", "low_price",
                    "close_price", "volume", "tick_count"))


def latest_board(boards: DataFrame, keys: Sequence[str] = ("rank_type", "code"), at: str = "snapshot_at") -> DataFrame:
    """Latest row per key; as a stream an update-mode aggregate with one row of state per key.

    The columns share one order, so all come from the same row; numbers are hashed, not sorted, and
    columns that nobody asks for are not read.
    """
    rest = [c for c in boards.columns if c not in keys]
    return boards.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in rest])


def session_counts(boards: DataFrame, keys: Sequence[str] = ("trade_date", "rank_type"),
                   at: str = "snapshot_at") -> DataFrame:
    """Minutes, five-minute points and close seen so far per key, against 240 / 48 / 1.

    Distinct minutes are kept as a set of at most 1440 numbers per key, which
    streams in update or complete mode.
    """
    minute = clock_minute(F.col(at))
    seen = boards.groupBy(*keys).agg(F.collect_set(minute).alias("_m"))
    return seen.select(
        *keys, F.size(F.filter("_m", on_minute_grid)).alias("minutes_seen"), F.lit(MINUTES).alias("minutes_expected"),
        F.size(F.filter("_m", on_five_minute_grid)).alias("points_seen"), F.lit(POINTS).alias("points_expected"),
        F.array_contains("_m", CLOSE).cast("int").alias("close_seen"))


def split_late(batch: DataFrame, sealed: DataFrame, date: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """Rows still open, and rows of dates whose post-close archive already replaced the day.

    Sealed dates are one row each, hence the broadcasts.
    """
    dates = F.broadcast(sealed.select(date).distinct())
    return batch.join(dates, date, "left_anti"), batch.join(dates, date, "left_semi")


def upsert_with_late_table(boards: DataFrame, path: str, late_path: str, sealed_path: str,
                           checkpoint: str) -> DataStreamWriter:
    """Like ``upsert_minute_boards``; rows of sealed dates go to a side table for the nightly overwrite.

    Both sinks are keyed by the batch, so a batch that died between them is
    replayed into the same folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(checkpoint, batch_id)
        sealed = read_table(spark, sealed_path)
        with held(batch):
            fresh, late = (batch, batch.limit(0)) if sealed is None else split_late(batch, sealed)
            append_minute_board(fresh, path, name)
            replace_partitions(late.withColumn("batch", F.lit(name)), late_path, ["trade_date", "batch"])

    return boards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def fold_late_rows(spark: SparkSession, late_path: str, path: str) -> list[str]:
    """The nightly overwrite: late rows join the minute log under their own batches and leave the side table (eager).

    Returns the dates concerned, which are to be archived and sealed again.
    Rows are appended before they are removed, and appending them again changes
    nothing, so a night that died is simply run again.
    """
    late = read_table(spark, late_path)
    if late is None:
        return []
    folder = Folder(spark, late_path)
    batches = [(d, b) for d in folder.names() if d.startswith("trade_date=") for b in folder.names(d) if b.startswith("batch=")]
    for name in sorted({b for _, b in batches}):
        rows = late.filter(F.col("batch") == name.split("=", 1)[1]).drop("batch")
        append_minute_board(rows, path, f"late-{name.split('=', 1)[1]}")
    for date, name in batches:
        folder.remove(f"{date}/{name}")
    return sorted({d.split("=", 1)[1] for d, _ in batches})


def recompute_scope(index: DataFrame, changed: str, back: int, ahead: int) -> DataFrame:
    """Sealed dates a resealed date can influence: ``back`` before to ``ahead`` after it."""
    at = index.filter(F.col("trade_date") == F.lit(changed).cast("date")).agg(F.max("date_idx")).scalar()
    return index.filter(F.col("date_idx").between(at - back, at + ahead))
