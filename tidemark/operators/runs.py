"""Collection-run log: metrics, retention rollup, recent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_LIVED, LONG_LIVED = ("success", "skipped"), ("failed", "partial")


def run_counts(runs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Runs by type and status over the live log and the rollup."""
    live = runs.groupBy("rank_type", "status").agg(F.count(F.lit(1)).alias("run_count"))
    return (live.unionByName(rollup.select("rank_type", "status", "run_count"))
            .groupBy("rank_type", "status").agg(F.sum("run_count").alias("run_count")))


def success_totals(runs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Records, seconds, count and last success of successful runs by type."""
    live = runs.filter(F.col("status") == "success").groupBy("rank_type").agg(
        F.sum("fetched_total").alias("record_count"), F.sum("duration_ms").alias("duration_ms"),
        F.count(F.lit(1)).alias("run_count"), F.max("finished_at").alias("latest_success_at"))
    old = rollup.filter(F.col("status") == "success").select(
        "rank_type", "record_count", "duration_ms", "run_count", "latest_success_at")
    return live.unionByName(old).groupBy("rank_type").agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        (F.coalesce(F.sum("duration_ms"), F.lit(0)) / 1000.0).alias("duration_seconds"),
        F.coalesce(F.sum("run_count"), F.lit(0)).alias("run_count"),
        F.max("latest_success_at").alias("last_success"))


def latest_snapshots(minute_board: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Most recent board snapshot by type over the working set and the archive."""
    both = minute_board.select("rank_type", "snapshot_at").unionByName(snapshots.select("rank_type", "snapshot_at"))
    return (both.filter(F.col("rank_type").isin("industry", "concept"))
            .groupBy("rank_type").agg(F.max("snapshot_at").alias("latest_snapshot")))


def missing_points(board_coverage: DataFrame) -> DataFrame:
    """Compacted days and missing five-minute points by type."""
    return board_coverage.groupBy("rank_type").agg(
        F.count_distinct("trade_date").alias("compacted_days"),
        F.coalesce(F.sum(F.col("expected_research") - F.col("collected_research")), F.lit(0)).alias("missing_points"))


def expired(at: Column, success_days: int = 30, failure_days: int = 180) -> Column:
    """Run rows past their retention at instant ``at``."""
    if success_days < 1 or failure_days < success_days:
        raise ValueError("retention must be at least a day, and failures kept as long as successes")
    ended = F.coalesce("finished_at", "started_at")
    return ((F.col("status").isin(*SHORT_LIVED) & (ended < at - F.make_dt_interval(F.lit(success_days))))
            | (F.col("status").isin(*LONG_LIVED) & (ended < at - F.make_dt_interval(F.lit(failure_days)))))


def roll_up_runs(runs: DataFrame, rollup: DataFrame, at: Column, success_days: int = 30,
                 failure_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """Fold expired runs into the rollup; returns (new rollup, remaining runs)."""
    old = F.coalesce(expired(at, success_days, failure_days), F.lit(False))
    folded = runs.filter(old).groupBy("rank_type", "status").agg(
        F.count(F.lit(1)).alias("run_count"), F.coalesce(F.sum("fetched_total"), F.lit(0)).alias("record_count"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("latest_success_at"))
    merged = (rollup.select(*folded.columns).unionByName(folded).groupBy("rank_type", "status")
              .agg(F.sum("run_count").alias("run_count"), F.sum("record_count").alias("record_count"),
                   F.sum("duration_ms").alias("duration_ms"), F.max("latest_success_at").alias("latest_success_at")))
    return merged, runs.filter(~old)


def recent_runs(runs: DataFrame, requested_date: str | None = None, limit: int = 100) -> DataFrame:
    """Latest runs of a date, as many as asked for."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = runs if requested_date is None else runs.filter(
        F.col("requested_date") == F.lit(requested_date).cast("date"))
    return rows.orderBy(F.desc("snapshot_at"), "run_id").limit(limit)
