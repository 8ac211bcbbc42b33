"""Archive tables on shared storage: Parquet partitioned by date, replaced by partition.

Writers use dynamic partition overwrite, so rerunning a date replaces exactly
that date's files and a failed job leaves the old ones.  Data goes first, the
manifest last; what several tables say of a date together is published by a
seal (``sources.seals``), and minute boards are a log (``sources.minutes``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tidemark.functions.grid import CLOSE, POINTS, on_five_minute_grid, point_index
from tidemark.functions.scalars import clock_minute
from tidemark.operators.archive import ArchiveDay
from tidemark.operators.calendar import date_completeness
from tidemark.operators.enrich import POINT_KEY, eligible_only, merge_money_and_bars, only_quoted
from tidemark.operators.quality import archive_coverage, archive_manifest, stock_quality
from tidemark.session import held
from tidemark.sources.folders import Folder

CLOSE_PARTS = ("trade_date", "rank_type")
SECURITY_DAY = ["trade_date", "market", "code"]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Overwrite the partitions present in ``df`` (eager write).

    The rebalance hint lets Spark gather small partitions and split a hot one
    into files of its advisory size; sorting inside files gives useful min/max
    statistics.
    """
    shaped = df.hint("rebalance", *[F.col(c) for c in partitions]).sortWithinPartitions(*partitions, *sort)
    (shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def clear_partitions(spark: SparkSession, path: str, partitions: Sequence[str], due: DataFrame, kept: DataFrame) -> None:
    """Remove the partitions of ``due`` that ``kept`` has no rows for: by name, their rows are not read.

    Both sides are reduced to one row a partition before they come to the driver.
    """
    def named(rows: DataFrame) -> set[tuple[str, ...]]:
        return {tuple(r) for r in rows.select(*[F.col(c).cast("string") for c in partitions]).distinct().collect()}

    folder = Folder(spark, path)
    for values in named(due) - named(kept):
        folder.remove("/".join(f"{name}={value}" for name, value in zip(partitions, values)))


def require_none(bad: DataFrame, message: str) -> None:
    """Raise if a check found anything (reads at most one row)."""
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


# -- closes and curves -------------------------------------------------------

def save_daily_close(rows: DataFrame, path: str) -> None:
    """Replace the closes of the (date, type) pairs in ``rows``; unquoted stocks are not stored."""
    with held(rows):
        require_none(rows.filter(clock_minute(F.col("snapshot_at")) != CLOSE), "a daily close is a 15:00 snapshot")
        kept = rows.filter((F.col("rank_type") != "stock") | F.col("quote_available"))
        pairs = rows.select(*CLOSE_PARTS).distinct()
        require_none(pairs.join(kept.select(*CLOSE_PARTS).distinct(), list(CLOSE_PARTS), "left_anti"),
                      "no eligible records")
        replace_partitions(kept, path, CLOSE_PARTS, ["code"])


def off_grid_points(points: DataFrame, closes: DataFrame) -> DataFrame:
    """Points off the five-minute grid or of a (date, type) that is not being saved."""
    pairs = closes.select(*CLOSE_PARTS).distinct()
    misplaced = points.filter(~on_five_minute_grid(clock_minute(F.col("snapshot_at"))))
    return misplaced.unionByName(points.join(F.broadcast(pairs), list(CLOSE_PARTS), "left_anti"))  # a row a date and type


def save_board_archive(day: ArchiveDay, root: str) -> None:
    """Replace closes and curves of the day's board types, then their coverage and the manifest.

    Each (date, type) of the closes is replaced as a whole: one that has no
    points any more loses its curves, and its coverage says so.
    """
    with held(day.closes, day.points):
        require_none(day.errors, "board quotes void the day")
        require_none(off_grid_points(day.points, day.closes), "money point does not belong")
        spark = day.closes.sparkSession
        save_daily_close(day.closes, f"{root}/daily_close")
        replace_partitions(day.points.withColumn("money_available", F.lit(True)), f"{root}/board_money_5m", CLOSE_PARTS,
                           ["code", "snapshot_at"])
        clear_partitions(spark, f"{root}/board_money_5m", CLOSE_PARTS, day.closes, day.points)
        dates = day.closes.select("trade_date").distinct()
        minutes = read_table(spark, f"{root}/minute_board")
        if minutes is not None:
            minutes = _of_dates(minutes, dates)
        replace_partitions(archive_coverage(day.closes, day.points, minutes), f"{root}/coverage", CLOSE_PARTS)
        refresh_manifest(spark, root, dates)


def save_stock_archive(day: ArchiveDay, root: str) -> None:
    """Replace closes and research rows of the day's stocks; bars and provenance of the date are dropped.

    A date without eligible points is left without research rows.
    """
    with held(day.closes, day.points):
        require_none(day.errors, "stock quotes void the day")
        require_none(off_grid_points(day.points, day.closes), "money point does not belong")
        spark = day.closes.sparkSession
        save_daily_close(day.closes, f"{root}/daily_close")
        good, _ = eligible_only(day.points, only_quoted(day.closes))
        indexed = good.withColumn("minute_index", point_index(clock_minute(F.col("snapshot_at"))))
        empty = "trade_date date, minute_index int, market bigint, code string, source string, open_price double, " \
                "high_price double, low_price double, close_price double, change_value double, amplitude double, " \
                "change_pct double, turnover_rate double, volume bigint, turnover bigint"
        research = merge_money_and_bars(indexed, spark.createDataFrame([], empty))
        replace_partitions(research, f"{root}/stock_research_5m", ["trade_date"], ["code", "minute_index"])
        clear_partitions(spark, f"{root}/stock_research_5m", ["trade_date"], day.closes, research)
        dates = day.closes.select("trade_date").distinct()
        old = read_table(spark, f"{root}/bar_sources")
        if old is not None:
            # Provenance of the date counts for nothing any more.
            voided = _of_dates(old, dates).withColumn("point_count", F.lit(0).cast("bigint")).select(*old.columns)
            replace_partitions(voided, f"{root}/bar_sources", ["trade_date"])
        replace_partitions(stock_quality(only_quoted(day.closes), research), f"{root}/stock_quality", ["trade_date"])
        refresh_manifest(spark, root, dates)


def _of_dates(table: DataFrame, dates: DataFrame) -> DataFrame:
    return table.join(F.broadcast(dates), "trade_date", "left_semi")


def stored_curves(spark: SparkSession, root: str) -> DataFrame:
    """Dark money of every archived curve by position, boards and stocks alike."""
    fields = ["trade_date", "rank_type", "market", "code", "minute_index", "dark_money"]
    at = point_index(clock_minute(F.col("snapshot_at")))
    boards = spark.read.parquet(f"{root}/board_money_5m").withColumn("minute_index", at)
    stocks = spark.read.parquet(f"{root}/stock_research_5m").filter("money_available").withColumn("rank_type", F.lit("stock"))
    return boards.select(fields).unionByName(stocks.select(fields))


# -- bars --------------------------------------------------------------------

def check_stock_bars(bars: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of securities whose day is whole, and the rejected security-days.

    All or nothing per security: 48 distinct points, one source, and a quoted
    stock of that date.
    """
    on = F.coalesce(F.col("minute_index").between(0, POINTS - 1), F.lit(False))
    points = F.bit_count(F.bit_or(F.when(on, F.expr("shiftleft(1L, minute_index)"))))  # a bit a point: one aggregate does
    per_day = bars.groupBy(*SECURITY_DAY).agg(
        F.count(F.lit(1)).alias("_rows"), points.alias("_points"), F.min("source").alias("_low"), F.max("source").alias("_high"),
        F.max(~on).alias("_off"))
    quoted = (daily.filter((F.col("rank_type") == "stock") & F.col("quote_available"))
              .select(*SECURITY_DAY, F.lit(True).alias("_quoted")))
    reason = (F.when(F.col("_off"), "off_grid").when(F.col("_rows") > F.col("_points"), "duplicate_point")
              .when(F.col("_low") != F.col("_high"), "mixed_sources").when(F.col("_points") != POINTS, "incomplete")
              .when(F.col("_quoted").isNull(), "not_eligible"))
    verdict = per_day.join(quoted, SECURITY_DAY, "left").select(*SECURITY_DAY, reason.alias("reason"))
    good = bars.join(verdict.filter(F.col("reason").isNull()).select(*SECURITY_DAY), SECURITY_DAY, "left_semi")
    return good, verdict.filter(F.col("reason").isNotNull())


def with_bars(research: DataFrame, bars: DataFrame) -> DataFrame:
    """Research rows after storing bars: money columns stay, bar columns of the given points are replaced.

    A row a point is joined by merging, never broadcast: its small files say little of what it takes in memory.
    """
    given = merge_money_and_bars(research.limit(0).withColumnRenamed("money_rank", "rank"), bars)
    names = [c for c in given.columns if c not in POINT_KEY]
    money = ["money_rank", "dark_money", "regular_money", "main_money_inflow", "money_available"]
    fresh, old = F.col("_b").isNotNull(), F.col("_r")
    joined = research.select(*POINT_KEY, F.struct(*names).alias("_r")).join(
        given.select(*POINT_KEY, F.struct(*names).alias("_b")).hint("merge"), POINT_KEY, "full_outer")
    return joined.filter(fresh | old["money_available"] | old["kline_available"]).select(*POINT_KEY, *[
        (F.when(old["money_available"] | ~fresh, old[c]).otherwise(F.col("_b")[c]) if c in money
         else F.when(fresh, F.col("_b")[c]).otherwise(old[c])).alias(c) for c in names])


def bar_provenance(bars: DataFrame, parser_version: str, run_id: str) -> DataFrame:
    return bars.groupBy(*SECURITY_DAY).agg(
        F.min("source").alias("source"), F.count(F.lit(1)).alias("point_count"),
        F.lit(parser_version).alias("parser_version"), F.max("fetched_at").alias("fetched_at"),
        F.lit(run_id).alias("run_id"))


def save_stock_bars(bars: DataFrame, root: str, parser_version: str, run_id: str) -> DataFrame:
    """Store the sound bars of their dates with provenance, then quality and manifest; returns the rejects."""
    with held(bars):
        spark = bars.sparkSession
        dates = bars.select("trade_date").distinct()
        daily = _of_dates(spark.read.parquet(f"{root}/daily_close"), dates)
        research = _of_dates(spark.read.parquet(f"{root}/stock_research_5m"), dates)
        good, rejected = check_stock_bars(bars, daily)
        replace_partitions(with_bars(research, good), f"{root}/stock_research_5m", ["trade_date"], ["code", "minute_index"])
        fresh = bar_provenance(good, parser_version, run_id)
        old = read_table(spark, f"{root}/bar_sources")
        if old is not None:
            kept = _of_dates(old, dates).join(fresh.select(*SECURITY_DAY), SECURITY_DAY, "left_anti")
            fresh = fresh.unionByName(kept.select(*fresh.columns))
        replace_partitions(fresh, f"{root}/bar_sources", ["trade_date"])
        renewed = _of_dates(spark.read.parquet(f"{root}/stock_research_5m"), dates)
        replace_partitions(stock_quality(daily, renewed), f"{root}/stock_quality", ["trade_date"])
        refresh_manifest(spark, root, dates)
        return rejected


def refresh_manifest(spark: SparkSession, root: str, dates: DataFrame) -> None:
    """Recompute and store the completeness and manifest rows of some dates; always the last write."""
    def table(name: str, ddl: str) -> DataFrame:
        found = read_table(spark, f"{root}/{name}")
        return _of_dates(found if found is not None else spark.createDataFrame([], ddl), dates)

    daily = table("daily_close", "trade_date date, rank_type string, market bigint, code string, quote_available boolean")
    money = table("board_money_5m", "trade_date date, rank_type string")
    research = table("stock_research_5m", "trade_date date, money_available boolean, kline_available boolean")
    sources = table("bar_sources", "trade_date date, source string, point_count bigint")
    quality = table("stock_quality", "trade_date date, expected_stocks bigint, expected_points int, "
                                     "expected_kline_stocks bigint")
    replace_partitions(date_completeness(daily), f"{root}/completeness", ["trade_date"])
    replace_partitions(archive_manifest(daily, money, research, sources.filter(F.col("point_count") > 0), quality),
                       f"{root}/manifest", ["trade_date"])
