"""Trading calendar, sealed-date index and session timelines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE, MORNING_END, NOON_START, OPENING, grid_array
from tidemark.functions.scalars import clock_text


def date_dimension(spark: SparkSession, first: dt.date, last: dt.date, exceptions: DataFrame | None = None) -> DataFrame:
    """(date, is_trading) for every calendar day of a range.

    ``exceptions`` holds (date, kind) with kind ``holiday`` or ``workday``; a
    workday entry wins over a holiday entry, and both win over the weekday rule.
    The range is a handful of years, so the result is a small dimension.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    weekday = F.weekday("date") < 5
    if exceptions is None:
        return days.select("date", weekday.alias("is_trading"))
    rules = exceptions.groupBy("date").agg(
        F.max(F.col("kind") == "workday").alias("workday"), F.max(F.col("kind") == "holiday").alias("holiday"))
    return (days.join(rules, "date", "left")
            .select("date", F.when(F.col("workday"), True).when(F.col("holiday"), False)
                    .otherwise(weekday).alias("is_trading")))


def mark_trading(df: DataFrame, date: str, exceptions: DataFrame | None = None, out: str = "is_trading") -> DataFrame:
    """Add the trading-day flag to any table with a date column."""
    weekday = F.weekday(date) < 5
    if exceptions is None:
        return df.withColumn(out, weekday)
    rules = exceptions.groupBy(F.col("date").alias(date)).agg(
        F.max(F.col("kind") == "workday").alias("_work"), F.max(F.col("kind") == "holiday").alias("_off"))
    return (df.join(rules, date, "left")
            .withColumn(out, F.when(F.col("_work"), True).when(F.col("_off"), False).otherwise(weekday))
            .drop("_work", "_off"))


def neighbour_trading_days(dimension: DataFrame) -> DataFrame:
    """Add ``latest`` (last trading day up to the date) and ``previous`` (strictly before).

    The window runs over the date dimension, i.e. one row per calendar day.
    """
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    trading = F.when(F.col("is_trading"), F.col("date"))
    return (dimension.withColumn("latest", F.max(trading).over(upto))
            .withColumn("previous", F.max(trading).over(before)))


def calendar_coverage(valid_through: Column, today: Column) -> Column:
    """Struct (days_remaining, expired) of a calendar file; no end date counts as expired."""
    end = valid_through.try_cast("date")
    days = F.datediff(end, today)
    return F.struct(F.coalesce(days, F.lit(0)).alias("days_remaining"),
                    F.coalesce(days < 0, F.lit(True)).alias("expired"))


def market_phase(minute: Column, is_trading: Column) -> Column:
    """``closed``, ``pre_open``, ``open`` or ``lunch_break`` at a minute of day."""
    return (F.when(~is_trading, "closed").when(minute < OPENING, "pre_open")
            .when((minute <= MORNING_END) | minute.between(NOON_START, CLOSE), "open")
            .when(minute < NOON_START, "lunch_break").otherwise("closed"))


def date_index(dates: DataFrame, date: str = "trade_date", out: str = "date_idx") -> DataFrame:
    """Dense 0-based index over distinct dates.

    The distinct dates are one row per sealed day (a century has some 25,000),
    which is what makes the unpartitioned window and later broadcasts safe.
    """
    return (dates.select(date).filter(F.col(date).isNotNull()).distinct()
            .withColumn(out, (F.row_number().over(Window.orderBy(date)) - 1).cast("int")))


def with_date_index(df: DataFrame, index: DataFrame, date: str = "trade_date") -> DataFrame:
    """Keep rows of indexed dates and add the index (broadcast date dimension)."""
    return df.join(F.broadcast(index), date)


def date_completeness(daily: DataFrame) -> DataFrame:
    """Concepts, quoted concepts and stocks of each date: what writers store per date so that scans need no history."""
    concept = F.col("rank_type") == "concept"
    return daily.filter(F.col("rank_type").isin("concept", "stock")).groupBy("trade_date").agg(
        F.count_if(concept).alias("concepts"), F.count_if(concept & F.col("quote_available")).alias("quoted_concepts"),
        F.count_if(F.col("rank_type") == "stock").alias("stocks"))


def complete_dates(daily: DataFrame | None, as_of: str | None = None, last: int | None = None,
                   first: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Dates on which every concept is quoted and at least one stock is present.

    ``counts`` is ``date_completeness`` as the writers keep it, one row a date;
    with it the closes are not read.  ``last`` keeps the most recent N; the
    result is ascending either way.
    """
    rows = daily if counts is None else counts
    if as_of is not None:
        rows = rows.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    if first is not None:
        rows = rows.filter(F.col("trade_date") >= F.lit(first).cast("date"))
    if counts is None:
        rows = date_completeness(rows)
    good = (rows.filter((F.col("concepts") > 0) & (F.col("quoted_concepts") == F.col("concepts")) & (F.col("stocks") > 0))
            .select("trade_date"))
    if last is not None:
        good = good.orderBy(F.desc("trade_date")).limit(last)
    return good.orderBy("trade_date")


def archived_days(daily: DataFrame, first: str, last: str) -> DataFrame:
    """Complete dates of a range."""
    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    if end < start:
        raise ValueError("the range must be ascending")
    return complete_dates(daily, as_of=last, first=first)


def fill_timeline(series: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "snapshot_at",
                  date: str = "trade_date", step: int | None = None) -> DataFrame:
    """One row per expected clock of every (key, date) seen; gaps carry NULLs.

    Without ``step`` it is inferred per key: one minute if any point is off the
    five-minute raster, else five.  A five-minute day ends at 14:55 unless the
    key has a 15:00 point somewhere in the series.  The last record wins when
    a clock repeats.
    """
    keys, values = list(keys), list(values)
    timed = series.withColumn("_minute", (F.hour(at) * 60 + F.minute(at)).cast("int"))
    inferred = F.when(F.max(F.col("_minute") % 5 != 0), 1).otherwise(5) if step is None else F.lit(step)
    shape = timed.groupBy(*keys).agg(inferred.alias("_step"), F.max(F.col("_minute") == CLOSE).alias("_closed"))
    days = timed.select(*keys, date).distinct().join(shape, keys)
    grid = days.select(*keys, date, F.explode(
        F.when(F.col("_step") == 1, grid_array(1)).when(F.col("_closed"), grid_array(5))
        .otherwise(grid_array(5, CLOSE - 5))).alias("_minute"))
    seen = timed.groupBy(*keys, date, "_minute").agg(F.max_by(F.struct(*values), F.col(at)).alias("_record"))
    return (grid.join(seen, keys + [date, "_minute"], "left")
            .select(*keys, date, F.col("_minute").alias("minute"), clock_text(F.col("_minute")).alias("clock"),
                    *[F.col(f"_record.{v}").alias(v) for v in values]))
