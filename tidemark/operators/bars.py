"""One-minute rows to five-minute bars, with the checks a day must pass.

A security-day holds 241 minute rows (09:30 and 240 session minutes), so the
windows below sort at most that many rows once duplicates are rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE, OPENING, POINTS, bar_index
from tidemark.functions.scalars import CLOSE_TOLERANCE, same_price

SECURITY_DAY = ["trade_date", "market", "code"]
MINUTE_ROWS = 241


def cumulative_to_delta(rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str]) -> DataFrame:
    """Per-row increments of cumulative columns; the first row is its own increment.

    ``columns`` maps a cumulative column to the increment column.  A negative
    increment means the source went backwards; ``minute_errors`` reports it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({out: F.col(source) - F.coalesce(F.lag(source).over(w), F.lit(0))
                             for source, out in columns.items()})


def ohlcv(rows: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, volume: str) -> DataFrame:
    """Open, high, low, close, volume and row count of ticks per key; all combine map-side.

    One fixed-width order column keeps this a hash aggregate; several make it a
    sorted one.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by(price, at).alias("open_price"), F.max(price).alias("high_price"), F.min(price).alias("low_price"),
        F.max_by(price, at).alias("close_price"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("tick_count"))


def minute_errors(minutes: DataFrame) -> DataFrame:
    """(trade_date, market, code, reason) of security-days whose minute rows are unusable."""
    w = Window.partitionBy(*SECURITY_DAY).orderBy("minute")
    steps = _one_per_minute(minutes).withColumns({
        "_dv": F.col("cumulative_volume") - F.coalesce(F.lag("cumulative_volume").over(w), F.lit(0)),
        "_dt": F.col("cumulative_turnover") - F.coalesce(F.lag("cumulative_turnover").over(w), F.lit(0))})
    per_day = steps.groupBy(*SECURITY_DAY).agg(
        F.sum("_copies").alias("rows"), F.max(F.col("_copies") > 1).alias("repeated"),
        F.max(bar_index(F.col("minute")).isNull()).alias("off_grid"),
        F.min("_dv").alias("dv"), F.min("_dt").alias("dt"))
    reason = (F.when(F.col("off_grid"), "unexpected_minute").when(F.col("repeated"), "duplicate_minute")
              .when(F.col("dv") < 0, "volume_decreased").when(F.col("dt") < 0, "turnover_decreased")
              .when(F.col("rows") != MINUTE_ROWS, "minute_count"))
    return per_day.select(*SECURITY_DAY, reason.alias("reason")).filter(F.col("reason").isNotNull())


def _one_per_minute(minutes: DataFrame) -> DataFrame:
    """Collapse repeated minutes before any window, keeping how many there were."""
    return minutes.groupBy(*SECURITY_DAY, "minute").agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.first(c).alias(c) for c in ("open_price", "close_price", "high_price", "low_price", "cumulative_volume",
                                        "cumulative_turnover")])


def five_minute_bars(minutes: DataFrame, daily: DataFrame) -> DataFrame:
    """48 bars per security-day from cumulative minute rows.

    ``minutes``: trade_date, market, code, minute, prices, cumulative_volume,
    cumulative_turnover.  ``daily`` gives the day's official OHLC,
    previous_close, volume and turnover_rate per security.  Prices come from
    traded minutes; a bar without a trade shows its first minute.  A 09:30
    price without volume counts as the opening auction only when it equals the
    official open.
    """
    official = daily.select(*SECURITY_DAY, F.col("open_price").alias("_day_open"),
                            F.col("previous_close").alias("_day_previous"), F.col("volume").alias("_day_volume"),
                            F.col("turnover_rate").alias("_day_rate"))
    steps = cumulative_to_delta(_one_per_minute(minutes), SECURITY_DAY, "minute",
                                {"cumulative_volume": "_dv", "cumulative_turnover": "_dt"})
    rows = (steps.join(official, SECURITY_DAY)
            .withColumn("minute_index", bar_index(F.col("minute"))))
    quoted_open = F.when((F.col("minute") == OPENING) & (F.col("_dv") == 0)
                         & same_price(F.col("open_price"), F.col("_day_open")), F.col("open_price"))

    bars = rows.groupBy(*SECURITY_DAY, "minute_index").agg(
        *_folded(), F.max(quoted_open).alias("_auction"),
        *[F.first(c).alias(c) for c in ("_day_previous", "_day_volume", "_day_rate")])
    return bar_returns(_priced(bars))


def _folded() -> list[Column]:
    """Aggregates of a bar's minutes with their increments; fixed-width buffers keep this a hash aggregate."""
    traded = F.when(F.col("_dv") > 0, F.col("minute"))

    def over_trades(column: str, pick) -> Column:
        return pick(F.when(F.col("_dv") > 0, F.col(column)))

    return [F.min_by("open_price", traded).alias("_open"), F.max_by("close_price", traded).alias("_close"),
            over_trades("high_price", F.max).alias("_high"), over_trades("low_price", F.min).alias("_low"),
            *[F.min_by(f"{c}_price", "minute").alias(f"_first_{c}") for c in ("open", "high", "low", "close")],
            F.sum("_dv").alias("volume"), F.sum("_dt").alias("turnover"), F.count(F.lit(1)).alias("minute_rows"),
            F.max(F.when(F.col("minute") == CLOSE, F.col("_dv"))).alias("_close_auction_volume")]


def _priced(bars: DataFrame, *more: str) -> DataFrame:
    """Prices of folded bars: those of traded minutes, else of the first one; the opening auction counts where it is quoted."""
    return bars.select(
        *SECURITY_DAY, "minute_index", "minute_rows", "volume", "turnover", "_close_auction_volume", "_day_previous",
        "_day_volume", "_day_rate", *more,
        F.when(F.col("_open").isNull(), F.col("_first_open")).otherwise(F.coalesce("_auction", "_open"))
        .alias("open_price"),
        F.when(F.col("_high").isNull(), F.col("_first_high")).otherwise(F.greatest("_high", "_auction"))
        .alias("high_price"),
        F.when(F.col("_low").isNull(), F.col("_first_low")).otherwise(F.least("_low", "_auction"))
        .alias("low_price"),
        F.coalesce("_close", "_first_close").alias("close_price"))


def bar_returns(bars: DataFrame) -> DataFrame:
    """Amplitude, change and change rate against the previous bar's close, pro-rated turnover rate.

    The first bar is measured against the previous day's close.
    """
    w = Window.partitionBy(*SECURITY_DAY).orderBy("minute_index")
    base = F.coalesce(F.lag("close_price").over(w), F.col("_day_previous"))
    rate = F.when(F.col("_day_volume") > 0,
                  F.col("_day_rate") * F.col("volume").cast("double") / F.col("_day_volume").cast("double"))
    return (bars.withColumn("_base", base)
            .withColumns({
                "amplitude": (F.col("high_price") - F.col("low_price")) / F.nullif("_base", F.lit(0.0)),
                "change_value": F.col("close_price") - F.col("_base"),
                "change_pct": (F.col("close_price") - F.col("_base")) / F.nullif("_base", F.lit(0.0)),
                "turnover_rate": F.coalesce(rate, F.lit(0.0))})
            .drop("_day_volume", "_day_rate"))


def _fits(first_open: Column, highest: Column, lowest: Column, last_close: Column, auction_volume: Column,
          open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Whether the extremes of a day's bars are its official prices; without an auction the close may be a tick off."""
    close_fits = same_price(last_close, close) | ((auction_volume == 0) & (F.abs(last_close - close) <= CLOSE_TOLERANCE))
    return same_price(first_open, open_) & same_price(highest, high) & same_price(lowest, low) & close_fits


def reconcile_bars(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per security-day: bar counts, extremes against the official daily OHLC, verdict."""
    per_day = bars.groupBy(*SECURITY_DAY).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("minute_rows").alias("minute_rows"),
        F.count_if(F.col("minute_rows") != F.when(F.col("minute_index") == 0, 6).otherwise(5)).alias("short_bars"),
        F.min(F.col("_base")).alias("_lowest_base"),
        F.min_by("open_price", "minute_index").alias("first_open"), F.max("high_price").alias("highest"),
        F.min("low_price").alias("lowest"), F.max_by("close_price", "minute_index").alias("last_close"),
        F.max("_close_auction_volume").alias("_auction_volume"))
    joined = per_day.join(daily.select(*SECURITY_DAY, "open_price", "high_price", "low_price", "close_price"),
                          SECURITY_DAY)
    complete = ((F.col("bars") == POINTS) & (F.col("short_bars") == 0) & (F.col("minute_rows") == MINUTE_ROWS)
                & (F.col("_lowest_base") > 0))
    fits = _fits(*[F.col(c) for c in ("first_open", "highest", "lowest", "last_close", "_auction_volume",
                                      "open_price", "high_price", "low_price", "close_price")])
    return joined.select(*SECURITY_DAY, "bars", "minute_rows", "first_open", "highest", "lowest", "last_close",
                         F.when(~F.coalesce(complete, F.lit(False)), "incomplete")
                         .when(~F.coalesce(fits, F.lit(False)), "ohlc_mismatch").alias("reason"))


def judged_bars(minutes: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars of every security-day of ``minutes`` with its ``reason``, NULL where the day is sound.

    The same rules as ``minute_errors``, ``five_minute_bars`` and
    ``reconcile_bars``, in one pass: minutes are dealt by security-day and sorted
    once, and what follows stays where they are.
    """
    day = Window.partitionBy(*SECURITY_DAY)
    at = day.orderBy("minute")
    steps = minutes.select(
        *SECURITY_DAY, "minute", "open_price", "high_price", "low_price", "close_price",
        (F.col("cumulative_volume") - F.coalesce(F.lag("cumulative_volume").over(at), F.lit(0))).alias("_dv"),
        (F.col("cumulative_turnover") - F.coalesce(F.lag("cumulative_turnover").over(at), F.lit(0))).alias("_dt"),
        F.coalesce(F.lag("minute").over(at) == F.col("minute"), F.lit(False)).alias("_copy"))
    folded = steps.groupBy(*SECURITY_DAY, bar_index(F.col("minute")).alias("minute_index")).agg(
        *_folded(), F.max(F.when((F.col("minute") == OPENING) & (F.col("_dv") == 0), F.col("open_price"))).alias("_opening"),
        F.max("_copy").alias("_copies"), F.min("_dv").alias("_least_volume"), F.min("_dt").alias("_least_turnover"))
    own = {"open_price": "_day_open", "high_price": "_day_high", "low_price": "_day_low", "close_price": "_day_close",
           "previous_close": "_day_previous", "volume": "_day_volume", "turnover_rate": "_day_rate"}
    official = daily.select(*SECURITY_DAY, *[F.col(c).alias(name) for c, name in own.items()], F.lit(True).alias("_known"))
    joined = folded.join(official.hint("shuffle_hash"), SECURITY_DAY, "left").withColumn(
        "_auction", F.when(same_price(F.col("_opening"), F.col("_day_open")), F.col("_opening")))
    kept = ("_day_open", "_day_high", "_day_low", "_day_close", "_known", "_copies", "_least_volume", "_least_turnover")
    bars = bar_returns(_priced(joined, *kept))

    def over(column: Column) -> Column:
        return column.over(day)

    error = (F.when(over(F.max(F.col("minute_index").isNull())), "unexpected_minute").when(over(F.max("_copies")), "duplicate_minute")
             .when(over(F.min("_least_volume")) < 0, "volume_decreased").when(over(F.min("_least_turnover")) < 0, "turnover_decreased")
             .when(over(F.sum("minute_rows")) != MINUTE_ROWS, "minute_count").when(F.col("_known").isNull(), "no_daily_row"))
    whole = F.when(F.col("minute_index") == 0, 6).otherwise(5)
    complete = ((over(F.count(F.lit(1))) == POINTS) & (over(F.count_if(F.col("minute_rows") != whole)) == 0)
                & (over(F.min("_base")) > 0))
    fits = _fits(over(F.min_by("open_price", "minute_index")), over(F.max("high_price")), over(F.min("low_price")),
                 over(F.max_by("close_price", "minute_index")), over(F.max("_close_auction_volume")),
                 *[F.col(f"_day_{c}") for c in ("open", "high", "low", "close")])
    return bars.select(
        *SECURITY_DAY, "minute_index", "open_price", "high_price", "low_price", "close_price", "volume", "turnover", "amplitude",
        "change_pct", "change_value", "turnover_rate",
        F.coalesce(error, F.when(~F.coalesce(complete, F.lit(False)), "incomplete").when(
            ~F.coalesce(fits, F.lit(False)), "ohlc_mismatch")).alias("reason"))


def archive_bars(minutes: DataFrame, daily: DataFrame, source: str = "trend_1m",
                 keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Accepted bars, and rejected security-days with their reason.

    A bad security-day never stops the others; one without a daily row cannot
    be held against anything and is rejected as ``no_daily_row``.  Bars and
    verdicts are used several times: a job that writes both results gives
    ``keep`` (e.g. ``stored``), so that minutes are folded only once.
    """
    judged = keep(judged_bars(minutes, daily))
    good = (judged.filter(F.col("reason").isNull()).withColumn("source", F.lit(source))
            .select(*SECURITY_DAY, "minute_index", "source", "open_price", "high_price", "low_price", "close_price",
                    "volume", "turnover", "amplitude", "change_pct", "change_value", "turnover_rate"))
    verdict = keep(judged.groupBy(*SECURITY_DAY).agg(F.min("reason").alias("reason")))
    return good, keep(verdict.filter(F.col("reason").isNotNull()))
