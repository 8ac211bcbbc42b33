"""Joins that complete a day's rank rows: quotes, closing money, bars, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE
from tidemark.functions.ordinals import position_in_group
from tidemark.functions.scalars import (clock_minute, quote_date, scale_e4, scale_ppm)

QUOTE_FIELDS = ("open_price", "high_price", "low_price", "previous_close", "change_value", "volume", "turnover",
                "turnover_rate", "amplitude")
POINT_KEY = ["trade_date", "minute_index", "market", "code"]


def only_quoted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("quote_available"))


def _with_quotes(rows: DataFrame, quotes: DataFrame, on: Sequence[str]) -> DataFrame:
    side = quotes.select(*on, F.struct(
        F.col("latest_price").alias("close_price"), *[F.col(f) for f in QUOTE_FIELDS], "change_pct",
        "quote_time", "available").alias("_q"))
    return rows.join(side, list(on), "left")


def _quote_or_zero(rows: DataFrame, fields: Sequence[str]) -> dict[str, Column]:
    kinds = dict(rows.dtypes)
    return {f: F.coalesce(F.col(f"_q.{f}"), F.lit(0)).cast(kinds[f]) for f in fields}


def enrich_stock_quotes(rows: DataFrame, quotes: DataFrame, on: Sequence[str] = ("code",)) -> DataFrame:
    """Stock rank rows with the day's quote; missing quotes leave zeros and a cleared bit.

    The change rate is only overwritten by an available quote.  Check
    ``misdated_quotes`` first: one wrong date voids the whole day.
    """
    joined = _with_quotes(rows, quotes, on)
    available = F.coalesce(F.col("_q.available"), F.lit(False))
    return joined.withColumns({
        **_quote_or_zero(rows, ("close_price", *QUOTE_FIELDS)),
        "change_pct": F.when(available, F.col("_q.change_pct")).otherwise(F.col("change_pct")),
        "quote_available": available,
    }).drop("_q").select(*rows.columns)


def misdated_quotes(quotes: DataFrame, trade_date: str | Column) -> DataFrame:
    """Available quotes whose time is on another date (or unreadable)."""
    day = F.lit(trade_date).cast("date") if isinstance(trade_date, str) else trade_date
    return quotes.filter(F.col("available") & ~F.coalesce(quote_date(F.col("quote_time")) == day, F.lit(False)))


def enrich_board_quotes(rows: DataFrame, quotes: DataFrame,
                        on: Sequence[str] = ("code",)) -> tuple[DataFrame, DataFrame]:
    """Board rows with their quote, and the rows that void the day.

    Boards are strict: a missing, unavailable or misdated quote is an error row
    (rank_type, code, reason).
    """
    joined = _with_quotes(rows, quotes, on)
    usable = F.coalesce(F.col("_q.available"), F.lit(False))
    dated = F.coalesce(quote_date(F.col("_q.quote_time")) == F.col("trade_date"), F.lit(False))
    errors = (joined.filter(~(usable & dated))
              .select("rank_type", "code", F.when(~usable, "missing_quote").otherwise("wrong_date").alias("reason")))
    good = joined.filter(usable & dated).withColumns({
        **_quote_or_zero(rows, ("close_price", *QUOTE_FIELDS)),
        "change_pct": F.col("_q.change_pct"), "quote_time": F.col("_q.quote_time"), "quote_available": F.lit(True),
    }).drop("_q").select(*rows.columns)
    return good, errors


def merge_close_money(rows: DataFrame, points: DataFrame,
                      on: Sequence[str] = ("trade_date", "rank_type", "code")) -> DataFrame:
    """Let the 15:00 money point override the funding fields of the daily row."""
    fields = ("dark_money", "regular_money", "main_money_inflow")
    close = (points.filter(clock_minute(F.col("snapshot_at")) == CLOSE)
             .select(*on, F.struct(*fields).alias("_m")))
    return rows.join(close, list(on), "left").withColumns({
        **{f: F.coalesce(F.col(f"_m.{f}"), F.col(f)) for f in fields},
        "money_available": F.col("money_available") | F.col("_m").isNotNull(),
    }).drop("_m").select(*rows.columns)


def eligible_only(points: DataFrame, daily: DataFrame,
                  on: Sequence[str] = ("trade_date", "market", "code")) -> tuple[DataFrame, DataFrame]:
    """Points of stocks quoted that day, and the points of all others.

    One row a stock and day is hashed, so the points are not sorted.
    """
    quoted = daily.filter((F.col("rank_type") == "stock") & F.col("quote_available")).select(*on).hint("shuffle_hash")
    return points.join(quoted, list(on), "left_semi"), points.join(quoted, list(on), "left_anti")


def merge_money_and_bars(money: DataFrame, bars: DataFrame) -> DataFrame:
    """Five-minute research rows: money and bar columns side by side, each with its bit.

    Either side may be missing for a point; its columns are then zero.  Prices
    are stored as whole 1/10000, ratios as whole millionths.
    """
    amounts = ("dark_money", "regular_money", "main_money_inflow")
    prices = ("open_price", "high_price", "low_price", "close_price", "change_value")
    ratios = ("amplitude", "change_pct", "turnover_rate")
    left = money.select(*POINT_KEY, F.col("rank").cast("bigint").alias("money_rank"), *amounts,
                        F.lit(True).alias("money_available"))
    right = bars.select(*POINT_KEY, *[scale_e4(F.col(p)).alias(f"{p}_e4") for p in prices],
                        *[scale_ppm(F.col(r)).alias(f"{r}_ppm") for r in ratios], "volume", "turnover",
                        F.lit(True).alias("kline_available"))
    numbers = ["money_rank", *amounts, *[f"{p}_e4" for p in prices], *[f"{r}_ppm" for r in ratios], "volume", "turnover"]
    return left.join(right.hint("merge"), POINT_KEY, "full_outer").fillna(0, numbers).fillna(
        False, ["money_available", "kline_available"])


def rank_at_time(points: DataFrame, value: str = "dark_money",
                 group: Sequence[str] = ("trade_date", "rank_type", "snapshot_at"), tie: Sequence[str] = ("code",),
                 out: str = "rank") -> DataFrame:
    """Strict 1..n by value descending, then code, inside each time point."""
    return position_in_group(points.drop(out), list(group), [F.desc(value), *[F.asc(t) for t in tie]], out)
