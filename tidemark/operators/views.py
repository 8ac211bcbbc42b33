"""Read-side operators: pages, latest boards, series, constituent tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE, index_clock, index_minute
from tidemark.functions.scalars import clock_minute, contains_text, unscale_e4, unscale_ppm

# Columns a close page may be sorted by.
SORTABLE = ("rank", "name", "code", "dark_money", "main_money_inflow", "change_pct", "dark_activity", "open_price",
            "high_price", "low_price", "close_price", "previous_close", "volume", "turnover", "turnover_rate",
            "amplitude")
CUMULATIVE = ("dark_money", "regular_money", "main_money_inflow")
RANK_METRICS = ("dark_activity", "dark_inflow_ratio", "rank", "up_count")


# -- pages and orders --------------------------------------------------------

def search_text(rows: DataFrame, needle: str, columns: Sequence[str] = ("name", "code")) -> DataFrame:
    """Literal substring search; wildcards have no meaning."""
    return rows.filter(contains_text(needle, *[F.col(c) for c in columns])) if needle else rows


def close_page(daily: DataFrame, rank_type: str, trade_date: str | None = None, search: str = "", sort: str = "rank",
               descending: bool = False, page: int = 1, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page of closes and, apart from it, the total row count.

    Spark keeps at most offset + size rows per task for the page; the total is
    a count with its own (pruned) scan.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size from 1")
    rows = daily.filter(F.col("rank_type") == rank_type)
    if trade_date is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    rows = search_text(rows, search.strip())
    column = sort if sort in SORTABLE else "rank"
    order = [F.desc(column) if descending else F.asc(column), F.asc("rank"), F.asc("code"), F.asc("trade_date")]
    return (rows.orderBy(*order).offset((page - 1) * size).limit(size), rows.agg(F.count(F.lit(1)).alias("total")))


def type_order(column: str = "rank_type") -> Column:
    return F.when(F.col(column) == "industry", 1).when(F.col(column) == "concept", 2).otherwise(3)


def daily_listing(daily: DataFrame, trade_date: str | None = None) -> DataFrame:
    """All closes of a date: industries, concepts, stocks, each by rank."""
    rows = daily if trade_date is None else daily.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    return rows.orderBy("trade_date", type_order(), "rank")


def pick_codes(daily: DataFrame, codes: Sequence[str] | DataFrame, trade_date: str | None = None) -> DataFrame:
    """Stock closes of a code list, by rank.  Empty and repeated codes do not matter."""
    rows = daily.filter(F.col("rank_type") == "stock")
    if trade_date is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    if isinstance(codes, DataFrame):
        wanted = codes.select("code").filter(F.col("code") != "").distinct()
        return rows.join(wanted, "code", "left_semi").orderBy("rank", "code")
    return rows.filter(F.col("code").isin(*sorted({c for c in codes if c}))).orderBy("rank", "code")


def available_first(rows: DataFrame, available: str, column: str, descending: bool = False) -> DataFrame:
    """Rows lacking the data go last in either direction."""
    return rows.orderBy(F.desc(available), F.desc(column) if descending else F.asc(column), "code")


def latest_snapshot(board: DataFrame, keys: Sequence[str] = ("rank_type",)) -> DataFrame:
    """All rows of the most recent snapshot of each key, by rank."""
    newest = board.groupBy(*keys).agg(F.max("snapshot_at").alias("snapshot_at"))
    return board.join(F.broadcast(newest), [*keys, "snapshot_at"], "left_semi").orderBy(*keys, "rank")  # a row a key


def first_non_empty(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each key the rows of the first source that has any."""
    tagged = None
    for priority, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(priority))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    best = tagged.groupBy(*keys).agg(F.min("_source").alias("_source"))
    return tagged.join(best, [*keys, "_source"], "left_semi").drop("_source")


# -- ranks and series of boards ----------------------------------------------

def latest_rank(minute_board: DataFrame, daily: DataFrame) -> DataFrame:
    """Latest board per type: the working set if it has one, else the last close."""
    return first_non_empty([latest_snapshot(minute_board), latest_snapshot(daily)], ["rank_type"])


def rank_at(minute_board: DataFrame, curve: DataFrame, daily: DataFrame, at: Column) -> DataFrame:
    """Board at an instant: working set, else curve points (not at 15:00), else closes at 15:00."""
    here = F.col("snapshot_at") == at
    closing = clock_minute(F.col("snapshot_at")) == CLOSE
    return first_non_empty([minute_board.filter(here), curve.filter(here & ~closing), daily.filter(here & closing)],
                           ["rank_type"]).orderBy("rank_type", "rank")


def day_series(minute_board: DataFrame, curve: DataFrame, daily: DataFrame,
               keys: Sequence[str] = ("trade_date", "rank_type", "code")) -> DataFrame:
    """Intraday series per key: working set, else curve plus the close row, else the close alone."""
    chosen = first_non_empty([minute_board, curve], list(keys))
    from_work = minute_board.select(*keys).distinct()
    closes = daily.join(from_work, list(keys), "left_anti")
    return chosen.unionByName(closes, allowMissingColumns=True).orderBy(*keys, "snapshot_at")


def time_range(rows: DataFrame, start: str, end: str, at: str = "snapshot_at") -> DataFrame:
    """Rows from ``start`` to ``end`` inclusive; a bare end date reaches to the end of that day."""
    kind = dict(rows.dtypes)[at]
    if len(end) == 10:
        following = (dt.date.fromisoformat(end) + dt.timedelta(days=1)).isoformat()
        upper = F.col(at) < F.lit(following).cast(kind)
    else:
        upper = F.col(at) <= F.lit(end).cast(kind)
    return rows.filter((F.col(at) >= F.lit(start).cast(kind)) & upper)


def range_series(curve: DataFrame, rank_type: str, code: str, start: str, end: str) -> DataFrame:
    rows = curve.filter((F.col("rank_type") == rank_type) & (F.col("code") == code))
    return time_range(rows, start, end).orderBy("snapshot_at", "rank")


def stock_series(research: DataFrame, code: str | None = None, trade_date: str | None = None) -> DataFrame:
    """Five-minute stock rows with real prices and ratios and the clock of each point."""
    rows = research
    if code is not None:
        rows = rows.filter(F.col("code") == code)
    if trade_date is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    prices = ("open_price", "high_price", "low_price", "close_price", "change_value")
    ratios = ("amplitude", "change_pct", "turnover_rate")
    return rows.select(
        "trade_date", "market", "code", "minute_index", index_clock(F.col("minute_index")).alias("clock"),
        (F.col("trade_date").cast("timestamp_ntz")
         + F.make_dt_interval(mins=index_minute(F.col("minute_index")))).alias("snapshot_at"),
        "money_rank", *CUMULATIVE, "money_available",
        *[unscale_e4(F.col(f"{p}_e4")).alias(p) for p in prices],
        *[unscale_ppm(F.col(f"{r}_ppm")).alias(r) for r in ratios], "volume", "turnover", "kline_available",
    ).orderBy("trade_date", "market", "code", "minute_index")


def series_meta(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interval tag and point counts per series.

    ``1m`` if any point is off the five-minute raster, ``5m+close`` if a close
    row is among the points, else ``5m``.  A close row is a 15:00 row whose
    quote time is not a ten-digit source time.
    """
    minute = clock_minute(F.col("snapshot_at"))
    close = (minute == CLOSE) & (F.length("quote_time") != 10)
    off = F.pmod(minute, F.lit(5)) != 0
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.when(F.max(off), "1m").when(F.max(close), "5m+close").otherwise("5m").alias("interval"),
        F.count_if(~close & ~off).alias("research_points"), F.max(close).cast("int").alias("daily_close_points"))


def series_delta(series: DataFrame, keys: Sequence[str], value: str = "dark_money", at: str = "snapshot_at") -> DataFrame:
    """Last minus first value and the number of points."""
    return series.groupBy(*keys).agg(
        (F.max_by(value, at) - F.min_by(value, at)).alias("delta"), F.count(F.lit(1)).alias("points"))


def available_metric(metric: str) -> Column:
    """The metric, or NULL where it was not observed (drawn as a gap)."""
    if metric in CUMULATIVE:
        return F.when(F.col("money_available"), F.col(metric))
    if metric in RANK_METRICS:
        return F.when(F.col("rank") > 0, F.col(metric))
    return F.col(metric)


def stitch_cumulative(series: DataFrame, keys: Sequence[str], value: str, out: str, date: str = "trade_date",
                      at: str = "snapshot_at") -> DataFrame:
    """Chain a daily cumulative metric over days: each day starts where the last one ended.

    A day's contribution is its last non-NULL value (one aggregated row per key
    and day); the running sum of earlier days is joined back.  NULL points stay
    NULL, and a day without any value moves nothing.
    """
    keys = list(keys)
    days = series.groupBy(*keys, date).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(*keys, date, F.coalesce(F.sum("_last").over(earlier), F.lit(0)).alias("_offset"))
    return (series.join(offsets, keys + [date]).withColumn(out, F.col(value) + F.col("_offset")).drop("_offset"))


# -- constituents ------------------------------------------------------------

def constituent_board(members: DataFrame, quotes: DataFrame, daily: DataFrame) -> DataFrame:
    """Members with live quote and daily close.

    Turnover falls back to the close when the quote has none; the OHLC group,
    turnover rate and amplitude fall back together when the quote has no open.
    """
    grouped = ("open_price", "high_price", "low_price", "previous_close", "turnover_rate", "amplitude")
    plain = ("latest_price", "change_pct", "change_value", "volume")
    live = quotes.select(F.col("code").alias("stock_code"),
                         F.struct(*grouped, *plain, "turnover", "quote_time", "available").alias("_q"))
    close = (daily.filter(F.col("rank_type") == "stock")
             .select(F.col("code").alias("stock_code"),
                     F.struct(*grouped, "turnover", "rank", "dark_money", "main_money_inflow", "dark_activity").alias("_d")))

    def number(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0))

    no_open = number("_q", "open_price") == 0
    joined = members.join(live, "stock_code", "left").join(close, "stock_code", "left")
    return joined.withColumns({
        **{n: number("_q", n) for n in plain},
        **{n: F.when(no_open, number("_d", n)).otherwise(number("_q", n)) for n in grouped},
        "turnover": F.when(number("_q", "turnover") == 0, number("_d", "turnover")).otherwise(number("_q", "turnover")),
        "quote_time": F.coalesce("_q.quote_time", F.lit("")),
        "quote_available": F.coalesce("_q.available", F.lit(False)),
        "dark_rank": number("_d", "rank"), "dark_money": number("_d", "dark_money"),
        "main_money_inflow": number("_d", "main_money_inflow"), "dark_activity": number("_d", "dark_activity"),
        "dark_data_available": F.col("_d").isNotNull(),
    }).drop("_q", "_d").orderBy("board_code", "stock_code")
