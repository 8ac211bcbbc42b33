"""Daily features of every key on every sealed date, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.grid import POINTS
from tidemark.functions.ordinals import midrank_percentiles, trailing_midrank
from tidemark.functions.scalars import ratio_or_zero
from tidemark.operators.calendar import date_index, with_date_index
from tidemark.schemas import KEY

LOOKBACK = 60
SELF_WINDOWS = (5, 10, 20, 60)
# Curve cuts: the points of 11:30, 14:30 and 15:00.
NOON, HALF_PAST_TWO, LAST = 23, 41, 47

CURVE_COLUMNS = ("curve_available", "morning_dark_share", "afternoon_dark_share", "late_dark_share",
                 "max_inflow_minute_index", "max_outflow_minute_index", "tail_acceleration", "max_dark_drawdown",
                 "intraday_reversal")


def usable(daily: DataFrame) -> DataFrame:
    """Rows features and labels may use: every board, but only quoted stocks."""
    return daily.filter((F.col("rank_type") != "stock") | F.col("quote_available"))


# -- cross-section -----------------------------------------------------------

def cross_section_percentiles(daily: DataFrame, group: Sequence[str] = ("trade_date", "rank_type"),
                              measures: dict[str, str | Column] | None = None,
                              population: DataFrame | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Mid-rank percentiles of rank (best high), turnover and dark money; ``key`` as in ``midrank_percentiles``."""
    return midrank_percentiles(daily, group, measures or {
        "rank_percentile": -F.col("rank"),
        "turnover_percentile": F.col("turnover"),
        "dark_money_percentile": F.col("dark_money"),
    }, population, key)


# -- time series per key -----------------------------------------------------
# All windows below share partition and order, so Spark plans one shuffle and
# one sort for all of them.  A key has one row per sealed date.

def _timeline(keys: Sequence[str], index: str):
    return Window.partitionBy(*keys).orderBy(index)


def rank_change(keys: Sequence[str] = KEY, rank: str = "rank", index: str = "date_idx") -> Column:
    """Yesterday's rank minus today's; 0 if absent on the previous sealed date."""
    day_before = _timeline(keys, index).rangeBetween(-1, -1)
    return F.coalesce(F.first(rank).over(day_before) - F.col(rank), F.lit(0).cast("bigint"))


def second_difference(value: str, keys: Sequence[str] = KEY, index: str = "date_idx") -> Column:
    """v - 2 v(-1) + v(-2) over consecutive sealed dates; 0 unless both exist."""
    w = _timeline(keys, index)
    one, two = F.first(value).over(w.rangeBetween(-1, -1)), F.first(value).over(w.rangeBetween(-2, -2))
    return F.coalesce(F.col(value) - 2 * one + two, F.lit(0).cast("bigint"))


def add_streak(df: DataFrame, value: str, out: str, keys: Sequence[str] = KEY, index: str = "date_idx",
               cap: int | None = LOOKBACK) -> DataFrame:
    """Consecutive sealed dates up to today with ``value`` > 0, at most ``cap`` (None: no bound).

    A run can start today (after a gap) or tomorrow (today is not positive);
    the latest start so far is a running maximum.
    """
    w = _timeline(keys, index)
    previous = F.lag(index).over(w)
    start = (F.when(F.col(value) <= 0, F.col(index) + 1)
             .when(previous.isNull() | (previous != F.col(index) - 1), F.col(index)))
    started = df.withColumn("_start", start)
    latest = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    length = F.col(index) - latest + 1
    return (started.withColumn(out, (length if cap is None else F.least(F.lit(cap), length)).cast("int"))
            .drop("_start"))


def recent_values(value: str, keys: Sequence[str] = KEY, index: str = "date_idx") -> Column:
    """Values of the records present within the last 60 sealed dates, oldest first (at most 60)."""
    return F.collect_list(value).over(_timeline(keys, index).rangeBetween(-(LOOKBACK - 1), 0))


def self_percentiles(df: DataFrame, value: str, prefix: str, keys: Sequence[str] = KEY, index: str = "date_idx",
                     windows: Sequence[int] = SELF_WINDOWS) -> DataFrame:
    """Today's mid-rank among the key's last N present records, NULL when fewer."""
    held = df.withColumn("_recent", recent_values(value, keys, index))
    return held.withColumns({f"{prefix}_{n}": trailing_midrank(F.col("_recent"), n) for n in windows}).drop("_recent")


# -- intraday curve ----------------------------------------------------------

def day_curves(points: DataFrame, keys: Sequence[str], index: str = "minute_index", value: str = "dark_money",
               out: str = "curve") -> DataFrame:
    """The 48 cumulative points of each key as one array; NULL unless all 48 exist.

    Built from 48 conditional maxima, so it combines map-side and its state per
    key is 48 numbers however many rows arrive.
    """
    slots = ", ".join(f"max(CASE WHEN `{index}` = {i} THEN `{value}` END)" for i in range(POINTS))
    wide = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.expr(f"array({slots})").alias("_curve"))
    complete = (F.col("_rows") == POINTS) & ~F.exists("_curve", lambda x: x.isNull())
    return wide.select(*keys, F.when(complete, F.col("_curve")).alias(out))


def curve_shape(curves: DataFrame, curve: str = "curve") -> DataFrame:
    """Add the shape columns of a curve array; a NULL curve gives 0 / -1 / false."""
    c = F.col(curve)
    known = c.isNotNull()
    final = F.get(c, F.lit(LAST))
    noon, late = F.get(c, F.lit(NOON)), F.get(c, F.lit(HALF_PAST_TWO))
    moves = F.zip_with(c, F.concat(F.array(F.lit(0).cast("bigint")), F.slice(c, 1, POINTS - 1)), lambda now, old: now - old)
    # Running peak and worst fall below it, folded along the curve.
    fall = F.aggregate(
        c, F.struct(F.get(c, F.lit(0)).alias("peak"), F.lit(0).cast("bigint").alias("fall")),
        lambda acc, x: F.struct(
            F.greatest(acc["peak"], x).alias("peak"),
            F.least(acc["fall"], x - F.greatest(acc["peak"], x)).alias("fall")),
        lambda acc: acc["fall"])
    # The level changes sign iff it is above zero somewhere and below elsewhere.
    flips = (F.array_max(c) > 0) & (F.array_min(c) < 0)
    with_moves = curves.withColumn("_moves", moves)
    m = F.col("_moves")

    def share(part: Column) -> Column:
        return F.when(known & (final != 0), part.cast("double") / final).otherwise(F.lit(0.0))

    def where(extreme: Column) -> Column:
        return F.when(known, F.array_position(m, extreme).cast("int") - 1).otherwise(F.lit(-1))

    return with_moves.withColumns({
        "curve_available": known,
        "morning_dark_share": share(noon),
        "afternoon_dark_share": share(late - noon),
        "late_dark_share": share(final - late),
        "max_inflow_minute_index": where(F.array_max(m)),
        "max_outflow_minute_index": where(F.array_min(m)),
        "tail_acceleration": F.coalesce(F.get(m, F.lit(LAST)) - F.get(m, F.lit(LAST - 1)), F.lit(0).cast("bigint")),
        "max_dark_drawdown": F.coalesce(fall, F.lit(0).cast("bigint")),
        "intraday_reversal": F.coalesce(flips, F.lit(False)),
    }).drop("_moves")


def price_money_divergence(final: Column, change_pct: Column) -> Column:
    """Money and price ended the day on opposite sides of zero."""
    return F.coalesce((change_pct != 0) & (final.cast("double") * change_pct < 0), F.lit(False))


# -- scalars next to them ----------------------------------------------------

def signed_activity() -> Column:
    return F.when(F.col("dark_money") < 0, -F.col("dark_activity")).otherwise(F.col("dark_activity"))


def capital_intensity() -> Column:
    return ratio_or_zero(F.col("main_money_inflow"), F.col("turnover"))


def control_coefficient() -> Column:
    return ratio_or_zero(F.col("regular_money") + F.col("dark_money"), F.col("turnover")) * 100


# -- the whole feature table -------------------------------------------------

FEATURE_COLUMNS = (
    ["trade_date", *KEY, "name", "primary_industry_code", "signed_dark_activity", "capital_intensity",
     "control_coefficient", "rank_percentile", "turnover_percentile", "dark_money_percentile"]
    + [f"self_turnover_percentile_{n}" for n in SELF_WINDOWS]
    + [f"self_dark_money_percentile_{n}" for n in SELF_WINDOWS]
    + ["rank_change_1", "consecutive_inflow_days", "money_acceleration", *CURVE_COLUMNS, "price_money_divergence"])


def daily_features(daily: DataFrame, points: DataFrame, industries: DataFrame | None = None,
                   sealed: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """All features for all keys and sealed dates.

    ``daily``      close records, unique on (trade_date, key);
    ``points``     money points with ``minute_index`` 0..47, unique on (trade_date, key, minute_index);
    ``industries`` (trade_date, stock_code, industry_code) in force on each date;
    ``sealed``     dates that exist for look-backs (default: the dates of ``daily``).

    With ``first``/``last`` only that slice is produced: the input is cut to the
    slice plus the 59 sealed dates before it, so a recompute reads a bounded
    range of partitions.
    """
    index = date_index(sealed if sealed is not None else daily)
    if first is not None:
        # Cut the date dimension, not the rows: the broadcast join then prunes date partitions of the scan.
        floor = index.filter(F.col("trade_date") >= F.lit(first).cast("date")).agg(F.min("date_idx")).scalar()
        index = index.filter(F.col("date_idx") >= floor - (LOOKBACK - 1))
        points = points.filter(F.col("trade_date") >= F.lit(first).cast("date"))
    if last is not None:
        index = index.filter(F.col("trade_date") <= F.lit(last).cast("date"))
        points = points.filter(F.col("trade_date") <= F.lit(last).cast("date"))
    rows = with_date_index(usable(daily), index)
    rows = rows.select("trade_date", "date_idx", *KEY, "name", "rank", "turnover", "dark_money", "regular_money",
                       "main_money_inflow", "dark_activity", "change_pct")
    series = rows.withColumns({"rank_change_1": rank_change(), "money_acceleration": second_difference("main_money_inflow"),
                               "_turnovers": recent_values("turnover"), "_darks": recent_values("dark_money")})
    series = add_streak(series, "main_money_inflow", "consecutive_inflow_days")
    if first is not None:
        series = series.filter(F.col("trade_date") >= F.lit(first).cast("date"))
    series = series.withColumns({
        **{f"self_turnover_percentile_{n}": trailing_midrank(F.col("_turnovers"), n) for n in SELF_WINDOWS},
        **{f"self_dark_money_percentile_{n}": trailing_midrank(F.col("_darks"), n) for n in SELF_WINDOWS},
        "signed_dark_activity": signed_activity(),
        "capital_intensity": capital_intensity(),
        "control_coefficient": control_coefficient(),
    }).drop("_turnovers", "_darks")

    # A key without a whole curve gets the same values as one without points; the arrays stay behind.
    whole = day_curves(points, ["trade_date", *KEY]).filter(F.col("curve").isNotNull())
    curves = curve_shape(whole).withColumn("_final", F.get("curve", F.lit(LAST))).drop("curve")
    joined = series.join(curves, ["trade_date", *KEY], "left")
    no_curve = {"curve_available": False, "morning_dark_share": 0.0, "afternoon_dark_share": 0.0,
                "late_dark_share": 0.0, "max_inflow_minute_index": -1, "max_outflow_minute_index": -1,
                "tail_acceleration": 0, "max_dark_drawdown": 0, "intraday_reversal": False}
    joined = joined.withColumn(
        "price_money_divergence", price_money_divergence(F.col("_final"), F.col("change_pct"))
    ).drop("_final").fillna(no_curve)

    if industries is None:
        joined = joined.withColumn("primary_industry_code", F.lit(""))
    else:
        stock = F.lit("stock").alias("rank_type")
        held = industries.select("trade_date", stock, F.col("stock_code").alias("code"),
                                 F.col("industry_code").alias("primary_industry_code"))
        joined = joined.join(held, ["trade_date", "rank_type", "code"], "left").fillna({"primary_industry_code": ""})
    # Counted on the rows before any window or join; only the look-back slice is cut off.
    counted = rows if first is None else rows.filter(F.col("trade_date") >= F.lit(first).cast("date"))
    return cross_section_percentiles(joined, population=counted, key=["trade_date", *KEY]).select(*FEATURE_COLUMNS)


def read_features(features: DataFrame, trade_date: str | None = None, revisions: DataFrame | None = None,
                  revision_id: str | None = None, rank_type: str | None = None) -> DataFrame:
    """Features of a date, or of the date a revision stands for; ordered by type and code."""
    rows = features
    if revision_id is not None:
        rows = rows.join(F.broadcast(revisions.filter(F.col("revision_id") == revision_id)
                                     .select("trade_date", "revision_id")), "trade_date")
    elif trade_date is not None:
        rows = rows.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    if rank_type is not None:
        rows = rows.filter(F.col("rank_type") == rank_type)
    return rows.orderBy("trade_date", "rank_type", "code")
