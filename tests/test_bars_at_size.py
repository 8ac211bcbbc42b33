"""Bars of a run: minutes are dealt once and folded in one pass, research rows merged once, by the rules of the single operators."""

from pyspark.sql import functions as F

from builders import day
from test_bar_jobs import DATE, GRID
from test_points_at_size import SF, plan
from tidemark.operators import bars as br
from tidemark.operators.enrich import merge_money_and_bars
from tidemark.plans import standin as st
from tidemark.session import stored
from tidemark.sources.tables import with_bars


def test_minutes_of_a_day_are_dealt_once(spark):
    minutes, daily = (stored(x) for x in st.stock_minutes(spark, SF))
    kept = []
    br.archive_bars(minutes, daily, keep=lambda df: kept.append(df) or df)
    text = plan(kept[0])
    assert text.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in text  # the minutes and the daily rows
    with_reason = [df for df in kept if "reason" in df.columns]
    assert len(with_reason) == 3


def test_research_rows_are_merged_once(spark):
    bars = stored(st.stock_bars(spark, SF))
    money = st.money_points(spark, SF).filter("rank_type = 'stock'").selectExpr("*", "0 AS rank")
    research = stored(merge_money_and_bars(money, bars))
    assert plan(with_bars(research, bars)).count("SortMergeJoin") == 1


def test_research_rows_keep_what_is_not_given(spark):
    kind = "code string, minute_index int, money boolean, kline boolean, n bigint"
    rows = [("A", 0, True, True, 1), ("B", 0, True, False, 2), ("C", 0, False, True, 3), ("D", 0, False, True, 4), ("E", 0, True, False, 5)]
    amounts, prices = ("money_rank", "dark_money", "regular_money", "main_money_inflow"), ("open_price", "high_price", "low_price", "close_price", "change_value")
    old = spark.createDataFrame(rows, kind).select(
        F.lit(day(DATE)).alias("trade_date"), "minute_index", F.lit(1).cast("bigint").alias("market"), "code",
        *[F.when(F.col("money"), F.col("n")).otherwise(0).alias(c) for c in amounts], F.col("money").alias("money_available"),
        *[F.when(F.col("kline"), F.col("n")).otherwise(0).alias(c) for c in (*[f"{p}_e4" for p in prices], "amplitude_ppm", "change_pct_ppm", "turnover_rate_ppm",
                                                                          "volume", "turnover")], F.col("kline").alias("kline_available"))
    bars = spark.createDataFrame([("A", 70), ("B", 80), ("C", 90), ("F", 100)], "code string, volume bigint").select(
        F.lit(day(DATE)).alias("trade_date"), F.lit(0).alias("minute_index"), F.lit(1).cast("bigint").alias("market"), "code",
        *[F.lit(2.0).alias(p) for p in (*prices, "amplitude", "change_pct", "turnover_rate")], "volume", F.lit(7).cast("bigint").alias("turnover"))
    got = {r["code"]: (r["dark_money"], r["money_available"], r["close_price_e4"], r["volume"], r["kline_available"]) for r in with_bars(old, bars).collect()}
    assert got == {"A": (1, True, 20_000, 70, True), "B": (2, True, 20_000, 80, True), "C": (0, False, 20_000, 90, True),
                   "D": (0, False, 4, 4, True), "E": (5, True, 0, 0, False), "F": (0, False, 20_000, 100, True)}


def test_one_pass_judges_as_the_single_operators(spark):
    def rows(code, minutes=GRID, price=10.0, step=1):
        return [(day(DATE), 1, code, m, price, price, price + 0.5, price - 0.5, (i + 1) * step, 10 * (i + 1)) for i, m in enumerate(minutes)]

    table = [*rows("good"), *rows("free", price=0.0), *rows("twice", GRID + [600]), *rows("off", GRID[:-1] + [2000]), *rows("short", GRID[:-1]),
             *rows("back", step=-1), *rows("still", step=0), *rows("unknown"), *rows("high")]
    minutes = spark.createDataFrame(table, "trade_date date, market bigint, code string, minute int, open_price double, close_price double, "
                                           "high_price double, low_price double, cumulative_volume bigint, cumulative_turnover bigint")
    daily = minutes.filter("code <> 'unknown'").groupBy("trade_date", "market", "code").agg(
        F.first("open_price").alias("open_price"), (F.max("high_price") + F.when(F.col("code") == "high", 1).otherwise(0)).alias("high_price"),
        F.min("low_price").alias("low_price"), F.first("close_price").alias("close_price"), F.max("cumulative_volume").alias("volume"),
        F.first("open_price").alias("previous_close"), F.lit(0.5).alias("turnover_rate"))
    good, rejected = br.archive_bars(minutes, daily)
    bad = br.minute_errors(minutes)
    bars = br.five_minute_bars(minutes.join(bad, br.SECURITY_DAY, "left_anti"), daily)
    verdict = br.reconcile_bars(bars, daily)
    want = {r["code"]: r["reason"] for r in [*bad.collect(), *verdict.filter("reason IS NOT NULL").collect()]} | {"unknown": "no_daily_row"}
    assert {r["code"]: r["reason"] for r in rejected.collect()} == want
    assert set(want) == {"free", "twice", "off", "short", "back", "unknown", "high"}
    columns = [c for c in good.columns if c != "source"]
    kept = bars.join(verdict.filter("reason IS NULL"), br.SECURITY_DAY, "left_semi").select(*columns)
    assert sorted(good.select(*columns).collect()) == sorted(kept.collect()) and good.count() == 2 * 48
