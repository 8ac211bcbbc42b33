"""Bars in runs, and minutes folded and purged by folder."""

import os

import pytest
from pyspark.sql import functions as F

from builders import at, day
from test_archive_views import DATE, NEXT, board_day, minute_rows, stock_day
from tidemark.sources import bar_jobs as bj
from tidemark.sources import compaction as cp
from tidemark.sources import minutes as mn
from tidemark.sources import tables as tb
from tidemark.sources.seals import Seals

GRID = [570, *range(571, 691), *range(781, 901)]


def minute_table(spark, codes, date=DATE, price=10.0):
    rows = [(day(date), 1, c, m, price, price, price, price, i + 1, 10 * (i + 1)) for c in codes for i, m in enumerate(GRID)]
    return spark.createDataFrame(rows, "trade_date date, market bigint, code string, minute int, open_price double, close_price double, "
                                       "high_price double, low_price double, cumulative_volume bigint, cumulative_turnover bigint")


def official(spark, codes, date=DATE, high=10.0):
    rows = [(day(date), 1, c, 10.0, high, 10.0, 10.0, 241, 10.0, 0.5) for c in codes]
    return spark.createDataFrame(rows, "trade_date date, market bigint, code string, open_price double, high_price double, low_price double, "
                                       "close_price double, volume bigint, previous_close double, turnover_rate double")


@pytest.fixture
def archive(spark, root):
    tb.save_board_archive(board_day(spark, "industry", ["BK1"]), root)
    tb.save_board_archive(board_day(spark, "concept", ["BK2"]), root)
    tb.save_stock_archive(stock_day(spark, ["600001", "600002"]), root)
    return root


def ledger(run):
    return sorted((r["code"], r["status"]) for r in run.ledger.collect())


def test_a_second_run_takes_what_the_first_left(spark, archive):
    dates = spark.createDataFrame([(day(DATE),)], "trade_date date")
    asked = []

    def source(codes, high=10.0):
        def fetch(todo):
            asked.append(sorted(r["code"] for r in todo.collect()))
            return minute_table(spark, codes), official(spark, ["600001", "600002"], high=high)
        return fetch

    def build():
        return bj.archive_analytics(spark, archive)

    one = bj.collect_bars(spark, archive, dates, source(["600001"]), "r1", build=build)
    assert ledger(one) == [("600001", "stored"), ("600002", "no_answer")] and one.sealed == []
    two = bj.collect_bars(spark, archive, dates, source(["600001", "600002"], high=12.0), "r2", build=build)
    assert ledger(two) == [("600002", "ohlc_mismatch")] and two.sealed == []
    three = bj.collect_bars(spark, archive, dates, source(["600001", "600002"]), "r3", build=build)
    assert ledger(three) == [("600002", "stored")] and [r["revision_id"] for r in three.sealed] == ["kline-r3-20260814"]
    again = bj.collect_bars(spark, archive, dates, source([]), "r4", build=build)
    assert ledger(again) == [] and again.sealed == []
    assert asked == [["600001", "600002"], ["600002"], ["600002"], []]
    assert bj.read_ledger(spark, archive).count() == 4
    assert Seals(spark, f"{archive}/sealed").of_revision("features", "kline-r3-20260814").count() == 4


def test_an_archive_saved_again_replaces_even_with_nothing(spark, archive):
    tb.save_board_archive(board_day(spark, "concept", ["BK2"], money=[]), archive)
    curves = spark.read.parquet(f"{archive}/board_money_5m")
    assert {r["rank_type"] for r in curves.collect()} == {"industry"}
    row = spark.read.parquet(f"{archive}/coverage").filter("rank_type = 'concept'").first()
    assert (row["collected_research"], row["collected_minutes"], row["collected_daily_close"]) == (0, 0, 1)
    bare = stock_day(spark, ["600001"])
    tb.save_stock_archive(type(bare)(bare.closes, bare.points.limit(0), bare.errors), archive)
    assert spark.read.parquet(f"{archive}/daily_close").filter("rank_type = 'stock'").count() == 1
    assert not os.path.exists(f"{archive}/stock_research_5m/trade_date={DATE}")


def test_compact_then_purge(spark, root):
    full = [(m, k, "A", m) for k in ("industry", "concept") for m in GRID[1:]]
    mn.append_minute_board(minute_rows(spark, full), f"{root}/minute_board", "1")
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "A", 1)], NEXT), f"{root}/minute_board", "2")
    dates = spark.createDataFrame([(day(DATE),), (day(NEXT),)], "trade_date date")
    with pytest.MonkeyPatch.context() as broken:
        broken.setattr(cp, "drop_dates", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cp.compact_dates(spark, root, dates)
    seen = cp.compact_dates(spark, root, dates)  # again, after dying before the purge: nothing doubles
    assert spark.read.parquet(f"{root}/board_money_5m").filter(F.col("trade_date") == day(DATE)).count() == 96
    assert spark.read.parquet(f"{root}/daily_close").count() == 2
    assert seen.count() == 4
    assert {r["trade_date"] for r in mn.read_minute_board(spark, f"{root}/minute_board").collect()} == {day(NEXT)}
    assert cp.purge_before(spark, root, "2026-09-01") == []  # no stock side yet
    pages = minute_rows(spark, [(571, "industry", "A", 1)]).select("trade_date", "snapshot_at", "rank_type", F.lit(1).alias("page"))
    for kind in ("research_5m", "daily_close"):
        cp.save_raw_pages(pages.withColumn("snapshot_kind", F.lit(kind)), f"{root}/raw_pages", "1")
    quality = spark.createDataFrame([(day(DATE), 1, 48, 1, 48, 48, 1, 1)], "trade_date date, expected_stocks bigint, expected_points int, "
                                    "expected_kline_stocks bigint, money_rows bigint, kline_rows bigint, daily_close_rows bigint, daily_kline_rows bigint")
    tb.replace_partitions(quality, f"{root}/stock_quality", ["trade_date"])
    assert cp.purge_before(spark, root, DATE) == []  # the cut is not included
    assert cp.purge_before(spark, root, NEXT) == [DATE]
    left = spark.read.parquet(f"{root}/raw_pages").collect()
    assert [r["snapshot_kind"] for r in left] == ["daily_close"]
    assert at(DATE, 15, 0) is not None
