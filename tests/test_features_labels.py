import pytest
from pyspark.sql import functions as F

from builders import curve, day, points, records, rows
from tidemark.operators import features as ft
from tidemark.operators import labels as lb

DATES = ["2026-08-10", "2026-08-11", "2026-08-12", "2026-08-13", "2026-08-14", "2026-08-17"]


def six_days(spark, last_stock_close=None):
    out = []
    for i, date in enumerate(DATES):
        stock_close = 10.0 + i if last_stock_close is None or i < 5 else last_stock_close
        out += [
            dict(trade_date=date, rank_type="industry", code="BK-IND", market=90, close_price=100.0 + i,
                 turnover=1_000_000 + 100_000 * i, dark_money=100 + i, main_money_inflow=200 + 10 * i, change_pct=0.01),
            dict(trade_date=date, rank_type="concept", code="BK-CON", market=90, close_price=200.0 + i,
                 turnover=2_000_000 + 100_000 * i, dark_money=200 + i, main_money_inflow=300 + 10 * i),
            dict(trade_date=date, rank_type="stock", code="000001", close_price=stock_close,
                 turnover=500_000 + 100_000 * i, dark_money=50 + 10 * i, main_money_inflow=75 + 15 * i)]
    return records(spark, out)


def rising_curves(spark):
    return points(spark, [r for date in DATES for kind, code, market in
                          (("industry", "BK-IND", 90), ("concept", "BK-CON", 90), ("stock", "000001", 0))
                          for r in curve(date, kind, code, list(range(1, 49)), market)])


def industries(spark):
    return spark.createDataFrame([(day(d), "000001", "BK-IND") for d in DATES],
                                 "trade_date date, stock_code string, industry_code string")


def test_features_of_rising_days(spark):
    made = ft.daily_features(six_days(spark), rising_curves(spark), industries(spark)).cache()
    assert made.columns == ft.FEATURE_COLUMNS and len(made.columns) == 33
    row = made.filter("code = '000001' AND trade_date = '2026-08-14'").first()
    assert row.self_turnover_percentile_5 == row.self_dark_money_percentile_5 == 0.9
    assert row.self_turnover_percentile_10 is None
    assert (row.consecutive_inflow_days, row.money_acceleration, row.rank_change_1) == (5, 0, 0)
    assert row.curve_available and row.primary_industry_code == "BK-IND"
    assert row.morning_dark_share == pytest.approx(24 / 48)
    assert row.late_dark_share == pytest.approx(6 / 48)
    assert (row.max_inflow_minute_index, row.max_dark_drawdown, row.intraday_reversal) == (0, 0, False)
    assert row.rank_percentile == 0.5


def test_shares_of_a_zero_based_curve(spark):
    shaped = ft.curve_shape(ft.day_curves(points(spark, curve("2026-08-14", "stock", "000001", list(range(48)))),
                                          ["trade_date", "code"])).first()
    assert shaped.morning_dark_share == pytest.approx(23 / 47)
    assert shaped.late_dark_share == pytest.approx(6 / 47)


def test_curve_details(spark):
    values = [5, 9, 4, -3, 0, 2] + [2] * 42
    full = points(spark, curve("2026-08-14", "stock", "A", values) + curve("2026-08-14", "stock", "B", values[:47]))
    shaped = {r.code: r for r in ft.curve_shape(ft.day_curves(full, ["trade_date", "code"])).collect()}
    a, b = shaped["A"], shaped["B"]
    assert (a.max_inflow_minute_index, a.max_outflow_minute_index) == (0, 3)
    assert (a.max_dark_drawdown, a.intraday_reversal, a.tail_acceleration) == (-12, True, 0)
    assert (b.curve_available, b.max_inflow_minute_index, b.max_dark_drawdown) == (False, -1, 0)


def test_gaps_break_streaks_and_changes(spark):
    data = [dict(trade_date=d, rank_type="stock", code="A", rank=r, main_money_inflow=m) for d, r, m in
            ((DATES[0], 5, 1), (DATES[1], 4, 2), (DATES[3], 3, 4), (DATES[4], 1, 8), (DATES[5], 2, -1))]
    data += [dict(trade_date=d, rank_type="stock", code="B") for d in DATES]
    made = ft.daily_features(records(spark, data), points(spark, [])).filter("code = 'A'").orderBy("trade_date")
    assert rows(made, "rank_change_1", "consecutive_inflow_days", "money_acceleration") == [
        (0, 1, 0), (1, 2, 0), (0, 1, 0), (2, 2, 0), (-1, 0, -1 - 2 * 8 + 4)]


def test_second_difference_needs_three_consecutive_dates(spark):
    data = [dict(trade_date=d, rank_type="stock", code="A", main_money_inflow=m)
            for d, m in zip(DATES, (1, 2, 5, 11, 7, 7))]
    made = ft.daily_features(records(spark, data), points(spark, [])).orderBy("trade_date")
    assert rows(made, "money_acceleration") == [(0,), (0,), (2,), (3,), (-10,), (4,)]


def test_unquoted_stocks_are_left_out(spark):
    data = [dict(trade_date=DATES[0], rank_type="stock", code="A", quote_available=False),
            dict(trade_date=DATES[0], rank_type="concept", code="B", quote_available=False)]
    assert rows(ft.daily_features(records(spark, data), points(spark, [])), "code") == [("B",)]


def test_slice_equals_whole(spark):
    daily, curves = six_days(spark), rising_curves(spark)
    whole = ft.daily_features(daily, curves).filter("trade_date >= '2026-08-13'").collect()
    part = ft.daily_features(daily, curves, first="2026-08-13").collect()
    assert sorted(whole) == sorted(part)


def test_labels(spark):
    made = lb.future_labels(six_days(spark), industries(spark)).filter("horizon = 5 AND code = '000001'")
    row = made.first()
    assert row.return_rate == pytest.approx(0.5)
    assert row.relative_industry_return == pytest.approx(0.45)
    assert row.max_favorable_return == pytest.approx(0.5)
    assert row.max_adverse_return == pytest.approx(0.1)


def test_labels_after_a_rerun(spark):
    made = lb.future_labels(six_days(spark, 20.0), industries(spark), changed="2026-08-17")
    row = made.filter("horizon = 5 AND code = '000001'").collect()
    assert len(row) == 1 and row[0].return_rate == pytest.approx(1.0)


def test_label_paths_skip_missing_and_zero_closes(spark):
    data = [dict(trade_date=d, rank_type="stock", code="A", close_price=c) for d, c in
            ((DATES[0], 10.0), (DATES[1], 0.0), (DATES[3], 12.0), (DATES[5], 9.0))]
    data += [dict(trade_date=d, rank_type="concept", code="B") for d in DATES]
    made = lb.future_labels(records(spark, data)).filter("code = 'A'")
    got = {(str(r.signal_date), r.horizon): (r.return_rate, r.max_favorable_return, r.max_adverse_return)
           for r in made.collect()}
    assert set(got) == {(DATES[0], 3), (DATES[0], 5)}
    assert got[(DATES[0], 5)] == pytest.approx((-0.1, 0.2, -0.1))


def test_current_labels_follow_the_pointer(spark):
    revisions = spark.createDataFrame([(day(d), f"r{i}") for i, d in enumerate(DATES)], "trade_date date, revision_id string")
    made = lb.future_labels(six_days(spark), revisions=revisions)
    moved = revisions.withColumn("revision_id", F.when(F.col("trade_date") == DATES[5], "new").otherwise(F.col("revision_id")))
    assert lb.current_labels(made, moved, signal_revision="r0", horizon=5).count() == 0
    assert lb.current_labels(made, moved, signal_revision="r0", target_revision="r5").count() == 3
    assert lb.current_labels(made, revisions, signal_revision="r0", horizon=5).count() == 3
