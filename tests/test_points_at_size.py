"""What points and minutes cost a task: nothing that has a row a point is sorted, broadcast or computed twice."""

from tidemark.operators.bars import archive_bars
from tidemark.operators.enrich import eligible_only, merge_money_and_bars
from tidemark.operators import features as ft
from tidemark.operators import membership as mb
from tidemark.operators import quality as qu
from tidemark.plans import feature_queries as fq
from tidemark.plans import sealed_queries as sq
from tidemark.plans import standin as st
from tidemark.schemas import KEY
from tidemark.session import stored
from tidemark.sources.tables import with_bars
from tidemark.sources.ticks import parse_money_ticks
from tidemark.streaming.boards import latest_board

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_spread_after_the_window(spark):
    text = plan(st.money_points(spark, SF))
    assert 0 <= text.index("explode(sequence") < text.index("Window [")


def test_minutes_are_spread_after_the_window(spark):
    text = plan(st.stock_minutes(spark, SF)[0])
    assert 0 <= text.index("explode(sequence") < text.index("Window [") and "Join" not in text


def test_latest_board_is_hashed(spark):
    made = latest_board(st.money_points(spark, SF)).select("rank_type", "code", "snapshot_at", "dark_money")
    assert "SortAggregate" not in plan(made)


def test_quoted_stocks_are_the_hashed_side(spark):
    assert "SortMergeJoin" not in plan(eligible_only(st.money_points(spark, SF), st.daily_close(spark, SF))[0])


def test_curves_are_judged_in_one_aggregate(spark):
    ticks = spark.sql("""SELECT DATE'2024-01-02' AS trade_date, 'concept' AS rank_type, 1L AS market, code, 1L AS dark_money, 2L AS regular_money,
        3L AS main_money_inflow, CAST(date_format(timestamp'2024-01-02' + make_dt_interval(0, 0, m), 'yyMMddHHmm') AS bigint) AS time
        FROM (SELECT explode(sequence(575, 690, 5)) AS m UNION ALL SELECT explode(sequence(785, 900, 5)))
        JOIN (VALUES ('A'), ('B'), ('C')) v(code) WHERE code <> 'C' OR m <> 600""")
    twice = ticks.unionByName(ticks.filter("code = 'B' AND time % 10000 = 1000"))
    good, bad = parse_money_ticks(twice)
    assert plan(bad).count("HashAggregate") == 2
    assert {(r["code"], r["reason"]) for r in bad.collect()} == {("B", "duplicate_point"), ("C", "point_count")}
    assert good.count() == 48


def test_bars_are_folded_once(spark):
    minutes, daily = st.stock_minutes(spark, SF)
    kept = []
    archive_bars(minutes, daily, keep=lambda df: kept.append(df) or df)
    assert len(kept) == 3


def test_points_of_bars_are_not_broadcast(spark):
    bars = st.stock_bars(spark, SF)
    money = st.money_points(spark, SF).filter("rank_type = 'stock'").selectExpr("*", "0 AS rank")
    assert "BroadcastHashJoin" not in plan(with_bars(merge_money_and_bars(money, bars), bars))


def test_points_of_a_digest_stay_where_they_are(spark):
    """No exchange between a curve's window and its semi-join: what has a row a point is not dealt again."""
    text = plan(sq._five_tables(spark, SF)["stock_research_5m"])
    assert "Exchange" not in text[:text.index("Window [")]


def test_leaves_of_unchanged_tables_are_taken_over(spark):
    rows = spark.sql("SELECT DATE'2024-01-02' AS trade_date, 'c' AS code, id AS v FROM range(100)")
    left = qu.content_leaves({"one": rows, "two": rows})
    changed = rows.filter("v <> 7")
    taken, anew = qu.replaced_leaves(left, {"two": changed}), qu.content_leaves({"one": rows, "two": changed})
    assert qu.content_differences(taken, anew).count() == 0
    assert {r["table"] for r in qu.content_differences(left, taken).collect()} == {"two"}


def test_curve_arrays_are_not_joined(spark):
    text = plan(fq.price_money_divergence(spark, SF))
    assert "curve#" not in text[:text.index("Join")]


def test_events_of_a_stock_are_dealt_once(spark):
    """Primary industries: one exchange, by stock, and no join of a stock's days with its spans."""
    text = plan(mb.primary_industry_spans(*st.membership_tables(spark, SF)))
    dealt = text[text.index("Window ["):]
    assert "Join" not in dealt[:dealt.index("Union")] and dealt[:dealt.index("Union")].count("Exchange") == 1


def test_scans_without_doubles_are_dealt_once(spark):
    scans, index = stored(st.membership_scans(spark, SF)).select("stock_code", "board_code", "trade_date"), st.sealed_dates(spark, SF)
    once, again = (mb.scans_to_events(scans, ["stock_code", "board_code"], "trade_date", index, unique=u) for u in (True, False))
    assert plan(again).count("Exchange hashpartitioning") == plan(once).count("Exchange hashpartitioning") + 1
    assert sorted(once.collect()) == sorted(again.collect()) != []


def test_points_of_a_seal_are_not_stored(spark, monkeypatch):
    class NoSeals:
        def __init__(self, *_):
            self.tables = []

        def seal(self, dates, manifest, tables, build):
            self.tables.append(tables)

    kept = []
    monkeypatch.setattr(sq, "Seals", NoSeals)
    monkeypatch.setattr(sq, "stored", lambda df: kept.append(df) or df)
    store = sq._resealed(spark, SF)
    assert len(store.tables) == 2 and kept and not any("minute_index" in df.columns for df in kept)
    curves = ft.day_curves(st.money_points(spark, SF), ["trade_date", *KEY])
    assert "Exchange" not in (text := plan(curves))[:text.index("Window [")]  # folded where the window left them
