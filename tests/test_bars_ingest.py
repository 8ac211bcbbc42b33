import json

import pytest
from pyspark.sql import functions as F

from builders import day, points, curve, records, relations, rows
from tidemark.functions import scalars as sx
from tidemark.functions.grid import grid_array, session_grid
from tidemark.operators import bars as br
from tidemark.operators import enrich as en
from tidemark.sources import pages as pg
from tidemark.sources import quotes as qt
from tidemark.sources import ticks as tk

DATE = "2026-08-14"
MINUTES = [570, *range(571, 691), *range(781, 901)]


def lines(date=DATE, volume=lambda i: i, price=lambda m: (10, 10, 10, 10), turnover=lambda i: i * 250_000):
    """241 text rows; the cumulative volume of row i is ``volume(i)``."""
    out = []
    for i, m in enumerate(MINUTES):
        o, c, h, low = price(m)
        out.append(f"{date} {m // 60:02d}:{m % 60:02d},{o},{c},{h},{low},1,1,0,0,0,{volume(i)}.0,{turnover(i)}.9")
    return out


def parsed(spark, texts, code="600000"):
    df = spark.createDataFrame([(1, code, t) for t in texts], "market bigint, code string, line string")
    return pg.parse_minute_bars(df)


def official(spark, **changes):
    base = dict(trade_date=DATE, rank_type="stock", code="600000", market=1, open_price=10.0, high_price=10.0,
                low_price=10.0, close_price=10.0, previous_close=9.5, volume=1000, turnover_rate=0.1)
    base.update(changes)
    return records(spark, [base])


def test_plain_day(spark):
    good, bad = br.archive_bars(parsed(spark, lines()), official(spark))
    assert bad.count() == 0
    bars = good.orderBy("minute_index").collect()
    assert len(bars) == 48 and {b.volume for b in bars} == {5} and {b.turnover for b in bars} == {1_250_000}
    assert bars[0].turnover_rate == pytest.approx(0.0005)
    assert sum(b.volume for b in bars) == 240 and sum(b.turnover for b in bars) == 60_000_000
    assert bars[0].change_value == pytest.approx(0.5) and bars[1].change_value == 0.0


def test_opening_price_without_volume(spark):
    def price(m):
        return (10, 10, 10, 10) if m == 570 else (11, 11, 12, 11)

    rows_in = parsed(spark, lines(price=price))
    good, _ = br.archive_bars(rows_in, official(spark, open_price=10.0, high_price=12.0, low_price=10.0, close_price=11.0))
    first = good.filter("minute_index = 0").first()
    assert (first.open_price, first.high_price, first.low_price) == (10.0, 12.0, 10.0)
    # Disagreeing with the official open it is a placeholder and must not count.
    good, _ = br.archive_bars(rows_in, official(spark, open_price=11.0, high_price=12.0, low_price=11.0, close_price=11.0))
    assert good.filter("minute_index = 0").first().low_price == 11.0


def test_close_without_auction_volume(spark):
    def flat_end(i):
        return min(i, 239)

    rows_in = parsed(spark, lines(volume=flat_end))
    near, _ = br.archive_bars(rows_in, official(spark, close_price=10.01))
    assert near.count() == 48
    far, bad = br.archive_bars(rows_in, official(spark, close_price=10.02))
    assert far.count() == 0 and rows(bad, "reason") == [("ohlc_mismatch",)]
    # With auction volume the close has to fit.
    _, bad = br.archive_bars(parsed(spark, lines()), official(spark, close_price=10.01))
    assert rows(bad, "reason") == [("ohlc_mismatch",)]


def test_untraded_bar_shows_its_first_minute(spark):
    def stalled(i):
        return i if i <= 5 else max(5, i - 5)

    def price(m):
        return (10, 10, 10, 10) if m not in range(576, 581) else (10 + m % 3 / 100, 10, 10, 10)

    good, _ = br.archive_bars(parsed(spark, lines(volume=stalled, price=price)), official(spark))
    bar = good.filter("minute_index = 1").first()
    assert bar is not None and bar.volume == 0 and bar.open_price == pytest.approx(10 + 576 % 3 / 100)


def test_bad_days_do_not_stop_others(spark):
    texts = lines()
    falling = parsed(spark, lines(volume=lambda i: 100 - i), "B")
    doubled = parsed(spark, texts + texts[3:4], "C")
    short = parsed(spark, texts[:-1], "D")
    odd = parsed(spark, texts[:-1] + [texts[-1].replace("15:00", "15:01")], "E")
    daily = official(spark).unionByName(official(spark, code="B")).unionByName(official(spark, code="C")).unionByName(
        official(spark, code="D")).unionByName(official(spark, code="E"))
    minutes = parsed(spark, texts).unionByName(falling).unionByName(doubled).unionByName(short).unionByName(odd)
    good, bad = br.archive_bars(minutes, daily)
    assert rows(good.select("code").distinct(), "code") == [("600000",)]
    assert dict(rows(bad, "code", "reason")) == {"B": "volume_decreased", "C": "duplicate_minute", "D": "minute_count",
                                                 "E": "unexpected_minute"}


def test_lines_with_too_few_fields_are_flagged(spark):
    df = parsed(spark, ["2026-08-14 09:31,1,2,3,4,5,6,7,8,9,12.9,x", "2026-08-14 09:31,1", "noon,1,2,3,4,5,6,7,8,9,1,2"])
    assert rows(df, "valid", "cumulative_volume", "cumulative_turnover")[0] == (True, 12, 0)
    assert [r.valid for r in df.collect()] == [True, False, False]


# -- ticks -------------------------------------------------------------------

def ticks(spark, code="A", skip=(), twist=None, date=DATE, extra=()):
    out = []
    for i, m in enumerate([*range(575, 691, 5), *range(785, 901, 5)]):
        if i not in skip:
            dark, regular = 10 * i, 5
            main = dark + regular + (1 if twist == i else 0)
            out.append((day(DATE), "stock", 1, code, int(day(date).strftime("%y%m%d") + f"{m // 60:02d}{m % 60:02d}"),
                        dark, regular, main))
    out += [(day(DATE), "stock", 1, code, t, 1, 1, 2) for t in extra]
    return spark.createDataFrame(out, "trade_date date, rank_type string, market bigint, code string, time bigint, "
                                      "dark_money bigint, regular_money bigint, main_money_inflow bigint")


def test_curves_are_checked_one_by_one(spark):
    df = (ticks(spark, "ok", extra=[2608140931, 2608141501]).unionByName(ticks(spark, "short", skip=[5]))
          .unionByName(ticks(spark, "twisted", twist=7)).unionByName(ticks(spark, "old", date="2026-08-13"))
          .unionByName(ticks(spark, "twice", extra=[2608140935])))
    good, bad = tk.parse_money_ticks(df)
    assert good.groupBy("code").count().collect() == [("ok", 48)]
    assert dict(rows(bad, "code", "reason")) == {"short": "point_count", "twisted": "inconsistent_money",
                                                 "old": "wrong_date", "twice": "duplicate_point"}
    good, _ = tk.parse_money_ticks(ticks(spark), include_close=False)
    assert good.count() == 47


# -- pages -------------------------------------------------------------------

def page(entries, total, date="20260814"):
    return json.dumps({"errid": 0, "1": date, "2": total, "data": entries})


def pages(spark, bodies, rank_type="concept"):
    return spark.createDataFrame([(day(DATE), rank_type, n, b) for n, b in enumerate(bodies, start=1)],
                                 "trade_date date, rank_type string, page bigint, body string")


def entry(code, **fields):
    return {"4": code, "3": 90, "16": code, "5": 93000, "6": 300, "7": "20", "8": 320.9, "11": None, "14": "bad",
            "9": 3, **fields}


def test_rank_counts_over_pages(spark):
    got = pg.parse_rank_pages(pages(spark, [page([entry("B"), entry("A")], 3), page([entry("C")], 3)]))
    assert rows(got.orderBy("rank"), "code", "rank") == [("B", 1), ("A", 2), ("C", 3)]
    first = got.orderBy("rank").first()
    assert (first.dark_money, first.regular_money, first.main_money_inflow, first.up_count) == (300, 20, 320, 3)
    assert (first.dark_activity, first.change_pct, first.quote_time) == (0.0, 0.0, "093000")
    assert pg.check_snapshot_complete(got).count() == 0
    assert pg.parse_rank_pages(pages(spark, [page([entry("A")], 1)], "stock")).first().up_count == 0


@pytest.mark.parametrize("bodies,reason", [
    ([page([entry("A")], 2)], "incomplete"), ([page([entry("A")], 2), page([entry("A")], 2)], "duplicate_code"),
    ([page([entry("")], 1)], "missing_code"), ([page([entry("A")], 1, "")], "no_data")])
def test_unusable_snapshots(spark, bodies, reason):
    assert rows(pg.check_snapshot_complete(pg.parse_rank_pages(pages(spark, bodies))), "reason") == [(reason,)]


def quote_body(diff, total):
    return json.dumps({"rc": 0, "data": {"total": total, "diff": diff}})


def quote(code, **fields):
    return {"f12": code, "f13": 90, "f14": code, "f2": 10.5, "f3": 150, "f5": 7, "f17": 10, "f124": 1786694400, **fields}


def quote_pages(spark, bodies, **keys):
    names = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame([(*keys.values(), n, b) for n, b in enumerate(bodies, start=1)],
                                 (names + ", " if names else "") + "page bigint, body string")


def test_board_quotes(spark):
    good, bad = qt.parse_board_quotes(quote_pages(spark, [
        quote_body([quote("A"), quote("B", f2="-")], 3), quote_body({"10": quote("D", f2=0), }, 3)], rank_type="concept"))
    got = {r.code: r for r in good.collect()}
    assert bad.count() == 0 and set(got) == {"A", "B", "D"}
    assert (got["A"].latest_price, got["A"].change_pct, got["A"].volume, got["A"].available) == (10.5, 1.5, 7, True)
    assert got["A"].quote_time == "2026-08-14T08:00:00Z"
    assert not got["B"].available and not got["D"].available
    for bodies, reason in (([quote_body([quote("A"), quote("A")], 2)], "duplicate_code"), ([quote_body([], 0)], "no_data"),
                           ([quote_body([quote("A")], 5)], "incomplete"), ([quote_body([quote("A")], 0)], "invalid_total"),
                           ([quote_body([quote("")], 1)], "empty_code")):
        good, bad = qt.parse_board_quotes(quote_pages(spark, bodies, rank_type="concept"))
        assert good.count() == 0 and rows(bad, "reason") == [(reason,)]


def test_object_rows_come_in_numeric_order(spark):
    diff = {"10": quote("C"), "9": quote("B"), "0": quote("A")}
    entries = qt.quote_entries(quote_pages(spark, [quote_body(diff, 3)], rank_type="concept"), ["rank_type"])
    assert [r.q["f12"] for r in entries.orderBy("pos").collect()] == ["A", "B", "C"]


def test_stock_quotes_cover_every_request(spark):
    asked = relations(spark, [dict(stock_code="A", board_code="x", stock_market=1, stock_name="asked"),
                              dict(stock_code="Z", board_code="x", stock_market=1, stock_name="absent")])
    made = qt.parse_stock_quotes(asked, quote_pages(spark, [quote_body([quote("A", f13=0, f14="")], 1)]))
    got = {r.code: r for r in made.collect()}
    assert (got["A"].market, got["A"].name, got["A"].available) == (1, "asked", True)
    assert (got["Z"].market, got["Z"].name, got["Z"].available, got["Z"].latest_price) == (1, "absent", False, 0.0)


def test_catalog_and_constituents(spark):
    boards, bad = qt.parse_board_catalog(quote_pages(spark, [quote_body([quote("BK2"), quote("BK1")], 2)], board_type="concept"))
    assert bad.count() == 0 and rows(boards.orderBy("source_rank"), "board_code") == [("BK1",), ("BK2",)]
    listed = quote_pages(spark, [quote_body([quote("S1"), quote("S2"), quote("S1", f14="again")], 3)], board_code="BK1").unionByName(
        quote_pages(spark, [quote_body([quote("S1")], 2)], board_code="BK2"))
    rel, bad = qt.parse_board_constituents(listed, boards, "feed", "list", F.current_timestamp())
    assert sorted(rows(rel, "board_code", "stock_code", "stock_name", "source_order")) == [
        ("BK1", "S1", "S1", 1), ("BK1", "S2", "S2", 1)]
    assert rows(bad, "board_code", "reason") == [("BK2", "incomplete")]


def test_rejected_boards_take_one_hashed_pass(spark):
    listed = quote_pages(spark, [quote_body([quote("S1"), quote("S1"), quote("S2")], 3)], board_code="BK1")
    for code, body in (("BK2", quote_body([quote("S1")], 2)), ("BK3", quote_body([], 0)), ("BK4", quote_body([quote("")], 1)),
                       ("BK5", quote_body([quote("S1"), quote("S1"), quote("S3")], 2))):
        listed = listed.unionByName(quote_pages(spark, [body], board_code=code))
    boards = spark.createDataFrame([("BK1", "n", "concept", 1), ("BK1", "n", "industry", 1)], "board_code string, board_name string, board_type string, source_rank int")
    bad = qt.constituent_errors(listed.persist(), boards)
    text = bad._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("Generate posexplode") == 1
    want = [("BK2", "incomplete", 2, 1), ("BK3", "no_data", 0, 0), ("BK4", "empty_code", 1, 1), ("BK5", "unknown_board", 0, 2)]
    assert sorted(rows(bad, "board_code", "reason", "expected", "found")) == want
    _, same = qt.parse_board_constituents(listed, boards, "feed", "list", F.current_timestamp())
    assert sorted(rows(same, "board_code", "reason", "expected", "found")) == want


def test_calendar_file(spark):
    from tidemark import schemas

    files = spark.createDataFrame([(["2026-10-01", "2026-10-10", "bad"], ["2026-10-10", "2026-09-27"], None, None, None)],
                                  schemas.CALENDAR_FILE)
    good, bad = qt.read_calendar(files)
    assert sorted(rows(bad, "value", "reason")) == [("2026-10-10", "holiday_and_workday"), ("bad", "invalid_date")]
    assert good.count() == 4


# -- joins -------------------------------------------------------------------

def quotes_table(spark, *values):
    return spark.createDataFrame(
        [(code, price, 10.0, 11.0, 9.0, 9.5, 0.5, 100, 1000, 0.1, 0.2, 0.03, when, ok) for code, price, when, ok in values],
        "code string, latest_price double, open_price double, high_price double, low_price double, previous_close double, "
        "change_value double, volume bigint, turnover bigint, turnover_rate double, amplitude double, change_pct double, "
        "quote_time string, available boolean")


def test_stock_enrichment(spark):
    daily = records(spark, [dict(trade_date=DATE, rank_type="stock", code=c, change_pct=0.9, close_price=1.0) for c in "ABC"])
    made = {r.code: r for r in en.enrich_stock_quotes(
        daily, quotes_table(spark, ("A", 10.5, f"{DATE} 15:00:00", True), ("B", 0.0, "", False))).collect()}
    assert (made["A"].close_price, made["A"].change_pct, made["A"].quote_available) == (10.5, 0.03, True)
    assert (made["B"].open_price, made["B"].change_pct, made["B"].quote_available) == (10.0, 0.9, False)
    assert (made["C"].open_price, made["C"].close_price, made["C"].quote_available) == (0.0, 0.0, False)


def test_misdated_and_board_errors(spark):
    q = quotes_table(spark, ("A", 10.5, f"{DATE}T07:00:00Z", True), ("B", 10.5, "2026-08-13 15:00:00", True), ("C", 0.0, "", False),
                     ("D", 1.0, f"{DATE}T17:00:00Z", True))
    assert sorted(rows(en.misdated_quotes(q, DATE), "code")) == [("B",), ("D",)]
    boards = records(spark, [dict(trade_date=DATE, rank_type="concept", code=c) for c in "ABCE"])
    good, errors = en.enrich_board_quotes(boards, q)
    assert rows(good, "code", "close_price") == [("A", 10.5)]
    assert sorted(rows(errors, "code", "reason")) == [("B", "wrong_date"), ("C", "missing_quote"), ("E", "missing_quote")]


def test_close_money_overrides(spark):
    daily = records(spark, [dict(trade_date=DATE, rank_type="concept", code=c, dark_money=1, money_available=False) for c in "AB"])
    made = {r.code: r for r in en.merge_close_money(daily, points(spark, curve(DATE, "concept", "A", range(48)))).collect()}
    assert (made["A"].dark_money, made["A"].money_available) == (47, True)
    assert (made["B"].dark_money, made["B"].money_available) == (1, False)


def test_research_rows_keep_both_sides(spark):
    money = points(spark, curve(DATE, "stock", "A", [7, 8])).withColumn("rank", F.lit(3))
    bars = spark.createDataFrame([(day(DATE), i, 0, "A", 10.00005, 11.0, 9.0, -10.00005, 0.5, 0.0000015, 0.1, 0.2, 5, 6) for i in (1, 2)],
                                 "trade_date date, minute_index int, market bigint, code string, open_price double, high_price double, "
                                 "low_price double, close_price double, change_value double, amplitude double, change_pct double, "
                                 "turnover_rate double, volume bigint, turnover bigint")
    got = en.merge_money_and_bars(money, bars).orderBy("minute_index").collect()
    assert [(r.money_available, r.kline_available, r.dark_money, r.volume) for r in got] == [
        (True, False, 7, 0), (True, True, 8, 5), (False, True, 0, 5)]
    assert (got[1].open_price_e4, got[1].close_price_e4, got[1].amplitude_ppm) == (100001, -100001, 2)


def test_grids(spark):
    assert session_grid(spark).count() == 240 and session_grid(spark, 5).count() == 48
    first = rows(session_grid(spark, 5), "clock")
    assert first[0] == ("09:35",) and first[23] == ("11:30",) and first[24] == ("13:05",) and first[-1] == ("15:00",)
    assert spark.range(1).select(F.size(grid_array(1, 895))).first()[0] == 235


def test_text_decoding_and_search(spark):
    df = spark.createDataFrame([(bytearray("平安银行".encode("gbk")),), (bytearray("平安银行".encode()),)], "body binary")
    assert {r[0] for r in df.select(sx.decode_text(F.col("body"))).collect()} == {"平安银行"}
    names = spark.createDataFrame([("50%_off",), ("ÀB",), ("ab",)], "name string")
    def found(needle):
        return names.filter(sx.contains_text(needle, F.col("name"))).count()
    assert (found("%"), found("_"), found("àb"), found("AB"), found("b")) == (1, 1, 0, 1, 2)
