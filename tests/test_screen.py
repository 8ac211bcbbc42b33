import dataclasses

import pytest

from builders import day, records, relations, rows
from tidemark.operators import screen as sc
from tidemark.operators.calendar import archived_days, complete_dates

DATES = ["2026-08-12", "2026-08-13", "2026-08-14"]
AS_OF = DATES[-1]


def strong(kind, code, date, **changes):
    base = dict(trade_date=date, rank_type=kind, code=code, name=code, market=1 if code.startswith("6") else 0,
                turnover=60_000_000_000, turnover_rate=0.04, change_pct=0.02, regular_money=900_000_000,
                dark_money=600_000_000)
    base.update(changes)
    return base


def members(spark, pairs, names=None):
    return relations(spark, [dict(stock_code=s, board_code=b, stock_market=1 if s.startswith("6") else 0,
                                  stock_name=(names or {}).get(s, s)) for s, b in pairs])


def market(spark, overrides=None, drop=()):
    """Two concepts and five stocks over three days; overrides keyed by (code, date)."""
    overrides = overrides or {}
    data = []
    for date in DATES:
        for kind, code in (("concept", "BK01"), ("concept", "BK02"), ("stock", "600001"), ("stock", "000002"),
                           ("stock", "300003"), ("stock", "600004"), ("stock", "600005")):
            if (code, date) not in drop:
                data.append(strong(kind, code, date, **overrides.get((code, date), {})))
    return records(spark, data)


def test_default_template(spark):
    # A turnover of exactly 50 billion is not above it.
    daily = market(spark, {("BK02", DATES[0]): {"turnover": 50_000_000_000},
                           ("000002", DATES[1]): {"change_pct": 0.07}}, drop={("600005", DATES[2])})
    held = members(spark, [("600001", "BK01"), ("000002", "BK01"), ("300003", "BK01"), ("600004", "BK01"),
                           ("600005", "BK01"), ("600009", "BK02")], {"600004": "*st gone"})
    out = sc.focus_scan(daily, held, sc.default_request(AS_OF))
    assert rows(out.dates, "trade_date") == [(day(d),) for d in DATES]
    assert rows(out.concepts, "code") == [("BK01",)]
    stock = out.stocks.collect()
    assert [s.code for s in stock] == ["600001"]
    assert [c.code for c in stock[0].concepts] == ["BK01"] and len(stock[0].days) == len(stock[0].evaluations) == 3
    assert stock[0].days[0].control_coefficient == pytest.approx(2.5)
    got = {(r.kind, r.code): (r.reason, r.failed_date and str(r.failed_date)) for r in out.rejections.collect()}
    assert got == {("concept", "BK02"): ("condition_failed", DATES[0]), ("stock", "000002"): ("condition_failed", DATES[1]),
                   ("stock", "300003"): ("non_main_board", None), ("stock", "600004"): ("st_excluded", None),
                   ("stock", "600005"): ("missing_daily_close", DATES[2])}
    failed = out.rejections.filter("code = 'BK02'").first().evaluation
    assert [c.passed for c in failed.conditions] == [False, True, True, True]
    assert failed.conditions[0].actual_value == 50e9
    s = out.stats.first()
    assert (s.concepts_evaluated, s.concepts_qualified, s.stocks_evaluated, s.stocks_qualified) == (2, 1, 5, 1)
    assert (s.non_main_board_excluded, s.st_excluded, s.missing_record_excluded) == (1, 1, 1)


def test_any_match_and_free_universe(spark):
    request = sc.ScanRequest(AS_OF, 1, (), (sc.Condition("turnover", "lt", 1.0), sc.Condition("change_pct", "gte", 0.02)),
                             stock_match="any")
    daily = market(spark, {("600001", AS_OF): {"change_pct": 0.0, "turnover": 0}, ("000002", AS_OF): {"change_pct": 0.0}})
    out = sc.focus_scan(daily, members(spark, []), request)
    assert {r.code for r in out.stocks.collect()} == {"600001", "300003", "600004", "600005"}
    # With turnover 0 the coefficient is 0, so that stock comes last.
    assert out.stocks.collect()[-1].code == "600001"


def test_any_condition_failing_on_one_day_rejects(spark):
    request = sc.ScanRequest(AS_OF, 3, (sc.Condition("change_pct", "between", 0.0, 0.05),), ())
    out = sc.focus_scan(market(spark, {("BK01", DATES[1]): {"change_pct": 0.06}}), members(spark, []), request)
    assert rows(out.concepts, "code") == [("BK02",)]
    row = out.rejections.filter("kind = 'concept'").first()
    assert (row.code, str(row.failed_date)) == ("BK01", DATES[1])


def test_unavailable_fields_fail_every_operator(spark):
    money = sc.Condition("dark_money", "lt", 1.0)
    rank = sc.Condition("rank", "lte", 5.0)
    daily = records(spark, [strong("stock", "A", AS_OF, money_available=False, dark_money=0),
                            strong("stock", "B", AS_OF, rank=0), strong("stock", "C", AS_OF, dark_money=0, rank=5)])
    judged = sc.with_metrics(daily).select("code", sc.condition_passes(money).alias("m"), sc.condition_passes(rank).alias("r"))
    assert sorted(rows(judged, "code", "m", "r")) == [("A", False, True), ("B", False, False), ("C", True, True)]


def test_too_few_dates_gives_nothing(spark):
    request = dataclasses.replace(sc.default_request(AS_OF), consecutive_days=5)
    out = sc.focus_scan(market(spark), members(spark, [("600001", "BK01")]), request)
    assert out.dates.count() == out.concepts.count() == out.stocks.count() == out.rejections.count() == 0


def test_rejections_by_page(spark):
    data = [strong("concept", "BK01", AS_OF)] + [strong("stock", f"3{i:05d}", AS_OF) for i in range(230)]
    request = sc.ScanRequest(AS_OF, 1, scope=sc.Scope(main_board_only=True))
    out = sc.focus_scan(records(spark, data), members(spark, []), request)
    assert out.rejections.count() == 230
    pages = [[r.code for r in sc.rejection_page(out.rejections, n, 100).collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [100, 100, 30, 0] and sum(pages, []) == sorted(sum(pages, []))


@pytest.mark.parametrize("change", [
    {"as_of": ""}, {"consecutive_days": 0}, {"concept_match": "some"}, {"stock_match": ""},
    {"stock_conditions": (sc.Condition("price", "gt", 1.0),)}, {"stock_conditions": (sc.Condition("rank", "ne", 1.0),)},
    {"stock_conditions": (sc.Condition("rank", "gt", float("nan")),)},
    {"concept_conditions": (sc.Condition("rank", "between", 2.0, 1.0),)},
    {"concept_conditions": (sc.Condition("rank", "between", 2.0),)}])
def test_invalid_requests(change):
    with pytest.raises(sc.InvalidScan):
        sc.validate(dataclasses.replace(sc.default_request(AS_OF), **change))


def test_complete_dates_need_all_concepts_quoted(spark):
    data = []
    for date in ("2026-08-10", *DATES):
        data += [dict(trade_date=date, rank_type="concept", code="BK01", quote_available=date != AS_OF),
                 dict(trade_date=date, rank_type="concept", code="BK02"), dict(trade_date=date, rank_type="stock", code="A")]
    daily = records(spark, data)
    assert [str(d) for (d,) in rows(complete_dates(daily), "trade_date")] == ["2026-08-10", *DATES[:2]]
    assert [str(d) for (d,) in rows(complete_dates(daily, AS_OF, 2), "trade_date")] == DATES[:2]
    assert [str(d) for (d,) in rows(archived_days(daily, DATES[0], AS_OF), "trade_date")] == DATES[:2]
    with pytest.raises(ValueError):
        archived_days(daily, AS_OF, "2020-01-01")
