import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from builders import at, curve, day, point_time, points, records, relations, rows
from tidemark import schemas
from tidemark.operators import archive as ar
from tidemark.operators import calendar as cal
from tidemark.operators import quality as qu
from tidemark.operators import runs as rn
from tidemark.operators import views as vw
from tidemark.sources import exports as ex
from tidemark.sources import minutes as mn
from tidemark.sources import tables as tb

DATE, NEXT = "2026-08-14", "2026-08-17"
RISING = list(range(1, 49))


def board_day(spark, kind, codes, date=DATE, money=None):
    closes = records(spark, [dict(trade_date=date, rank_type=kind, code=c, market=90, rank=i + 1, name=c)
                             for i, c in enumerate(codes)])
    curves = points(spark, [r for c in (money if money is not None else codes) for r in curve(date, kind, c, RISING, 90)])
    return ar.ArchiveDay(closes, curves.withColumn("rank", F.lit(1).cast("bigint")), errors(spark))


def errors(spark, *found):
    return spark.createDataFrame(list(found), "rank_type string, code string, reason string")


def stock_day(spark, codes, unquoted=(), date=DATE):
    closes = records(spark, [dict(trade_date=date, rank_type="stock", code=c, market=1, rank=i + 1, name=c,
                                  quote_available=c not in unquoted) for i, c in enumerate(codes)])
    curves = points(spark, [r for c in codes for r in curve(date, "stock", c, RISING, 1)])
    return ar.ArchiveDay(closes, curves.withColumn("rank", F.lit(1).cast("bigint")), errors(spark))


def bar_rows(spark, code, count=48, source="trend_1m", date=DATE):
    data = [(day(date), i, 1, code, source, 10.0, 11.0, 9.0, 10.5, 5, 50, 0.1, 0.2, 0.5, 0.01, at(date, 16, 0)) for i in range(count)]
    return spark.createDataFrame(data, schemas.BAR_POINT)


def manifest_of(spark, root, date=DATE):
    return spark.read.parquet(f"{root}/manifest").filter(F.col("trade_date") == F.lit(date).cast("date")).first()


def test_archive_of_a_day_step_by_step(spark, root):
    tb.save_board_archive(board_day(spark, "industry", ["BK1"]), root)
    m = manifest_of(spark, root)
    assert m.status == "incomplete"
    assert m.validation_errors == ["concept daily close is missing", "stock archive quality is missing"]
    tb.save_board_archive(board_day(spark, "concept", ["BK2", "BK3"], money=["BK2"]), root)
    assert "concept money rows: expected 96, got 48" in manifest_of(spark, root).validation_errors
    tb.save_board_archive(board_day(spark, "concept", ["BK2"]), root)
    tb.save_stock_archive(stock_day(spark, ["600001", "600002"], unquoted=["600002"]), root)
    m = manifest_of(spark, root)
    assert m.validation_errors == ["stock five-minute kline rows: expected 48, got 0"]
    assert (m.industry_money_rows, m.concept_close_rows, m.stock_close_rows, m.stock_money_rows) == (48, 1, 1, 48)
    assert spark.read.parquet(f"{root}/coverage").filter("missing_research != array()").count() == 0

    bars = bar_rows(spark, "600001").unionByName(bar_rows(spark, "600002")).unionByName(bar_rows(spark, "600003", 47))
    rejected = tb.save_stock_bars(bars, root, "v1", "run-1")
    assert sorted(rows(rejected, "code", "reason")) == [("600002", "not_eligible"), ("600003", "incomplete")]
    m = manifest_of(spark, root)
    assert (m.status, m.validation_errors, m.kline_source_counts) == ("complete", [], {"trend_1m": 1})
    research = spark.read.parquet(f"{root}/stock_research_5m")
    assert research.filter("money_available AND kline_available").count() == 48
    assert research.filter("minute_index = 47").first().dark_money == 48

    # Another date changes nothing here; a rerun of the stock side drops the bars.
    tb.save_board_archive(board_day(spark, "industry", ["BK1"], NEXT), root)
    assert manifest_of(spark, root).status == "complete"
    tb.save_stock_archive(stock_day(spark, ["600001"]), root)
    m = manifest_of(spark, root)
    assert (m.status, m.stock_kline_rows, m.kline_source_counts) == ("incomplete", 0, {})


def test_nothing_is_written_on_errors(spark, root):
    bad = ar.ArchiveDay(*[getattr(board_day(spark, "industry", ["BK1"]), n) for n in ("closes", "points")],
                        errors(spark, ("industry", "BK1", "missing_quote")))
    with pytest.raises(ValueError):
        tb.save_board_archive(bad, root)
    off = board_day(spark, "industry", ["BK1"])
    with pytest.raises(ValueError):
        tb.save_board_archive(ar.ArchiveDay(off.closes, off.points.withColumn(
            "snapshot_at", F.col("snapshot_at") + F.expr("INTERVAL 1 MINUTE")), off.errors), root)
    with pytest.raises(ValueError):
        tb.save_daily_close(records(spark, [dict(trade_date=DATE, rank_type="stock", code="A", quote_available=False)]), f"{root}/x")
    assert tb.read_table(spark, f"{root}/manifest") is None


def minute_rows(spark, values, date=DATE, fetched=0):
    data = []
    for minute, kind, code, dark in values:
        stamp = at(date, minute // 60, minute % 60)
        data.append(dict(trade_date=date, snapshot_at=stamp, rank_type=kind, code=code, market=90, dark_money=dark,
                         quote_time="093100", fetched_at=stamp + dt.timedelta(seconds=fetched)))
    return records(spark, data)


def minutes_read(spark, path):
    return sorted((r.snapshot_at.minute, r.code, r.dark_money) for r in mn.read_minute_board(spark, path).collect())


def test_minute_boards_are_upserted(spark, root):
    path = f"{root}/minute"
    assert mn.read_minute_board(spark, path) is None and mn.fold_minute_board(spark, path, at(DATE, 23, 0)) == 0
    first = minute_rows(spark, [(571, "industry", "A", 1), (571, "industry", "B", 2), (572, "industry", "A", 3)])
    mn.append_minute_board(first, path, "1")
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "A", 9)], fetched=5), path, "2")
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "B", 7)], fetched=-5), path, "3")  # older copy
    mn.append_minute_board(first, path, "1")  # replay
    want = [(31, "A", 9), (31, "B", 2), (32, "A", 3)]
    assert minutes_read(spark, path) == want
    with pytest.raises(ValueError):
        mn.append_minute_board(minute_rows(spark, [(571, "stock", "A", 1)]), path, "4")
    assert mn.fold_minute_board(spark, path, at(DATE, 9, 59)) == 0  # the hour is still open
    assert mn.fold_minute_board(spark, path, at(DATE, 10, 0)) == 1
    assert os.listdir(f"{path}/trade_date={DATE}/hour=9") == ["batch=folded-000001"]
    assert minutes_read(spark, path) == want
    mn.append_minute_board(first, path, "1")  # a replay after the fold
    mn.append_minute_board(minute_rows(spark, [(572, "industry", "A", 4)], fetched=60), path, "5")
    assert minutes_read(spark, path) == [(31, "A", 9), (31, "B", 2), (32, "A", 4)]
    assert mn.fold_minute_board(spark, path, at(DATE, 12, 0)) == 1
    assert minutes_read(spark, path) == [(31, "A", 9), (31, "B", 2), (32, "A", 4)]
    today = spark.createDataFrame([(day(NEXT),)], "trade_date date")
    assert mn.read_minute_board(spark, path, today).count() == 0


def test_a_fold_that_dies_loses_nothing(spark, root, monkeypatch):
    path = f"{root}/minute"
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "A", 1), (572, "industry", "A", 3)]), path, "1")
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "A", 9)], fetched=5), path, "2")
    with monkeypatch.context() as broken:
        broken.setattr(mn.Folder, "remove", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            mn.fold_minute_board(spark, path, at(DATE, 12, 0))
    assert minutes_read(spark, path) == [(31, "A", 9), (32, "A", 3)]
    assert mn.fold_minute_board(spark, path, at(DATE, 12, 0)) == 1
    assert os.listdir(f"{path}/trade_date={DATE}/hour=9") == ["batch=folded-000002"]
    assert minutes_read(spark, path) == [(31, "A", 9), (32, "A", 3)]


def test_an_append_that_dies_leaves_other_batches_alone(spark, root):
    path = f"{root}/minute"
    mn.append_minute_board(minute_rows(spark, [(571, "industry", "A", 1)]), path, "1")
    rows = minute_rows(spark, [(571, "industry", "B", 2), (572, "industry", "B", 3)])
    with pytest.raises(Exception, match="stop here"):
        mn.append_minute_board(rows.withColumn("code", F.when(F.col("dark_money") == 3, F.raise_error(F.lit("stop here"))).otherwise(F.col("code"))), path, "2")
    assert minutes_read(spark, path) == [(31, "A", 1)]
    mn.append_minute_board(rows, path, "2")
    assert minutes_read(spark, path) == [(31, "A", 1), (31, "B", 2), (32, "B", 3)]


def test_compaction(spark):
    full = [(m, k, "A", m) for k in ("industry", "concept") for m in [*range(571, 691), *range(781, 901)]]
    partial = [(m, "industry", "A", 1) for m in (571, 575)]
    board = minute_rows(spark, full).unionByName(minute_rows(spark, partial, NEXT))
    kept = board.filter("rank_type = 'industry' AND dark_money = 575").withColumn("dark_money", F.lit(-1).cast("bigint"))
    made = ar.compact_intraday(board, kept, board.limit(0))
    assert made.curve_rows.filter("trade_date = '2026-08-14'").count() == 95
    assert made.curve_rows.first().source_time == 93100
    assert made.close_rows.count() == 2 and rows(made.purgeable, "trade_date") == [(day(DATE),)]
    cov = {(str(r.trade_date), r.rank_type): r for r in made.coverage.collect()}
    assert cov[(DATE, "concept")].collected_minutes == 240 and cov[(DATE, "concept")].missing_minutes == []
    late = cov[(NEXT, "industry")]
    assert (late.collected_minutes, late.collected_research, late.collected_daily_close) == (2, 1, 0)
    assert len(late.missing_minutes) == 238 and late.missing_research[0] == "09:40" and late.missing_daily_close == ["15:00"]


def test_repairs(spark):
    p = points(spark, curve(DATE, "industry", "A", [0, 5])).withColumn("money_available", F.lit(False))
    assert sorted(rows(ar.repair_availability(p), "money_available")) == [(False,), (True,)]
    snaps = points(spark, [r for c in "AB" for r in curve(DATE, "industry", c, RISING)]).withColumn("snapshot_kind", F.lit("research_5m"))
    present = snaps.filter("code = 'A' AND minute_index = 47").withColumns(
        {"snapshot_kind": F.lit("daily_close"), "dark_money": F.lit(0).cast("bigint")})
    made = ar.promote_close_rows(snaps.unionByName(present)).filter("snapshot_kind = 'daily_close'")
    assert sorted(rows(made, "code", "dark_money")) == [("A", 0), ("B", 48)] and ar.promote_close_rows(snaps).count() == 96


def test_digest_and_seal(spark):
    daily = records(spark, [dict(trade_date=d, rank_type="stock", code="A") for d in (DATE, NEXT)])
    manifest = spark.createDataFrame([(day(DATE), "complete"), (day(NEXT), "incomplete")], "trade_date date, status string")
    known = spark.createDataFrame([(day(DATE), "old-id", 1)], "trade_date date, revision_id string, revision_no int")
    def seal(table, revisions):
        return ar.seal_archive(manifest, {"daily": table}, revisions, "eod-", F.current_timestamp()).collect()
    (new,) = seal(daily, known.limit(0))
    assert (new.revision_id, new.revision_no) == ("eod-20260814", 1)
    (again,) = seal(daily.withColumn("fetched_at", F.current_timestamp()), known)
    assert (again.revision_id, again.content_sha256) == ("old-id", new.content_sha256)
    (changed,) = seal(daily.withColumn("close_price", F.lit(2.0)), known)
    assert changed.content_sha256 != new.content_sha256


def test_missing_bars_and_inconsistent_quality(spark):
    daily = records(spark, [dict(trade_date=DATE, rank_type="stock", code=c, rank=r, quote_available=q)
                            for c, r, q in (("A", 2, True), ("B", 1, True), ("C", 3, False))])
    research = spark.createDataFrame([(day(DATE), 0, "A", True, True)] * 47 + [(day(DATE), 0, "A", True, False)],
                                     "trade_date date, market bigint, code string, money_available boolean, kline_available boolean")
    assert rows(qu.missing_bars(daily, research), "code", "bar_rows") == [("B", 0), ("A", 47)]
    quality = qu.stock_quality(daily, research)
    assert qu.inconsistent_quality(quality, daily).count() == 0
    assert qu.inconsistent_quality(quality.withColumn("expected_kline_stocks", F.lit(9)), daily).count() == 1


# -- views -------------------------------------------------------------------

def test_paging_and_search(spark):
    daily = records(spark, [dict(trade_date=DATE, rank_type="stock", code=c, name=n, dark_money=m, rank=r) for c, n, m, r in
                            (("000001", "平安银行", 300, 1), ("600000", "浦发银行", 100, 3), ("000002", "万科A", 200, 2))])
    page, total = vw.close_page(daily, "stock", DATE, search="银行", sort="dark_money", descending=True, size=1)
    assert rows(page, "code") == [("000001",)] and total.first()[0] == 2
    page, total = vw.close_page(daily, "stock", DATE, search="%")
    assert page.count() == 0 and total.first()[0] == 0
    page, _ = vw.close_page(daily, "stock", DATE, sort="no such column", page=2, size=2)
    assert rows(page, "rank") == [(3,)]
    for bad in (dict(page=0), dict(size=0)):
        with pytest.raises(ValueError):
            vw.close_page(daily, "stock", DATE, **bad)


def test_fallback_order(spark):
    work = minute_rows(spark, [(600, "industry", "A", 1)])
    curve_rows = minute_rows(spark, [(600, "industry", "A", 2), (600, "concept", "A", 3), (900, "concept", "A", 4)])
    close = minute_rows(spark, [(900, "industry", "A", 5), (900, "concept", "A", 6)])
    def board(minute):
        stamp = F.lit(at(DATE, minute // 60, minute % 60))
        return rows(vw.rank_at(work, curve_rows, close, stamp), "rank_type", "dark_money")
    assert board(600) == [("concept", 3), ("industry", 1)]
    assert board(900) == [("concept", 6), ("industry", 5)]
    assert sorted(rows(vw.latest_rank(work, close), "rank_type", "dark_money")) == [("concept", 6), ("industry", 1)]
    series = rows(vw.day_series(work, curve_rows, close), "rank_type", "dark_money")
    assert [v for k, v in series if k == "industry"] == [1]
    assert sorted(v for k, v in series if k == "concept") == [3, 4, 6]


@pytest.mark.parametrize("values,wanted", [([[10, 15], [3, 5]], [10, 15, 18, 20]), ([[10, 15], [-4, -1]], [10, 15, 11, 14]),
                                           ([[10, None], [None, 5], [1, 2]], [10, None, None, 15, 16, 17]), ([[1, 2]], [1, 2])])
def test_stitching(spark, values, wanted):
    data = [(day(DATE) + dt.timedelta(days=d), point_time(DATE, i) + dt.timedelta(days=d), "A", v)
            for d, part in enumerate(values) for i, v in enumerate(part)]
    df = spark.createDataFrame(data, "trade_date date, snapshot_at timestamp, code string, dark_money bigint")
    made = vw.stitch_cumulative(df, ["code"], "dark_money", "s").orderBy("snapshot_at")
    assert [r.s for r in made.collect()] == wanted


def test_timeline_and_meta(spark):
    five = minute_rows(spark, [(575, "industry", "A", 1), (900, "industry", "A", 2)]).withColumn("quote_time", F.lit("2608140935"))
    assert cal.fill_timeline(five, ["code"], ["dark_money"]).count() == 48
    assert cal.fill_timeline(five.filter("dark_money = 1"), ["code"], ["dark_money"]).count() == 47
    one = minute_rows(spark, [(571, "industry", "A", 1)])
    assert cal.fill_timeline(one, ["code"], ["dark_money"]).filter("dark_money IS NOT NULL").count() == 1
    assert cal.fill_timeline(one, ["code"], ["dark_money"]).count() == 240
    assert rows(vw.series_meta(five, ["code"]), "interval", "research_points", "daily_close_points") == [("5m", 2, 0)]
    closed = five.withColumn("quote_time", F.lit("150000"))
    assert rows(vw.series_meta(closed, ["code"]), "interval", "daily_close_points") == [("5m+close", 1)]
    assert rows(vw.series_meta(one, ["code"]), "interval") == [("1m",)]


def test_constituents(spark):
    held = relations(spark, [dict(stock_code=c, board_code="BK1") for c in "ABC"])
    daily = records(spark, [dict(trade_date=DATE, rank_type="stock", code=c, open_price=5.0, turnover_rate=0.5, turnover=50, rank=7) for c in "AB"])
    q = spark.createDataFrame([("A", 10.0, 9.0, 0, 0.1, True), ("B", 10.0, 0.0, 60, 0.1, True)],
                              "code string, latest_price double, open_price double, turnover bigint, turnover_rate double, available boolean")
    for name in ("high_price", "low_price", "previous_close", "amplitude", "change_pct", "change_value"):
        q = q.withColumn(name, F.lit(1.0))
    got = {r.stock_code: r for r in vw.constituent_board(held, q.withColumns({"volume": F.lit(1), "quote_time": F.lit("")}), daily).collect()}
    assert (got["A"].open_price, got["A"].turnover, got["A"].turnover_rate) == (9.0, 50, 0.1)
    assert (got["B"].open_price, got["B"].turnover, got["B"].turnover_rate, got["B"].dark_rank) == (5.0, 60, 0.5, 7)
    assert not got["C"].quote_available and not got["C"].dark_data_available


def test_calendar(spark):
    rules = spark.createDataFrame([(day("2026-10-01"), "holiday"), (day("2026-09-27"), "workday")], "date date, kind string")
    dim = cal.neighbour_trading_days(cal.date_dimension(spark, day("2026-09-25"), day("2026-10-03"), rules))
    got = {str(r.date): r for r in dim.collect()}
    assert got["2026-09-27"].is_trading and not got["2026-09-26"].is_trading and not got["2026-10-01"].is_trading
    assert str(got["2026-10-01"].latest) == "2026-09-30" and str(got["2026-09-28"].previous) == "2026-09-27"
    state = spark.range(1).select(*[cal.calendar_coverage(F.lit(v), F.lit(day("2026-12-30"))).alias(f"c{i}")
                                    for i, v in enumerate(("2026-12-31", "2026-12-01", ""))]).first()
    assert [tuple(c) for c in state] == [(1, False), (-29, True), (0, True)]


# -- run log and exports -----------------------------------------------------

def test_retention(spark):
    now = dt.datetime(2026, 8, 20)
    data = [("a", "stock", "success", 40, 10), ("b", "stock", "success", 5, 20), ("c", "stock", "failed", 40, 0),
            ("d", "stock", "failed", 200, 0), ("e", "stock", "running", 400, 0)]
    log = spark.createDataFrame([(i, k, s, now - dt.timedelta(days=d), now - dt.timedelta(days=d), n, 100) for i, k, s, d, n in data],
                                "run_id string, rank_type string, status string, started_at timestamp, finished_at timestamp, fetched_total bigint, duration_ms bigint")
    old = spark.createDataFrame([("stock", "success", 2, 7, 50, now - dt.timedelta(days=90))], schemas.RUN_ROLLUP)
    rollup, kept = rn.roll_up_runs(log, old, F.lit(now))
    assert sorted(rows(kept, "run_id")) == [("b",), ("c",), ("e",)]
    assert sorted(rows(rollup, "status", "run_count", "record_count")) == [("failed", 1, 0), ("success", 3, 17)]
    assert rollup.filter("status = 'success'").first().latest_success_at == now - dt.timedelta(days=40)
    assert rows(rn.success_totals(kept, rollup), "record_count", "run_count") == [(37, 4)]
    with pytest.raises(ValueError):
        rn.expired(F.lit(now), 30, 10)


def export_tables(spark):
    daily = records(spark, [dict(trade_date=d, rank_type=k, code="A", rank=1, open_price=1.23456) for d in (DATE, NEXT) for k in ("stock", "concept")])
    revisions = spark.createDataFrame([("r1", day(DATE), 1, None, "x", at(DATE, 17, 0)), ("r2", day(NEXT), 1, None, "y", at(NEXT, 17, 0))],
                                      schemas.REVISION)
    features = daily.select("trade_date", "rank_type", "code").withColumn("revision_id", F.lit("r1"))
    return {"current": revisions, "revisions": revisions, "daily_close": daily, "daily_features": features}


def test_export(spark, root):
    names = ["revisions", "daily_close", "daily_features"]
    made = ex.export_datasets(export_tables(spark), DATE, NEXT, root, "both", names).first()
    assert [r.revision_id for r in made.revisions] == ["r1", "r2"]
    assert made.datasets.daily_close.rows == 4 and made.datasets.daily_features.rows == 2
    assert spark.read.parquet(f"{root}/daily_close").count() == 4
    assert spark.read.option("header", True).csv(f"{root}/daily_close_csv").count() == 4
    with pytest.raises(ValueError):
        ex.export_datasets(export_tables(spark), "2020-01-01", "2020-01-02", f"{root}/none", names=names)
    with pytest.raises(ValueError):
        ex.export_datasets(export_tables(spark), NEXT, DATE, root)


def test_csv_text(spark, root):
    made = ex.close_csv(export_tables(spark)["daily_close"], DATE, "r1")
    assert made.columns == list(ex.CLOSE_COLUMNS)
    first = made.first()
    assert (first.rank_type, first.open_price, first.change_pct, first.quote_available) == ("concept", "1.2346", "0.00000000", "true")
    assert first.snapshot_at == "2026-08-14T15:00:00+08:00"
    ex.write_csv(made.coalesce(1), f"{root}/csv")
    import glob

    (part,) = glob.glob(f"{root}/csv/*.csv")
    raw = open(part, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfrevision_id,trade_date")
