import pytest
from pyspark.sql import functions as F

from builders import at, day, relations, rows
from tidemark import schemas
from tidemark.operators import membership as mb

DAY1, DAY2, DAY3 = "2026-08-10", "2026-08-11", "2026-08-12"


def stamp(date):
    return F.lit(at(date, 16, 0)).cast("timestamp")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def scan(spark, edges):
    return relations(spark, [dict(stock_code=s, board_code=b) for s, b in edges])


class Book:
    """Applies outcomes the way a nightly job would, keeping the tables in memory."""

    def __init__(self, spark):
        self.spark = spark
        self.baseline = empty(spark, schemas.RELATION_BASELINE)
        self.changes = empty(spark, schemas.RELATION_CHANGE)
        self.current = empty(spark, schemas.RELATION_CURRENT)

    def _freeze(self, df, schema):
        return self.spark.createDataFrame(df.select(*schema.names).collect(), schema)

    def apply(self, edges, date, run="run"):
        out = mb.apply_membership_scan(scan(self.spark, edges), self.baseline, self.current, self.changes, date,
                                       stamp(date), run)
        summary = out.summary.first()
        if summary.status in ("applied", "baseline"):
            current = self._freeze(out.current, schemas.RELATION_CURRENT)
            if summary.status == "baseline":
                self.baseline = self._freeze(out.baseline, schemas.RELATION_BASELINE)
            else:
                kept = self.changes.filter(F.col("effective_date") != F.lit(date).cast("date"))
                self.changes = self._freeze(kept.unionByName(out.changes), schemas.RELATION_CHANGE)
            self.current = current
        return summary

    def members(self, date):
        return sorted(rows(mb.members_as_of(self.baseline, self.changes, date), "stock_code", "board_code"))


def test_scans_over_three_days(spark):
    book = Book(spark)
    first = [("A", "BK1"), ("B", "BK1"), ("C", "BK2")]
    assert book.apply(first, DAY1).status == "baseline"
    assert book.apply(first, DAY2).status == "unchanged"
    third = [("A", "BK1"), ("C", "BK2"), ("D", "BK2")]
    s = book.apply(third, DAY3)
    assert (s.status, s.added_count, s.removed_count, s.relation_count, s.board_count) == ("applied", 1, 1, 3, 2)
    assert book.members(DAY1) == book.members(DAY2) == sorted(first)
    assert book.members(DAY3) == sorted(third)
    assert book.members("2026-08-09") == []
    assert {(r.stock_code, str(r.since_date)) for r in book.current.collect()} == {("A", DAY1), ("C", DAY1), ("D", DAY3)}
    # The same day again with another outcome replaces that day's events.
    again = [("A", "BK1"), ("B", "BK1"), ("C", "BK2"), ("E", "BK1")]
    s = book.apply(again, DAY3, "rerun")
    assert (s.added_count, s.removed_count) == (1, 0)
    assert rows(book.changes, "stock_code", "change_type", "run_id") == [("E", "added", "rerun")]
    assert book.members(DAY3) == sorted(again)
    listed = mb.changes_on(book.changes, DAY3, "concept")
    assert rows(listed, "stock_code") == [("E",)] and mb.changes_on(book.changes, DAY3, "industry").count() == 0


def test_guards(spark):
    book = Book(spark)
    assert book.apply([], DAY1).reason == "empty_scan"
    many = [(f"S{i:04d}", f"BK{i % 200}") for i in range(1200)]
    assert book.apply(many, DAY1).status == "baseline"
    s = book.apply(many[:1000], DAY2)
    assert (s.status, s.reason, s.added_count) == ("rejected", "fewer_relations", 0)
    few_boards = [(s, f"BK{i % 150}") for i, (s, _) in enumerate(many)]
    assert book.apply(few_boards, DAY2).reason == "fewer_boards"
    assert book.apply(many[:1100], DAY2).status == "applied"
    book.current = empty(spark, schemas.RELATION_CURRENT)
    assert book.apply(many, DAY3).reason == "current_state_missing"


def test_filters_reach_both_sides(spark):
    base = relations(spark, [dict(baseline_date=DAY1, stock_code=s, board_code=b, board_type=t, source_order=o)
                             for s, b, t, o in (("A", "I2", "industry", 2), ("A", "I1", "industry", 2),
                                                ("A", "C1", "concept", 1), ("B", "I1", "industry", 1))],
                     schemas.RELATION_BASELINE)
    change = relations(spark, [dict(effective_date=DAY2, change_type="removed", stock_code="A", board_code="I1",
                                    board_type="industry", source_order=2, detected_at=at(DAY2, 16, 0), run_id="r")],
                       schemas.RELATION_CHANGE)
    assert rows(mb.stock_boards(mb.members_as_of(base, change, DAY1, stock_code="A")), "board_code") == [
        ("C1",), ("I1",), ("I2",)]
    assert rows(mb.members_as_of(base, change, DAY2, board_type="industry", boards=["I1", ""]), "stock_code") == [("B",)]
    assert sorted(rows(mb.primary_industry(base, change, DAY1), "stock_code", "industry_code")) == [("A", "I1"), ("B", "I1")]
    assert sorted(rows(mb.primary_industry(base, change, DAY2), "stock_code", "industry_code")) == [("A", "I2"), ("B", "I1")]
    index = spark.createDataFrame([(day(d), i) for i, d in enumerate((DAY1, DAY2, DAY3))], "trade_date date, date_idx int")
    by_date = mb.primary_industry_by_date(base, change, index).filter("stock_code = 'A'").orderBy("trade_date")
    assert rows(by_date, "industry_code") == [("I1",), ("I2",), ("I2",)]


def test_intervals_and_dates_outside_the_index(spark):
    base = relations(spark, [dict(baseline_date=DAY1, stock_code="A", board_code="X")], schemas.RELATION_BASELINE)
    change = relations(spark, [
        dict(effective_date=DAY2, change_type="removed", stock_code="A", board_code="X", detected_at=at(DAY2, 16, 0)),
        dict(effective_date="2026-08-20", change_type="added", stock_code="A", board_code="X", detected_at=at("2026-08-20", 16, 0))],
        schemas.RELATION_CHANGE)
    spans = mb.membership_intervals(base, change).orderBy("valid_from")
    assert [(str(a), str(b)) for a, b in rows(spans, "valid_from", "valid_to")] == [(DAY1, DAY2), ("2026-08-20", "None")]
    index = spark.createDataFrame([(day("2026-08-08"), 0), (day(DAY1), 1), (day("2026-08-21"), 2)], "trade_date date, date_idx int")
    assert sorted(rows(mb.members_by_date(spans, index), "date_idx")) == [(1,), (2,)]


def test_a_full_tie_counts_as_removed(spark):
    base = relations(spark, [dict(baseline_date=DAY1, stock_code="A", board_code="X")], schemas.RELATION_BASELINE)
    change = relations(spark, [dict(effective_date=DAY1, change_type="removed", stock_code="A", board_code="X")],
                       schemas.RELATION_CHANGE)
    assert mb.members_as_of(base, change, DAY1).count() == 0


def test_relation_errors(spark):
    bad = relations(spark, [dict(stock_code="", board_code="X"), dict(stock_code="A", board_code="Y", board_type="region"),
                            dict(stock_code="A", board_code="Z")])
    catalog = spark.createDataFrame([("X",), ("Q",)], "board_code string")
    other = spark.createDataFrame([("Q",)], "board_code string")
    assert sorted(rows(mb.relation_errors(bad, catalog, other), "board_code", "reason")) == [
        ("Q", "in_both_catalogs"), ("X", "empty_code"), ("Y", "unknown_board_type")]


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_to_events_against_sets(spark, seed):
    import random

    rng = random.Random(seed)
    dates = [DAY1, DAY2, DAY3, "2026-08-13"]
    seen = {d: {(s, b) for s in "ABCDE" for b in "XY" if rng.random() < 0.5} for d in dates}
    df = spark.createDataFrame([(day(d), s, b) for d in dates for s, b in seen[d]], "d date, s string, b string")
    index = spark.createDataFrame([(day(d), i) for i, d in enumerate(dates)], "d date, date_idx int")
    got = {(r.s, r.b, str(r.effective_date), r.change_type) for r in mb.scans_to_events(df, ["s", "b"], "d", index).collect()}
    want = set()
    for before, now in zip(dates, dates[1:]):
        want |= {(s, b, now, "added") for s, b in seen[now] - seen[before]}
        want |= {(s, b, now, "removed") for s, b in seen[before] - seen[now]}
    assert got == want
