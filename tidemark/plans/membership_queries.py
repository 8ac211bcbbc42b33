"""Membership queries: as-of views, intervals, diffs, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import membership as mb
from tidemark.operators.calendar import date_index
from tidemark.plans import standin as st
from tidemark.plans.registry import query, text

AS_OF = "2024-01-17"
MEMBER = ["stock_code", "stock_market", "stock_name", "board_code", "board_type", "source_order"]
MEMBER_SQL = "stock_code, stock_market, stock_name, board_code, board_type, source_order"


def _tables(spark, sf):
    return st.membership_tables(spark, sf)


@query("members_as_of", "scans", f"SELECT {MEMBER_SQL} FROM scans WHERE d=DATE '{AS_OF}'")
def members_as_of(spark, sf):
    return mb.members_as_of(*_tables(spark, sf), AS_OF).select(*MEMBER)


@query("stock_boards_as_of", "scans", f"""
SELECT {MEMBER_SQL} FROM scans WHERE d=DATE '{AS_OF}' AND stock_code='600007'""")
def stock_boards_as_of(spark, sf):
    return mb.stock_boards(mb.members_as_of(*_tables(spark, sf), AS_OF, stock_code="600007")).select(*MEMBER)


@query("board_stocks_as_of", "scans", f"""
SELECT {MEMBER_SQL} FROM scans WHERE d=DATE '{AS_OF}' AND board_type='concept' AND board_code='BKpurchase'""")
def board_stocks_as_of(spark, sf):
    held = mb.members_as_of(*_tables(spark, sf), AS_OF, board_type="concept", boards=["BKpurchase"])
    return mb.board_stocks(held).select(*MEMBER)


@query("members_as_of_batch", "scans daily", f"""
SELECT {MEMBER_SQL} FROM scans WHERE d=DATE '{AS_OF}' AND board_type='concept'
 AND board_code IN (SELECT code FROM daily WHERE rank_type='concept' AND d=DATE '{AS_OF}' AND dark_money>0)""")
def members_as_of_batch(spark, sf):
    daily = st.daily_close(spark, sf)
    boards = daily.filter((F.col("rank_type") == "concept") & (F.col("trade_date") == F.lit(AS_OF).cast("date"))
                          & (F.col("dark_money") > 0)).select(F.col("code").alias("board_code"))
    return mb.members_as_of(*_tables(spark, sf), AS_OF, board_type="concept", boards=boards).select(*MEMBER)


@query("membership_changes", "changes", """
SELECT CAST(effective_date AS VARCHAR) AS effective_date, change_type, stock_code, board_code FROM changes""")
def membership_changes(spark, sf):
    _, changes = _tables(spark, sf)
    return changes.select(text("effective_date"), "change_type", "stock_code", "board_code")


@query("changes_on", "changes", f"""
SELECT change_type, board_type, board_code, stock_code FROM changes WHERE effective_date=DATE '{AS_OF}' AND board_type='industry'""")
def changes_on(spark, sf):
    _, changes = _tables(spark, sf)
    return mb.changes_on(changes, AS_OF, "industry").select("change_type", "board_type", "board_code", "stock_code")


@query("membership_intervals", "scans idx", """, runs AS (
 SELECT stock_code, board_code, date_idx, date_idx - row_number() OVER (PARTITION BY stock_code, board_code ORDER BY date_idx) AS g
 FROM (SELECT DISTINCT stock_code, board_code, date_idx FROM scans JOIN idx USING (d)))
SELECT stock_code, board_code, CAST(a.d AS VARCHAR) AS valid_from, CAST(b.d AS VARCHAR) AS valid_to FROM (
 SELECT stock_code, board_code, min(date_idx) AS f, max(date_idx)+1 AS t FROM runs GROUP BY stock_code, board_code, g)
JOIN idx a ON a.date_idx=f LEFT JOIN idx b ON b.date_idx=t""")
def membership_intervals(spark, sf):
    return mb.membership_intervals(*_tables(spark, sf)).select(
        "stock_code", "board_code", text("valid_from"), text("valid_to"))


@query("members_by_date", "scans", "SELECT CAST(d AS VARCHAR) AS trade_date, stock_code, board_code FROM scans")
def members_by_date(spark, sf):
    index = st.sealed_dates(spark, sf)
    spans = mb.membership_intervals(*st.membership_tables(spark, sf, index))
    return mb.members_by_date(spans, index).select(text("trade_date"), "stock_code", "board_code")


@query("primary_industry_as_of", "primary_ind", f"""
SELECT stock_code, industry_code FROM primary_ind WHERE d=DATE '{AS_OF}'""")
def primary_industry_as_of(spark, sf):
    return mb.primary_industry(*_tables(spark, sf), AS_OF)


@query("primary_industry_by_date", "primary_ind", """
SELECT CAST(d AS VARCHAR) AS trade_date, stock_code, industry_code FROM primary_ind""")
def primary_industry_by_date(spark, sf):
    index = st.sealed_dates(spark, sf)
    made = mb.primary_industry_by_date(*st.membership_tables(spark, sf, index, "industry"), index)
    return made.select(text("trade_date"), "stock_code", "industry_code")


@query("supplier_of_part_changes", "", """
WITH m AS (SELECT DISTINCT l_partkey, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS mon FROM lineitem),
x AS (SELECT mon, row_number() OVER (ORDER BY mon)-1 AS i FROM (SELECT DISTINCT mon FROM m)),
e AS (SELECT l_partkey, l_suppkey, i, lag(i) OVER w AS b, lead(i) OVER w AS a FROM m JOIN x USING (mon)
 WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY i))
SELECT l_partkey, l_suppkey, change_type, CAST(x.mon AS VARCHAR) AS effective_date FROM (
 SELECT l_partkey, l_suppkey, i AS at, 'added' AS change_type FROM e WHERE i>0 AND coalesce(b,-2)<>i-1
 UNION ALL SELECT l_partkey, l_suppkey, i+1, 'removed' FROM e WHERE i<(SELECT max(i) FROM x) AND coalesce(a,-2)<>i+1) c
JOIN x ON x.i=c.at""")
def supplier_of_part_changes(spark, sf):
    """Part-supplier edges of each shipping month diffed against the month before."""
    scans = st.table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", F.trunc(F.to_date("l_shipdate"), "month").alias("mon"))
    events = mb.scans_to_events(scans, ["l_partkey", "l_suppkey"], "mon", date_index(scans, "mon"))
    return events.select("l_partkey", "l_suppkey", "change_type", text("effective_date"))


@query("snapshot_diff", "", """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate)<1996 OR l_shipdate IS NULL),
b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate)>=1996)
SELECT *, 'added' AS change_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def snapshot_diff(spark, sf):
    edges = st.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    late = F.coalesce(F.col("y") >= 1996, F.lit(False))
    old, new = (edges.filter(part).select("l_partkey", "l_suppkey").distinct() for part in (~late, late))
    return mb.snapshot_diff(old, new, ["l_partkey", "l_suppkey"])


def _scan_day(spark, sf):
    """The scan of AS_OF applied to the state of the day before."""
    baseline, changes = _tables(spark, sf)
    day = F.lit(AS_OF).cast("date")
    before = changes.filter(F.col("effective_date") < day)
    current = mb.members_as_of(baseline, before, AS_OF).withColumnRenamed("effective_date", "since_date")
    scan = st.membership_scans(spark, sf).filter(F.col("trade_date") == day)
    return mb.apply_membership_scan(scan, baseline, current, before, AS_OF, day.cast("timestamp_ntz"), "scan")


@query("apply_membership_scan", "changes", f"""
SELECT CAST(effective_date AS VARCHAR) AS effective_date, change_type, stock_code, board_code, source_order FROM changes WHERE effective_date=DATE '{AS_OF}'""")
def apply_membership_scan(spark, sf):
    return _scan_day(spark, sf).changes.select(text("effective_date"), "change_type", "stock_code", "board_code",
                                               "source_order")


@query("membership_scan_state", "scans idx", f"""
SELECT s.stock_code, s.board_code, CAST((SELECT max(i.d) FROM idx i WHERE i.d<=DATE '{AS_OF}' AND EXISTS (SELECT 1 FROM scans p WHERE p.d=i.d AND p.stock_code=s.stock_code AND p.board_code=s.board_code)
  AND (i.date_idx=0 OR NOT EXISTS (SELECT 1 FROM scans q JOIN idx j USING (d) WHERE j.date_idx=i.date_idx-1 AND q.stock_code=s.stock_code AND q.board_code=s.board_code))) AS VARCHAR) AS since_date
FROM scans s WHERE s.d=DATE '{AS_OF}'""")
def membership_scan_state(spark, sf):
    return _scan_day(spark, sf).current.select("stock_code", "board_code", text("since_date"))


@query("membership_scan_summary", "scans changes", f"""
, n AS (SELECT (SELECT count(*) FROM scans WHERE d=DATE '{AS_OF}') AS relation_count, (SELECT count(*) FROM scans WHERE d=DATE '{AS_OF}'-1) AS previous,
 (SELECT count(DISTINCT board_type||board_code) FROM scans WHERE d=DATE '{AS_OF}') AS board_count,
 (SELECT count(*) FROM changes WHERE effective_date=DATE '{AS_OF}' AND change_type='added') AS a,
 (SELECT count(*) FROM changes WHERE effective_date=DATE '{AS_OF}' AND change_type='removed') AS r)
SELECT CASE WHEN previous>=1000 AND relation_count*100<previous*90 THEN 'rejected' ELSE 'applied' END AS status, relation_count, board_count,
 CASE WHEN previous>=1000 AND relation_count*100<previous*90 THEN 0 ELSE a END AS added_count,
 CASE WHEN previous>=1000 AND relation_count*100<previous*90 THEN 0 ELSE r END AS removed_count FROM n""")
def membership_scan_summary(spark, sf):
    return _scan_day(spark, sf).summary.select("status", "relation_count", "board_count", "added_count", "removed_count")


@query("relation_errors", "", """
SELECT CASE WHEN l_partkey%97=0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS stock_code, CAST(l_suppkey AS VARCHAR) AS board_code,
 CASE WHEN l_partkey%97=0 THEN 'empty_code' ELSE 'unknown_board_type' END AS reason FROM lineitem WHERE l_partkey%97=0 OR l_returnflag='R'""")
def relation_errors(spark, sf):
    part = F.col("l_partkey")
    rows = st.table(spark, sf, "lineitem").select(
        F.when(part % 97 == 0, "").otherwise(part.cast("string")).alias("stock_code"),
        F.col("l_suppkey").cast("string").alias("board_code"),
        F.when(F.col("l_returnflag") == "A", "industry").when(F.col("l_returnflag") == "N", "concept")
        .otherwise("region").alias("board_type"))
    return mb.relation_errors(rows)
