"""Screening queries over the stand-in daily table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import contains_text, is_main_board, is_special_treatment, is_stock_code
from tidemark.operators import screen as sc
from tidemark.operators.calendar import archived_days, complete_dates
from tidemark.operators.membership import members_as_of
from tidemark.plans import standin as st
from tidemark.session import stored
from tidemark.plans.registry import query, text

AS_OF = "2024-01-28"
DAYS = 3
# Sums of cents on the concept side grow with the data, so both sides use ratios and signs as well.
CONCEPT = (sc.Condition("turnover_rate", "gt", 0.05), sc.Condition("dark_inflow_ratio", "lt", 5.0))
STOCK = (sc.Condition("turnover", "gte", 100.0), sc.Condition("dark_activity", "lte", 0.999),
         sc.Condition("control_coefficient", "between", -250.0, 150.0))
REQUEST = sc.ScanRequest(AS_OF, DAYS, CONCEPT, STOCK, "all", "any", sc.Scope(True, True, True))
FREE = sc.ScanRequest(AS_OF, DAYS, (), (sc.Condition("turnover", "gt", 0.0), sc.Condition("rank", "lt", 3.0)), "all",
                      "all", sc.Scope())

_METRIC = """metric AS (SELECT *, CASE WHEN turnover>0 THEN CAST(regular_money+dark_money AS DOUBLE)/turnover*100 ELSE 0.0 END AS control FROM daily)"""
_DATES = f"""good AS (SELECT d FROM daily WHERE d<=DATE '{AS_OF}' AND rank_type IN ('concept','stock') GROUP BY d
 HAVING count(*) FILTER (rank_type='concept')>0 AND count(*) FILTER (rank_type='concept' AND quote_available)=count(*) FILTER (rank_type='concept')
 AND count(*) FILTER (rank_type='stock')>0),
dts AS (SELECT d FROM (SELECT d FROM good ORDER BY d DESC LIMIT {DAYS}) WHERE (SELECT count(*) FROM good)>={DAYS})"""
_CONCEPTS = """con AS (SELECT code, max(name) AS name, count(*) AS n, min(d) FILTER (NOT ok) AS failed_date FROM (
 SELECT *, (turnover_rate>0.05) AND (rank>0 AND dark_inflow_ratio<5.0) AS ok FROM metric SEMI JOIN dts USING (d)
 WHERE rank_type='concept' AND quote_available) GROUP BY code HAVING count(*)=3)"""
_UNIVERSE = """uni AS (SELECT stock_code AS code, max(stock_market) AS market, max(stock_name) AS name, string_agg(board_code, ',' ORDER BY board_code) AS concepts
 FROM scans WHERE d=(SELECT max(d) FROM idx WHERE d<=(SELECT max(d) FROM dts)) AND board_type='concept'
 AND board_code IN (SELECT code FROM con WHERE failed_date IS NULL) GROUP BY stock_code)"""
_RUNS = """run AS (SELECT code, count(*) AS n, list(d) AS present, min(d) FILTER (NOT ok) AS failed_date, arg_max(control, d) AS control FROM (
 SELECT *, (turnover>=100) OR (rank>0 AND dark_activity<=0.999) OR (money_available AND control BETWEEN -250 AND 150) AS ok
 FROM metric SEMI JOIN dts USING (d) WHERE rank_type='stock' AND quote_available) GROUP BY code),
stk AS (SELECT *, CASE WHEN market=0 OR NOT (code LIKE '600%' OR code LIKE '601%' OR code LIKE '603%' OR code LIKE '605%') THEN 'non_main_board'
  WHEN name LIKE '*ST%' THEN 'st_excluded'
  WHEN missing IS NOT NULL AND (failed_date IS NULL OR missing<failed_date) THEN 'missing_daily_close'
  WHEN failed_date IS NOT NULL THEN 'condition_failed' END AS reason
 FROM (SELECT u.*, r.failed_date, r.control, (SELECT min(d) FROM dts WHERE r.present IS NULL OR NOT list_contains(r.present, d)) AS missing
  FROM uni u LEFT JOIN run r USING (code)))"""
_SCAN = ", " + ", ".join((_METRIC, _DATES, _CONCEPTS, _UNIVERSE, _RUNS))


def _members(spark, sf, daily):
    """Edges in force on the last scanned day, which is a value of the plan, not of the driver."""
    baseline, changes = st.membership_tables(spark, sf)
    last = sc.scan_dates(daily, REQUEST).agg(F.max("trade_date")).scalar()
    return members_as_of(baseline, changes.filter(F.col("effective_date") <= last), AS_OF)


def _scan(spark, sf):
    daily = stored(st.daily_close(spark, sf))
    return sc.focus_scan(daily, _members(spark, sf, daily), REQUEST)


@query("scan_stats", "daily scans idx", _SCAN + """
SELECT (SELECT count(*) FROM con) AS concepts_evaluated, (SELECT count(*) FROM con WHERE failed_date IS NULL) AS concepts_qualified,
 count(*) AS stocks_evaluated, count(*) FILTER (reason IS NULL) AS stocks_qualified,
 count(*) FILTER (reason='non_main_board') AS non_main_board_excluded, count(*) FILTER (reason='st_excluded') AS st_excluded,
 count(*) FILTER (reason='missing_daily_close') AS missing_record_excluded FROM stk""")
def scan_stats(spark, sf):
    return _scan(spark, sf).stats


@query("scan_qualified", "daily scans idx", _SCAN + """
SELECT market, code, name, concepts, round(control,6) AS control FROM stk WHERE reason IS NULL""")
def scan_qualified(spark, sf):
    return _scan(spark, sf).stocks.select(
        "market", "code", "name", F.array_join(F.transform("concepts", lambda c: c["code"]), ",").alias("concepts"),
        F.round(F.element_at("days", -1)["control_coefficient"], 6).alias("control"))


@query("scan_rejections", "daily scans idx", _SCAN + """
SELECT 'stock' AS kind, market, code, name, reason, CAST(CASE reason WHEN 'missing_daily_close' THEN missing WHEN 'condition_failed' THEN failed_date END AS VARCHAR) AS failed_date FROM stk WHERE reason IS NOT NULL
UNION ALL SELECT 'concept', 0, code, name, 'condition_failed', CAST(failed_date AS VARCHAR) FROM con WHERE failed_date IS NOT NULL""")
def scan_rejections(spark, sf):
    return _scan(spark, sf).rejections.select("kind", "market", "code", "name", "reason", text("failed_date"))


@query("rejection_page", "daily scans idx", _SCAN + """
SELECT kind, code, reason FROM (
SELECT 'stock' AS kind, code, market, reason FROM stk WHERE reason IS NOT NULL
UNION ALL SELECT 'concept', code, 0, 'condition_failed' FROM con WHERE failed_date IS NOT NULL) ORDER BY kind, code, market LIMIT 2 OFFSET 2""")
def rejection_page(spark, sf):
    return sc.rejection_page(_scan(spark, sf).rejections, 2, 2).select("kind", "code", "reason")


@query("scan_without_concepts", "daily", ", " + _METRIC + ", " + _DATES + """,
run AS (SELECT market, code, count(*) AS n, bool_and(turnover>0 AND rank>0 AND rank<3) AS ok FROM metric SEMI JOIN dts USING (d)
 WHERE rank_type='stock' AND quote_available GROUP BY market, code)
SELECT m.market, m.code, m.name FROM metric m JOIN run r ON r.market=m.market AND r.code=m.code
WHERE m.d=(SELECT max(d) FROM dts) AND m.rank_type='stock' AND m.quote_available AND r.ok AND r.n=3""")
def scan_without_concepts(spark, sf):
    daily = stored(st.daily_close(spark, sf))
    return sc.focus_scan(daily, _members(spark, sf, daily), FREE).stocks.select("market", "code", "name")


@query("default_scan", "daily", """
SELECT CAST(0 AS BIGINT) AS stocks_qualified, (SELECT count(*) FROM (SELECT code FROM daily d SEMI JOIN (
 SELECT d FROM daily WHERE rank_type IN ('concept','stock') AND d<=DATE '2024-01-28' GROUP BY d
 HAVING count(*) FILTER (rank_type='concept')>0 AND count(*) FILTER (rank_type='concept' AND quote_available)=count(*) FILTER (rank_type='concept') AND count(*) FILTER (rank_type='stock')>0
 ORDER BY d DESC LIMIT 3) g ON g.d=d.d WHERE rank_type='concept' AND quote_available GROUP BY code HAVING count(*)=3)) AS concepts_evaluated""")
def default_scan(spark, sf):
    """The standing template; its turnover floor lies above anything in the test tables."""
    daily = stored(st.daily_close(spark, sf))
    made = sc.focus_scan(daily, _members(spark, sf, daily), sc.default_request(AS_OF))
    return made.stats.select("stocks_qualified", "concepts_evaluated")


@query("complete_dates", "daily", ", " + _DATES + " SELECT CAST(d AS VARCHAR) AS trade_date FROM good")
def complete(spark, sf):
    return complete_dates(st.daily_close(spark, sf), AS_OF).select(text("trade_date"))


@query("last_complete_dates", "daily", ", " + _DATES + " SELECT CAST(d AS VARCHAR) AS trade_date FROM dts")
def last_complete(spark, sf):
    return complete_dates(st.daily_close(spark, sf), AS_OF, DAYS).select(text("trade_date"))


@query("archived_days", "daily", ", " + _DATES + " SELECT CAST(d AS VARCHAR) AS trade_date FROM good WHERE d>=DATE '2024-01-10'")
def archived(spark, sf):
    return archived_days(st.daily_close(spark, sf), "2024-01-10", AS_OF).select(text("trade_date"))


@query("daily_metric", "daily", ", " + _METRIC + """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, control AS control_coefficient, rank>0 AS rank_available FROM metric""")
def daily_metric(spark, sf):
    return sc.with_metrics(st.daily_close(spark, sf)).select(
        text("trade_date"), "rank_type", "code", "control_coefficient", "rank_available")


@query("conditions", "daily", ", " + _METRIC + """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, turnover>500 AS gt, turnover_rate>=0.02 AS gte, rank>0 AND rank<2 AS lt,
 rank>0 AND up_count<=1 AS lte, volume=2 AS eq, money_available AND control BETWEEN -50 AND 50 AS between_, change_pct<0 AS plain FROM metric""")
def conditions(spark, sf):
    tests = {"gt": ("turnover", "gt", 500.0), "gte": ("turnover_rate", "gte", 0.02), "lt": ("rank", "lt", 2.0),
             "lte": ("up_count", "lte", 1.0), "eq": ("volume", "eq", 2.0),
             "between_": ("control_coefficient", "between", -50.0, 50.0), "plain": ("change_pct", "lt", 0.0)}
    rows = sc.with_metrics(st.daily_close(spark, sf))
    return rows.select(text("trade_date"), "rank_type", "code",
                       *[sc.condition_passes(sc.Condition(*t)).alias(n) for n, t in tests.items()])


@query("condition_set", "daily", ", " + _METRIC + """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, (turnover>=100) OR (rank>0 AND dark_activity<=0.999) OR (money_available AND control BETWEEN -250 AND 150) AS any_,
 (turnover>=100) AND (rank>0 AND dark_activity<=0.999) AND (money_available AND control BETWEEN -250 AND 150) AS all_,
 (turnover>=100)::INT+(rank>0 AND dark_activity<=0.999)::INT+(money_available AND control BETWEEN -250 AND 150)::INT AS passed,
 1+(rank>0)::INT+money_available::INT AS available FROM metric""")
def condition_set(spark, sf):
    rows = sc.with_metrics(st.daily_close(spark, sf)).withColumns(
        {"_any": sc.evaluation(STOCK, "any"), "_all": sc.evaluation(STOCK, "all")})
    listed = F.col("_any.conditions")
    return rows.select(text("trade_date"), "rank_type", "code", F.col("_any.matched").alias("any_"),
                       F.col("_all.matched").alias("all_"),
                       F.size(F.filter(listed, lambda c: c["passed"])).alias("passed"),
                       F.size(F.filter(listed, lambda c: c["available"])).alias("available"))


@query("present_all_days", "daily", """
SELECT rank_type, code FROM daily GROUP BY rank_type, code HAVING count(DISTINCT d)=(SELECT count(DISTINCT d) FROM daily)""")
def present_all_days(spark, sf):
    days = st.sealed_dates(spark, sf).agg(F.count(F.lit(1))).scalar()
    return sc.present_all_days(st.daily_close(spark, sf), ["rank_type", "code"], days)


@query("consecutive_screen", "daily", """
SELECT rank_type, market, code, CAST(min(d) FILTER (NOT ok) AS VARCHAR) AS first_failed, bool_and(ok) AS qualified FROM (
 SELECT *, turnover>300 AND rank>0 AND dark_activity<=0.999 AS ok FROM daily) GROUP BY rank_type, market, code""")
def consecutive_screen(spark, sf):
    rows = st.daily_close(spark, sf)
    wanted = (sc.Condition("turnover", "gt", 300.0), sc.Condition("dark_activity", "lte", 0.999))
    return sc.day_runs(rows, ["rank_type", "market", "code"], wanted, "all").select(
        "rank_type", "market", "code", text("_failed_date", "first_failed"), F.col("_failed_date").isNull().alias("qualified"))


@query("stocks_of_concepts", "scans", """
SELECT stock_code AS code, max(stock_market) AS market, string_agg(board_code, ',' ORDER BY board_code) AS concepts
FROM scans WHERE board_type='concept' AND d=DATE '2024-01-28' GROUP BY stock_code""")
def stocks_of_concepts(spark, sf):
    held = members_as_of(*st.membership_tables(spark, sf), AS_OF)
    concepts = (st.daily_close(spark, sf).filter(F.col("rank_type") == "concept").select("code", "name").distinct())
    return sc.stocks_of_concepts(held, concepts).select(
        "code", "market", F.array_join(F.transform("concepts", lambda c: c["code"]), ",").alias("concepts"))


@query("main_board_and_st", "", """
SELECT c_custkey, code, (length(code)=6 AND ((c_nationkey%2=1 AND left(code,3) IN ('600','601','603','605')) OR (c_nationkey%2=0 AND left(code,3) IN ('000','001','002','003')))) AS main_board,
 regexp_matches(upper(trim(nm)), '^(ST|\\*ST|S\\*ST|SST)') AS special, regexp_full_match(code,'[0-9]{6}') AS valid_code
FROM (SELECT *, CASE WHEN c_custkey%3=0 THEN CAST(600000+c_custkey*37%6000 AS VARCHAR) WHEN c_custkey%3=1 THEN lpad(CAST(c_custkey*41%5000 AS VARCHAR),6,'0') ELSE 'BK'||c_custkey%10000 END AS code,
 CASE WHEN c_custkey%5=0 THEN ' *st'||c_mktsegment WHEN c_custkey%5=1 THEN 'SST' WHEN c_custkey%5=2 THEN 'S*STx' ELSE c_mktsegment END AS nm FROM customer)""")
def main_board_and_st(spark, sf):
    key = F.col("c_custkey")
    code = (F.when(key % 3 == 0, (600000 + key * 37 % 6000).cast("string"))
            .when(key % 3 == 1, F.lpad((key * 41 % 5000).cast("string"), 6, "0"))
            .otherwise(F.concat(F.lit("BK"), (key % 10000).cast("string"))))
    name = (F.when(key % 5 == 0, F.concat(F.lit(" *st"), "c_mktsegment")).when(key % 5 == 1, "SST")
            .when(key % 5 == 2, "S*STx").otherwise(F.col("c_mktsegment")))
    rows = st.table(spark, sf, "customer").select("c_custkey", "c_nationkey", code.alias("code"), name.alias("nm"))
    return rows.select("c_custkey", "code",
                       is_main_board(F.pmod(F.col("c_nationkey"), F.lit(2)), F.col("code")).alias("main_board"),
                       is_special_treatment(F.col("nm")).alias("special"), is_stock_code(F.col("code")).alias("valid_code"))


@query("search_text", "", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name),'ring') OR contains(lower(p_brand),'ring')")
def search_text(spark, sf):
    return st.table(spark, sf, "part").filter(contains_text("RING", F.col("p_name"), F.col("p_brand"))).select(
        "p_partkey", "p_name")
