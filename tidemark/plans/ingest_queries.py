"""Raw-text parsing, exports and stream forms over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.labels import future_labels
from tidemark.plans import standin as st
from tidemark.plans.registry import instant, query, text
from tidemark.sources import exports as ex
from tidemark.sources import pages as pg
from tidemark.sources import quotes as qt
from tidemark.sources import ticks as tk
from tidemark.streaming import boards as sb

PAGE = 50


# -- ranked lists ------------------------------------------------------------

def rank_pages(spark, sf):
    """Customers as ranked-list pages: one answer of PAGE entries per customer-key block."""
    c = st.table(spark, sf, "customer")
    money = st.cents(F.col("c_acctbal"))
    entry = F.create_map(*[v for k, value in (
        ("4", F.concat(F.lit("C"), F.col("c_custkey").cast("string"))), ("16", F.col("c_name")),
        ("3", F.col("c_nationkey").cast("string")), ("6", money.cast("string")), ("7", (money * 2).cast("string")),
        ("8", (money * 3).cast("string")), ("9", (F.col("c_custkey") % 11).cast("string")),
        ("11", (F.col("c_custkey") / 8).cast("string")), ("5", F.lit("93000")),
        ("14", F.when(F.col("c_nationkey") == 3, "n/a").otherwise("0.5")), ("15", F.col("c_mktsegment")))
        for v in (F.lit(k), value)])
    rows = c.select(F.when(F.col("c_mktsegment") == "BUILDING", "stock").when(
        F.col("c_mktsegment") == "FURNITURE", "industry").otherwise("concept").alias("rank_type"),
        F.floor(F.col("c_custkey") / PAGE).alias("page"), "c_custkey", entry.alias("e"))
    totals = rows.groupBy("rank_type").agg(F.count(F.lit(1)).alias("total"))
    # A page holds at most PAGE entries.
    listed = rows.groupBy("rank_type", "page").agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", F.to_json("e").alias("e")))).alias("l"))
    body = F.concat(F.lit('{"errid":0,"1":"20240117","2":"'), F.col("total").cast("string"), F.lit('","data":['),
                    F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))
    return listed.join(F.broadcast(totals), "rank_type").select(
        F.lit("2024-01-17").cast("date").alias("trade_date"), "rank_type", "page", body.alias("body"))


_TYPE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'stock' WHEN 'FURNITURE' THEN 'industry' ELSE 'concept' END"


@query("parse_rank_pages", "", f"""
SELECT t AS rank_type, row_number() OVER (PARTITION BY t ORDER BY c_custkey) AS rank, 'C'||c_custkey AS code, c_name AS name, CAST(c_nationkey AS BIGINT) AS market, v AS dark_money, v*2 AS regular_money, v*3 AS main_money_inflow,
 CASE WHEN t='stock' THEN 0 ELSE c_custkey%11 END AS up_count, CAST(c_custkey AS DOUBLE)/8 AS dark_activity, CASE WHEN c_nationkey=3 THEN 0.0 ELSE 0.5 END AS change_pct, CASE WHEN t='stock' THEN '' ELSE c_mktsegment END AS leader_name, '093000' AS quote_time, '2024-01-17' AS answer_date
FROM (SELECT *, {_TYPE} AS t, CAST(round(c_acctbal*100) AS BIGINT) AS v FROM customer)""")
def parse_rank_pages(spark, sf):
    return pg.parse_rank_pages(rank_pages(spark, sf)).select(
        "rank_type", "rank", "code", "name", "market", "dark_money", "regular_money", "main_money_inflow", "up_count",
        "dark_activity", "change_pct", "leader_name", "quote_time", text("answer_date"))


@query("page_position_rank", "", f"""
SELECT t AS rank_type, c_custkey//50 AS page, row_number() OVER (PARTITION BY t ORDER BY c_custkey) AS rank FROM (SELECT *, {_TYPE} AS t FROM customer)""")
def page_position_rank(spark, sf):
    return pg.rank_page_rows(rank_pages(spark, sf)).select("rank_type", "page", "rank")


@query("check_snapshot_complete", "", f"""
SELECT t AS rank_type, 'incomplete' AS reason, count(*) AS expected, count(*) FILTER (c_custkey//50<>4) AS found FROM (SELECT *, {_TYPE} AS t FROM customer) GROUP BY t HAVING count(*)<>count(*) FILTER (c_custkey//50<>4)""")
def check_snapshot_complete(spark, sf):
    """A lost page leaves every list short of its announced total."""
    records = pg.parse_rank_pages(rank_pages(spark, sf).filter("page <> 4"))
    return pg.check_snapshot_complete(records).select("rank_type", "reason", "expected", "found")


@query("empty_snapshots", "", f"""
SELECT {_TYPE} AS rank_type, 'no_data' AS reason, 0 AS expected, 0 AS found FROM customer WHERE {_TYPE}='stock' GROUP BY 1""")
def empty_snapshots(spark, sf):
    """Pages without an entry leave a snapshot of nothing."""
    blank = F.when(F.col("rank_type") == "stock", F.lit('{"errid":0,"data":[]}')).otherwise(F.col("body").cast("string"))
    pages = rank_pages(spark, sf).withColumn("body", blank)
    return pg.check_snapshot_complete(pg.parse_rank_pages(pages), pages=pages).select("rank_type", "reason", "expected", "found")


@query("raw_page_table", "ev", """
SELECT CASE WHEN hour(ts)=15 AND minute(ts)=0 THEN 'daily_close' ELSE 'research_5m' END AS snapshot_kind, event_type AS rank_type, CAST(date_trunc('minute',ts) AS VARCHAR) AS snapshot_at, arg_max(props, event_id) AS body FROM ev JOIN (SELECT event_id AS e, props FROM events) x ON x.e=ev.event_id GROUP BY ALL""")
def raw_page_table(spark, sf):
    pages = st.table(spark, sf, "events").select(
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("snapshot_at"), F.col("event_type").alias("rank_type"),
        F.lit(1).alias("page"), F.col("props").cast("binary").alias("body"), F.col("event_id").alias("fetched_at"))
    return pg.raw_page_table(pages).select("snapshot_kind", "rank_type", instant("snapshot_at"),
                                           F.col("body").cast("string").alias("body"))


# -- ticks and minute text ---------------------------------------------------

def raw_ticks(spark, sf):
    """All points as raw ticks; where an industry lost money main does not add up."""
    points = st.money_points(spark, sf)
    off = F.when((F.col("rank_type") == "industry") & (F.col("dark_money") < -20000), 1).otherwise(0)
    return points.select("trade_date", "rank_type", "market", "code", "dark_money", "regular_money",
                         (F.col("main_money_inflow") + off).alias("main_money_inflow"),
                         F.date_format("snapshot_at", "yyMMddHHmm").cast("bigint").alias("time"))


_TICKS = """bad AS (SELECT d, rank_type, code, CASE WHEN bool_or(rank_type='industry' AND dark_money < -20000) THEN 'inconsistent_money' WHEN count(*)<>48 THEN 'point_count' END AS reason FROM points GROUP BY d, rank_type, code)"""


@query("parse_money_ticks", "points", ", " + _TICKS + """
SELECT CAST(p.d AS VARCHAR) AS trade_date, p.rank_type, p.code, CAST(p.snapshot_at AS VARCHAR) AS snapshot_at, p.dark_money FROM points p JOIN bad b ON b.d=p.d AND b.rank_type=p.rank_type AND b.code=p.code WHERE b.reason IS NULL""")
def parse_money_ticks(spark, sf):
    good, _ = tk.parse_money_ticks(raw_ticks(spark, sf))
    return good.select(text("trade_date"), "rank_type", "code", instant("snapshot_at"), "dark_money")


@query("rejected_curves", "points", ", " + _TICKS + """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, reason FROM bad WHERE reason IS NOT NULL""")
def rejected_curves(spark, sf):
    _, rejected = tk.parse_money_ticks(raw_ticks(spark, sf))
    return rejected.select(text("trade_date"), "rank_type", "code", "reason")


@query("silent_curves", "points", """
SELECT DISTINCT CAST(d AS VARCHAR) AS trade_date, rank_type, code, 'no_ticks' AS reason FROM points WHERE right(code,1)='5'""")
def silent_curves(spark, sf):
    """Curves that were asked for and sent no tick."""
    ticks = raw_ticks(spark, sf)
    _, rejected = tk.parse_money_ticks(ticks.filter(F.right("code", F.lit(1)) != "5"), requested=ticks)
    return rejected.filter("reason = 'no_ticks'").select(text("trade_date"), "rank_type", "code", "reason")


@query("parse_minute_bars", "", """
SELECT l_orderkey, l_linenumber, strftime(l_shipdate,'%Y-%m-%d') AS trade_date, 9*60+30+l_linenumber AS minute, l_extendedprice AS open_price, l_discount AS close_price, CAST(trunc(l_quantity) AS BIGINT) AS cumulative_volume, l_partkey AS cumulative_turnover FROM lineitem""")
def parse_minute_bars(spark, sf):
    stamp = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 09:"), (30 + F.col("l_linenumber")).cast("string"))
    line = F.concat_ws(",", stamp, F.col("l_extendedprice").cast("string"), F.col("l_discount").cast("string"),
                       F.lit("3"), F.lit("1"), F.lit("x"), F.lit(""), F.lit("0"), F.lit("0"), F.lit("0"),
                       F.col("l_quantity").cast("string"), F.col("l_partkey").cast("string"))
    rows = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return pg.parse_minute_bars(rows).select("l_orderkey", "l_linenumber", text("trade_date"), "minute", "open_price",
                                             "close_price", "cumulative_volume", "cumulative_turnover")


# -- quote pages -------------------------------------------------------------

def _answer(rows, keys, entry, order, as_object=False):
    """Pages of a quote-style answer; every page announces its key's total."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    paged = rows.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct(order, F.to_json(entry).alias("e")))).alias("l"))
    if as_object:
        numbered = F.transform("l", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), x["e"]))
        diff = F.concat(F.lit("{"), F.array_join(F.reverse(numbered), ","), F.lit("}"))
    else:
        diff = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]"))
    body = F.concat(F.lit('{"rc":0,"data":{"total":'), F.col("total").cast("string"), F.lit(',"diff":'), diff, F.lit("}}"))
    joined = paged.join(totals, list(keys)) if keys else paged.withColumn("total", F.size("l"))
    return joined.select(*keys, "page", body.alias("body"))


def _part_entry():
    return F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("f12"), F.lit(1).alias("f13"),
                    F.col("p_name").alias("f14"),
                    F.when(F.col("p_size") > 5, F.col("p_retailprice").cast("string")).otherwise("-").alias("f2"),
                    F.col("p_size").alias("f3"), F.col("p_partkey").alias("f5"), F.lit(1705478400).alias("f124"))


def _part_pages(spark, sf, as_object=False):
    rows = st.table(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / PAGE)).withColumn(
        "rank_type", F.when(F.col("p_type") == "ECONOMY", "industry").otherwise("concept"))
    return _answer(rows, ["rank_type"], _part_entry(), "p_partkey", as_object)


@query("parse_board_quotes", "", """
SELECT CASE WHEN p_type='ECONOMY' THEN 'industry' ELSE 'concept' END AS rank_type, 'P'||p_partkey AS code, p_name AS name, CASE WHEN p_size>5 THEN p_retailprice ELSE 0 END AS latest_price, CAST(p_size AS DOUBLE)/100 AS change_pct, p_partkey AS volume, p_size>5 AS available, '2024-01-17T08:00:00Z' AS quote_time FROM part""")
def parse_board_quotes(spark, sf):
    good, _ = qt.parse_board_quotes(_part_pages(spark, sf))
    return good.select("rank_type", "code", "name", "latest_price", "change_pct", "volume", "available", "quote_time")


@query("rows_from_object", "", """
SELECT CASE WHEN p_type='ECONOMY' THEN 'industry' ELSE 'concept' END AS rank_type, p_partkey//50 AS page, row_number() OVER (PARTITION BY CASE WHEN p_type='ECONOMY' THEN 'industry' ELSE 'concept' END, p_partkey//50 ORDER BY p_partkey)-1 AS pos, 'P'||p_partkey AS code FROM part""")
def rows_from_object(spark, sf):
    """Answers as objects keyed by number, written in reverse."""
    entries = qt.quote_entries(_part_pages(spark, sf, as_object=True), ["rank_type"])
    return entries.select("rank_type", "page", F.col("pos").cast("bigint").alias("pos"),
                          F.element_at("q", "f12").alias("code"))


@query("parse_stock_quotes", "", """
SELECT CAST(l_partkey AS VARCHAR) AS code, CASE WHEN p_partkey IS NOT NULL AND p_size>5 THEN p_retailprice ELSE 0 END AS latest_price, coalesce(p_size>5,false) AS available, coalesce(p_name,'asked') AS name
FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_type<>'ECONOMY') ON p_partkey=l_partkey""")
def parse_stock_quotes(spark, sf):
    rows = st.table(spark, sf, "part").filter("p_type <> 'ECONOMY'").withColumn("page", F.floor(F.col("p_partkey") / PAGE))
    entry = F.struct(F.col("p_partkey").cast("string").alias("f12"), F.col("p_name").alias("f14"),
                     F.when(F.col("p_size") > 5, F.col("p_retailprice").cast("string")).otherwise("-").alias("f2"))
    asked = st.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("stock_code")).distinct()
    asked = asked.select("stock_code", F.lit(1).cast("bigint").alias("stock_market"), F.lit("asked").alias("stock_name"))
    made = qt.parse_stock_quotes(asked, _answer(rows, [], entry, "p_partkey"))
    return made.select("code", "latest_price", "available", "name")


def _catalog_pages(spark, sf):
    rows = st.table(spark, sf, "supplier").withColumn("page", F.floor(F.col("s_suppkey") / PAGE)).withColumn(
        "board_type", F.when(F.col("s_acctbal") < 0, "industry").otherwise("concept"))
    entry = F.struct(F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("f12"), F.col("s_name").alias("f14"))
    return _answer(rows, ["board_type"], entry, "s_suppkey")


@query("parse_board_catalog", "", """
SELECT t AS board_type, 'BK'||s_suppkey AS board_code, s_name AS board_name, row_number() OVER (PARTITION BY t ORDER BY 'BK'||s_suppkey) AS source_rank FROM (SELECT *, CASE WHEN s_acctbal<0 THEN 'industry' ELSE 'concept' END AS t FROM supplier)""")
def parse_board_catalog(spark, sf):
    good, _ = qt.parse_board_catalog(_catalog_pages(spark, sf))
    return good.select("board_type", "board_code", "board_name", "source_rank")


def _constituent_pages(spark, sf):
    """Line items as constituent listings of suppliers; a part shipped twice is listed twice."""
    rows = st.table(spark, sf, "lineitem").select(
        F.concat(F.lit("BK"), F.col("l_suppkey").cast("string")).alias("board_code"), "l_orderkey", "l_linenumber",
        F.col("l_partkey").cast("string").alias("f12"), F.floor(F.col("l_orderkey") / 1000).alias("page"))
    entry = F.struct("f12", F.lit("1").alias("f13"), F.concat(F.lit("n"), F.col("f12")).alias("f14"))
    return _answer(rows, ["board_code"], entry, "l_orderkey")


@query("parse_board_constituents", "", """
SELECT 'BK'||l_suppkey AS board_code, CAST(l_partkey AS VARCHAR) AS stock_code, 'n'||l_partkey AS stock_name, CAST(l_suppkey AS INTEGER) AS source_order FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def parse_board_constituents(spark, sf):
    boards = st.table(spark, sf, "supplier").select(
        F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("board_code"), F.col("s_name").alias("board_name"),
        F.lit("concept").alias("board_type"), F.col("s_suppkey").alias("source_rank"))
    good, _ = qt.parse_board_constituents(_constituent_pages(spark, sf), boards, "feed", "list",
                                          F.lit("2024-01-17 16:00:00").cast("timestamp_ntz"))
    return good.select("board_code", "stock_code", "stock_name", "source_order")


@query("unknown_boards", "", """
SELECT 'BK'||l_suppkey AS board_code, 'unknown_board' AS reason, count(DISTINCT l_partkey) AS found FROM lineitem JOIN supplier ON s_suppkey=l_suppkey WHERE s_acctbal<5000 GROUP BY l_suppkey""")
def unknown_boards(spark, sf):
    """Listings of suppliers with a low balance, which the catalog leaves out."""
    boards = st.table(spark, sf, "supplier").filter("s_acctbal >= 5000").select(
        F.concat(F.lit("BK"), F.col("s_suppkey").cast("string")).alias("board_code"), F.col("s_name").alias("board_name"),
        F.lit("concept").alias("board_type"), F.col("s_suppkey").alias("source_rank"))
    errors = qt.constituent_errors(_constituent_pages(spark, sf), boards)
    return errors.filter("reason = 'unknown_board'").select("board_code", "reason", "found")


@query("listing_errors", "", """
SELECT 'BK'||l_suppkey AS board_code, 'duplicate_code' AS reason, count(*) AS expected, count(*) AS found FROM lineitem GROUP BY l_suppkey HAVING count(*)>count(DISTINCT l_partkey)""")
def listing_errors(spark, sf):
    entries = qt.quote_entries(_constituent_pages(spark, sf), ["board_code"])
    return qt.listing_errors(entries, ["board_code"])


@query("read_calendar", "", """
SELECT DISTINCT strftime(o_orderdate,'%Y-%m-%d') AS date, CASE WHEN o_orderstatus='F' THEN 'holiday' ELSE 'workday' END AS kind FROM orders WHERE o_orderstatus<>'P'""")
def read_calendar(spark, sf):
    """Order dates as one calendar file per priority: F days off, O days worked."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    files = st.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", day)).alias("holidays"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", day)).alias("workdays"))
    good, _ = qt.read_calendar(files)
    return good.select(text("date"), "kind")


@query("calendar_errors", "", """
SELECT strftime(o_orderdate,'%Y-%m-%d') AS value, 'holiday_and_workday' AS reason FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus='F') AND bool_or(o_orderstatus='O')
UNION ALL SELECT DISTINCT o_orderpriority, 'invalid_date' FROM orders WHERE o_orderstatus='P'""")
def calendar_errors(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    off = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    files = st.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.collect_set(off).alias("holidays"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", day)).alias("workdays"))
    _, bad = qt.read_calendar(files)
    return bad


# -- exports -----------------------------------------------------------------

@query("series_csv", "points", """
SELECT CAST(d AS VARCHAR) AS trade_date, strftime(snapshot_at,'%Y-%m-%dT%H:%M:%S') AS snapshot_at, code, CAST(dark_money AS VARCHAR) AS dark_money, '0.00000000' AS change_pct FROM points WHERE rank_type='concept' AND code='BKclick' AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def series_csv(spark, sf):
    rows = st.money_points(spark, sf, boards_only=True).withColumn("rank", F.lit(1))
    return ex.series_csv(rows, "concept", "BKclick", "2024-01-05", "2024-01-12").select(
        "trade_date", "snapshot_at", "code", "dark_money", "change_pct")


@query("close_csv", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, CAST(rank AS VARCHAR) AS rank, CAST(CAST(round(open_price,4) AS DECIMAL(30,4)) AS VARCHAR) AS open_price, CAST(CAST(round(turnover_rate,8) AS DECIMAL(30,8)) AS VARCHAR) AS turnover_rate, CAST(quote_available AS VARCHAR) AS quote_available FROM daily""")
def close_csv(spark, sf):
    return ex.close_csv(st.daily_close(spark, sf)).select(
        "trade_date", "rank_type", "code", "rank", "open_price", "turnover_rate", "quote_available")


def _export_tables(spark, sf):
    days = st.sealed_dates(spark, sf)
    known = days.select("trade_date", F.concat(F.lit("rev-"), F.date_format("trade_date", "yyyyMMdd")).alias("revision_id"),
                        F.lit(1).alias("revision_no"), F.lit("x").alias("content_sha256"),
                        F.col("trade_date").cast("timestamp_ntz").alias("created_at"))
    daily = st.daily_close(spark, sf)
    labels = future_labels(daily, None, days, revisions=known)
    # Only days before the 20th are current.
    current = known.filter(F.col("trade_date") < F.lit("2024-01-20").cast("date"))
    return {"revisions": known, "current": current, "daily_close": daily, "future_labels": labels,
            "board_money_5m": st.money_points(spark, sf, boards_only=True)}


@query("export_labels", "rets", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, code, return_rate FROM rets WHERE signal_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND signal_date<DATE '2024-01-20' AND target_date<DATE '2024-01-20'""")
def export_labels(spark, sf):
    rows = ex.dataset("future_labels", _export_tables(spark, sf), "2024-01-05", "2024-01-25")
    return rows.select(text("signal_date"), "horizon", "rank_type", "code", "return_rate")


@query("export_label_history", "rets", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, code, return_rate FROM rets WHERE signal_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def export_label_history(spark, sf):
    rows = ex.dataset("future_label_history", _export_tables(spark, sf), "2024-01-05", "2024-01-25")
    return rows.select(text("signal_date"), "horizon", "rank_type", "code", "return_rate")


@query("export_closes", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, turnover FROM daily WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def export_closes(spark, sf):
    rows = ex.dataset("daily_close", _export_tables(spark, sf), "2024-01-05", "2024-01-25")
    return rows.select(text("trade_date"), "rank_type", "code", "turnover")


# -- stream forms on a batch -------------------------------------------------

@query("five_minute_samples", "ev", """
SELECT event_type, CAST(time_bucket(INTERVAL 5 MINUTE, ts - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS VARCHAR) AS bucket_start, CAST(arg_max(cents,row(ts)) AS BIGINT) AS cents FROM ev GROUP BY 1,2""")
def five_minute_samples(spark, sf):
    made = sb.five_minute_samples(st.events(spark, sf), ["event_type"], ["cents"], "ts")
    return made.select("event_type", instant("bucket_start"), "cents")


@query("stream_bars", "ev", """
SELECT event_type, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS VARCHAR) AS bucket_start, arg_min(value,event_id) AS open_price, max(value) AS high_price, min(value) AS low_price, arg_max(value,event_id) AS close_price, CAST(sum(cents) AS BIGINT) AS volume, count(*) AS tick_count FROM ev GROUP BY 1,2""")
def stream_bars(spark, sf):
    made = sb.stream_bars(st.events(spark, sf), ["event_type"], "value", "cents", ["event_id"])
    return made.withColumn("bucket_start", F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss"))


@query("latest_board", "points", """
SELECT rank_type, code, CAST(max(snapshot_at) AS VARCHAR) AS snapshot_at, arg_max(dark_money,snapshot_at) AS dark_money FROM points GROUP BY rank_type, code""")
def latest_board(spark, sf):
    return sb.latest_board(st.money_points(spark, sf)).select("rank_type", "code", instant("snapshot_at"), "dark_money")


@query("session_counts", "points", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, count(DISTINCT minute_index) AS minutes_seen, count(DISTINCT minute_index) AS points_seen, CAST(bool_or(minute_index=47) AS INTEGER) AS close_seen FROM points GROUP BY d, rank_type""")
def session_counts(spark, sf):
    return sb.session_counts(st.money_points(spark, sf)).select(
        text("trade_date"), "rank_type", "minutes_seen", "points_seen", "close_seen")


@query("on_grid_samples", "ev", """
SELECT event_id FROM ev WHERE minute(ts)%5=0 AND (hour(ts)*60+minute(ts) BETWEEN 575 AND 690 OR hour(ts)*60+minute(ts) BETWEEN 785 AND 900)""")
def on_grid_samples(spark, sf):
    return sb.on_grid_samples(st.events(spark, sf), "ts").select("event_id")


@query("late_rows", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code FROM daily WHERE d<=DATE '2024-01-20'""")
def late_rows(spark, sf):
    sealed = st.sealed_dates(spark, sf).filter(F.col("trade_date") <= F.lit("2024-01-20").cast("date"))
    _, late = sb.split_late(st.daily_close(spark, sf), sealed)
    return late.select(text("trade_date"), "rank_type", "code")


@query("recompute_scope", "idx", """
SELECT CAST(d AS VARCHAR) AS trade_date, date_idx FROM idx WHERE date_idx BETWEEN (SELECT date_idx FROM idx WHERE d=DATE '2024-01-15')-20 AND (SELECT date_idx FROM idx WHERE d=DATE '2024-01-15')+5""")
def recompute_scope(spark, sf):
    return sb.recompute_scope(st.sealed_dates(spark, sf), "2024-01-15", 20, 5).select(text("trade_date"), "date_idx")
