"""Read-side, calendar and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import grid as gr
from tidemark.functions import scalars as sx
from tidemark.operators import calendar as cal
from tidemark.operators import views as vw
from tidemark.operators.membership import members_as_of
from tidemark.plans import standin as st
from tidemark.plans.archive_queries import research
from tidemark.plans.registry import instant, query, text

# -- pages and orders --------------------------------------------------------


@query("close_page", "daily", """
SELECT rank, code, name, turnover FROM (SELECT *, row_number() OVER (ORDER BY turnover DESC, rank, code, d) AS n FROM daily WHERE rank_type='stock') WHERE n BETWEEN 101 AND 150""")
def close_page(spark, sf):
    page, _ = vw.close_page(st.daily_close(spark, sf), "stock", sort="turnover", descending=True, page=3, size=50)
    return page.select("rank", "code", "name", "turnover")


@query("close_page_search", "daily", """
SELECT code, name, dark_money, CAST(d AS VARCHAR) AS trade_date FROM (SELECT *, row_number() OVER (ORDER BY dark_money DESC, rank, code, d) AS n FROM daily WHERE rank_type='stock' AND (contains(lower(name),'u1') OR contains(lower(code),'u1'))) WHERE n<=40""")
def close_page_search(spark, sf):
    page, _ = vw.close_page(st.daily_close(spark, sf), "stock", search="u1", sort="dark_money", descending=True, size=40)
    return page.select("code", "name", "dark_money", text("trade_date"))


@query("close_page_total", "daily", """
SELECT count(*) AS total FROM daily WHERE rank_type='stock' AND (contains(lower(name),'u1') OR contains(lower(code),'u1'))""")
def close_page_total(spark, sf):
    _, total = vw.close_page(st.daily_close(spark, sf), "stock", search="U1")
    return total


@query("part_page", "", """
SELECT p_partkey, p_name, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_size, CAST(p_partkey AS VARCHAR)) AS n FROM part WHERE contains(lower(p_name),'red')) WHERE n BETWEEN 21 AND 40""")
def part_page(spark, sf):
    rows = st.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name"), F.col("p_retailprice"), F.col("p_name").alias("name"),
        F.col("p_partkey").cast("string").alias("code"), F.col("p_size").alias("rank"),
        F.col("p_retailprice").alias("close_price"), F.lit("stock").alias("rank_type"), F.lit(None).alias("trade_date"))
    page, _ = vw.close_page(rows, "stock", search="red", sort="close_price", descending=True, page=2, size=20)
    return page.select("p_partkey", "p_name", "p_retailprice")


@query("daily_listing", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, CASE rank_type WHEN 'industry' THEN 1 WHEN 'concept' THEN 2 ELSE 3 END AS type_order, code, rank FROM daily""")
def daily_listing(spark, sf):
    return vw.daily_listing(st.daily_close(spark, sf)).select(
        text("trade_date"), vw.type_order().alias("type_order"), "code", "rank")


@query("pick_codes", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, code, rank FROM daily WHERE rank_type='stock' AND code IN ('600001','600002','600003','600149')""")
def pick_codes(spark, sf):
    picked = vw.pick_codes(st.daily_close(spark, sf), ["600001", "600002", "600003", "600149", "", "600001"])
    return picked.select(text("trade_date"), "code", "rank")


@query("pick_codes_joined", "daily quotes", """
SELECT CAST(d AS VARCHAR) AS trade_date, code, rank FROM daily WHERE rank_type='stock' AND code IN (SELECT code FROM quotes WHERE latest_price>=150)""")
def pick_codes_joined(spark, sf):
    wanted = st.purchase_quotes(spark, sf).filter("latest_price >= 150").select("code")
    return vw.pick_codes(st.daily_close(spark, sf), wanted).select(text("trade_date"), "code", "rank")


@query("available_first", "daily", """
SELECT code, rank_type, dark_money, money_available FROM daily""")
def available_first(spark, sf):
    return vw.available_first(st.daily_close(spark, sf), "money_available", "dark_money", True).select(
        "code", "rank_type", "dark_money", "money_available")


@query("latest_snapshot", "points", """
SELECT p.rank_type, p.code, CAST(p.snapshot_at AS VARCHAR) AS snapshot_at, dark_money FROM points p
JOIN (SELECT rank_type, max(snapshot_at) AS m FROM points GROUP BY rank_type) x ON x.rank_type=p.rank_type AND x.m=p.snapshot_at""")
def latest_snapshot(spark, sf):
    rows = st.money_points(spark, sf).withColumn("rank", F.col("dark_money"))
    return vw.latest_snapshot(rows).select("rank_type", "code", instant("snapshot_at"), "dark_money")


def _boards(spark, sf):
    """Working set: days from 2024-01-25 on.  Curve: earlier days.  Close: all days."""
    cut = F.lit("2024-01-25").cast("date")
    points = st.money_points(spark, sf, boards_only=True).withColumn("rank", F.lit(1).cast("bigint"))
    points = points.select("trade_date", "rank_type", "code", "rank", "snapshot_at", "dark_money")
    closes = (st.daily_close(spark, sf).filter(F.col("rank_type") != "stock")
              .select("trade_date", "rank_type", "code", "rank", "snapshot_at", "dark_money"))
    return points.filter(F.col("trade_date") >= cut), points.filter(F.col("trade_date") < cut), closes


@query("latest_rank", "points", """
SELECT rank_type, code, CAST(snapshot_at AS VARCHAR) AS snapshot_at, dark_money FROM points p WHERE rank_type<>'stock' AND d>=DATE '2024-01-25'
AND snapshot_at=(SELECT max(snapshot_at) FROM points q WHERE q.rank_type=p.rank_type AND q.d>=DATE '2024-01-25')""")
def latest_rank(spark, sf):
    work, _, closes = _boards(spark, sf)
    return vw.latest_rank(work, closes).select("rank_type", "code", instant("snapshot_at"), "dark_money")


@query("rank_at", "points", """
SELECT rank_type, code, dark_money FROM points WHERE rank_type<>'stock' AND snapshot_at=TIMESTAMP '2024-01-10 10:30:00'""")
def rank_at(spark, sf):
    at = F.lit("2024-01-10 10:30:00").cast("timestamp_ntz")
    return vw.rank_at(*_boards(spark, sf), at).select("rank_type", "code", "dark_money")


@query("rank_at_close", "daily", """
SELECT rank_type, code, dark_money FROM daily WHERE rank_type<>'stock' AND d=DATE '2024-01-10'""")
def rank_at_close(spark, sf):
    at = F.lit("2024-01-10 15:00:00").cast("timestamp_ntz")
    return vw.rank_at(*_boards(spark, sf), at).select("rank_type", "code", "dark_money")


@query("first_non_empty", "points daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, CAST(snapshot_at AS VARCHAR) AS snapshot_at, dark_money FROM points WHERE rank_type<>'stock'
UNION ALL SELECT CAST(d AS VARCHAR), rank_type, code, CAST(snapshot_at AS VARCHAR), dark_money FROM daily u WHERE rank_type<>'stock' AND NOT EXISTS (SELECT 1 FROM points p WHERE p.d=u.d AND p.rank_type=u.rank_type AND p.code=u.code)""")
def first_non_empty(spark, sf):
    chosen = vw.first_non_empty(_boards(spark, sf), ["trade_date", "rank_type", "code"])
    return chosen.select(text("trade_date"), "rank_type", "code", instant("snapshot_at"), "dark_money")


@query("day_series", "points daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, CAST(snapshot_at AS VARCHAR) AS snapshot_at, dark_money FROM points WHERE rank_type<>'stock'
UNION ALL SELECT CAST(d AS VARCHAR), rank_type, code, CAST(snapshot_at AS VARCHAR), dark_money FROM daily u WHERE rank_type<>'stock' AND NOT EXISTS (SELECT 1 FROM points p WHERE p.d>=DATE '2024-01-25' AND p.d=u.d AND p.rank_type=u.rank_type AND p.code=u.code)""")
def day_series(spark, sf):
    return vw.day_series(*_boards(spark, sf)).select(
        text("trade_date"), "rank_type", "code", instant("snapshot_at"), "dark_money")


@query("time_range", "ev", """
SELECT event_id FROM ev WHERE ts>=TIMESTAMP '2024-01-05' AND ts<TIMESTAMP '2024-01-13'""")
def time_range(spark, sf):
    return vw.time_range(st.events(spark, sf), "2024-01-05", "2024-01-12", "ts").select("event_id")


@query("range_series", "points", """
SELECT CAST(snapshot_at AS VARCHAR) AS snapshot_at, dark_money FROM points WHERE rank_type='concept' AND code='BKview' AND snapshot_at>=TIMESTAMP '2024-01-05 10:00:00' AND snapshot_at<TIMESTAMP '2024-01-13'""")
def range_series(spark, sf):
    rows = st.money_points(spark, sf, boards_only=True).withColumn("rank", F.lit(1))
    return vw.range_series(rows, "concept", "BKview", "2024-01-05 10:00:00", "2024-01-12").select(
        instant("snapshot_at"), "dark_money")


@query("stock_series", "research", """
SELECT CAST(d AS VARCHAR) AS trade_date, code, minute_index, strftime(CAST(d AS TIMESTAMP)+to_minutes(CASE WHEN minute_index<24 THEN 570+(minute_index+1)*5 ELSE 780+(minute_index-23)*5 END),'%H:%M') AS clock,
 CAST(close_price_e4 AS DOUBLE)/10000 AS close_price, dark_money, kline_available FROM research""")
def stock_series(spark, sf):
    return vw.stock_series(research(spark, sf)).select(
        text("trade_date"), "code", "minute_index", "clock", "close_price", "dark_money", "kline_available")


@query("series_meta", "ev", """
SELECT event_type, CAST(d AS VARCHAR) AS trade_date, count(*) AS point_count, CASE WHEN bool_or(minute(ts)%5<>0) THEN '1m' WHEN bool_or(hour(ts)=15 AND minute(ts)=0) THEN '5m+close' ELSE '5m' END AS interval,
 count(*) FILTER (minute(ts)%5=0 AND NOT (hour(ts)=15 AND minute(ts)=0)) AS research_points, CAST(bool_or(hour(ts)=15 AND minute(ts)=0) AS INTEGER) AS daily_close_points FROM ev GROUP BY event_type, d""")
def series_meta(spark, sf):
    rows = st.events(spark, sf).select("event_type", "trade_date", F.col("ts").alias("snapshot_at"),
                                       F.lit("150000").alias("quote_time"))
    return vw.series_meta(rows, ["event_type", "trade_date"]).withColumn("trade_date", F.col("trade_date").cast("string"))


@query("series_delta", "points", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, arg_max(dark_money,snapshot_at)-arg_min(dark_money,snapshot_at) AS delta, count(*) AS points FROM points GROUP BY d, rank_type, code""")
def series_delta(spark, sf):
    made = vw.series_delta(st.money_points(spark, sf), ["trade_date", "rank_type", "code"])
    return made.withColumn("trade_date", F.col("trade_date").cast("string"))


@query("available_metric", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, code, CASE WHEN money_available THEN dark_money END AS dark_money, CASE WHEN rank>0 THEN dark_activity END AS dark_activity, close_price FROM daily""")
def available_metric(spark, sf):
    return st.daily_close(spark, sf).select(
        text("trade_date"), "rank_type", "code",
        *[vw.available_metric(m).alias(m) for m in ("dark_money", "dark_activity", "close_price")])


@query("stitch_cumulative", "points", """, last AS (SELECT d, rank_type, code, arg_max(dark_money,snapshot_at) AS l FROM points GROUP BY d, rank_type, code)
SELECT CAST(p.d AS VARCHAR) AS trade_date, p.rank_type, p.code, p.minute_index, p.dark_money + CAST(coalesce((SELECT sum(l) FROM last x WHERE x.rank_type=p.rank_type AND x.code=p.code AND x.d<p.d),0) AS BIGINT) AS stitched FROM points p""")
def stitch_cumulative(spark, sf):
    made = vw.stitch_cumulative(st.money_points(spark, sf), ["rank_type", "code"], "dark_money", "stitched")
    return made.select(text("trade_date"), "rank_type", "code", "minute_index", "stitched")


@query("constituent_board", "scans quotes daily", """
SELECT s.board_code, s.stock_code, coalesce(q.latest_price,0) AS latest_price, CASE WHEN coalesce(q.turnover,0)=0 THEN coalesce(u.turnover,0) ELSE q.turnover END AS turnover,
 CASE WHEN coalesce(q.open_price,0)=0 THEN coalesce(u.high_price,0) ELSE q.high_price END AS high_price, coalesce(u.rank,0) AS dark_rank, coalesce(u.dark_money,0) AS dark_money, u.code IS NOT NULL AS dark_data_available
FROM (SELECT * FROM scans WHERE d=DATE '2024-01-17') s LEFT JOIN (SELECT * FROM quotes WHERE d=DATE '2024-01-17') q ON q.code=s.stock_code
LEFT JOIN (SELECT * FROM daily WHERE d=DATE '2024-01-17' AND rank_type='stock') u ON u.code=s.stock_code""")
def constituent_board(spark, sf):
    day = F.col("trade_date") == F.lit("2024-01-17").cast("date")
    held = members_as_of(*st.membership_tables(spark, sf), "2024-01-17")
    made = vw.constituent_board(held, st.purchase_quotes(spark, sf).filter(day), st.daily_close(spark, sf).filter(day))
    return made.select("board_code", "stock_code", "latest_price", "turnover", "high_price", "dark_rank", "dark_money",
                       "dark_data_available")


@query("enrich_orders_with_balance", "", """
SELECT o_orderkey, CASE WHEN coalesce(c_acctbal,0)<=0 THEN o_totalprice ELSE c_acctbal END AS amount, c_custkey IS NOT NULL AND c_acctbal>0 AS known FROM orders LEFT JOIN customer ON c_custkey=o_custkey""")
def enrich_orders(spark, sf):
    """Zero or missing balances fall back to the order's own price, as quote fields do."""
    customers = st.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                       sx.positive_double(F.col("c_acctbal")).alias("_b"))
    orders = st.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(customers, "o_custkey", "left").select(
        "o_orderkey", F.coalesce("_b", "o_totalprice").alias("amount"), F.col("_b").isNotNull().alias("known"))


# -- calendar ----------------------------------------------------------------

def _exceptions(spark, sf):
    """Days without a large purchase are holidays; weekend days with one are workdays."""
    days = st.events(spark, sf).groupBy(F.col("trade_date").alias("date")).agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("top"))
    weekend = F.weekday("date") >= 5
    return days.select("date", F.when(weekend & (F.col("top") >= 100), "workday").when(F.col("top") < 150, "holiday")
                       .alias("kind")).filter(F.col("kind").isNotNull())


_TRADING = """rule AS (SELECT d, max(value) FILTER (event_type='purchase') AS top FROM ev GROUP BY d),
cal AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) t(x)),
tr AS (SELECT date, CASE WHEN isodow(date)>=6 AND top>=100 THEN true WHEN top<150 THEN false ELSE isodow(date)<6 END AS is_trading FROM cal LEFT JOIN rule ON rule.d=cal.date)"""


def _dimension(spark, sf):
    import datetime as dt

    return cal.date_dimension(spark, dt.date(2023, 12, 25), dt.date(2024, 2, 10), _exceptions(spark, sf))


@query("trading_days", "ev", ", " + _TRADING + " SELECT CAST(date AS VARCHAR) AS date, is_trading FROM tr")
def trading_days(spark, sf):
    return _dimension(spark, sf).select(text("date"), "is_trading")


@query("neighbour_trading_days", "ev", ", " + _TRADING + """
SELECT CAST(date AS VARCHAR) AS date, CAST((SELECT max(y.date) FROM tr y WHERE y.is_trading AND y.date<=tr.date) AS VARCHAR) AS latest,
 CAST((SELECT max(y.date) FROM tr y WHERE y.is_trading AND y.date<tr.date) AS VARCHAR) AS previous FROM tr""")
def neighbour_trading_days(spark, sf):
    return cal.neighbour_trading_days(_dimension(spark, sf)).select(text("date"), text("latest"), text("previous"))


@query("mark_trading", "ev", ", " + _TRADING + """
SELECT ev.event_id, tr.is_trading FROM ev JOIN tr ON tr.date=ev.d""")
def mark_trading(spark, sf):
    return cal.mark_trading(st.events(spark, sf), "trade_date", _exceptions(spark, sf)).select("event_id", "is_trading")


@query("market_phase", "ev", ", " + _TRADING + """
SELECT ev.event_id, CASE WHEN NOT is_trading THEN 'closed' WHEN m<570 THEN 'pre_open' WHEN m<=690 OR m BETWEEN 780 AND 900 THEN 'open' WHEN m<780 THEN 'lunch_break' ELSE 'closed' END AS phase
FROM (SELECT *, hour(ts)*60+minute(ts) AS m FROM ev) ev JOIN tr ON tr.date=ev.d""")
def market_phase(spark, sf):
    rows = cal.mark_trading(st.events(spark, sf), "trade_date", _exceptions(spark, sf))
    return rows.select("event_id", cal.market_phase(sx.clock_minute(F.col("ts")), F.col("is_trading")).alias("phase"))


@query("calendar_coverage", "", """
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days_remaining, CAST(o_orderdate AS DATE)>DATE '1998-12-31' AS expired FROM orders""")
def calendar_coverage(spark, sf):
    state = cal.calendar_coverage(F.lit("1998-12-31"), F.to_date("o_orderdate"))
    return st.table(spark, sf, "orders").select("o_orderkey", state.alias("s")).select("o_orderkey", "s.*")


@query("date_index", "idx", "SELECT CAST(d AS VARCHAR) AS trade_date, date_idx FROM idx")
def date_index(spark, sf):
    return st.sealed_dates(spark, sf).select(text("trade_date"), "date_idx")


@query("session_grid", "ev", """
SELECT event_type, lpad(CAST(m//60 AS VARCHAR),2,'0')||':'||lpad(CAST(m%60 AS VARCHAR),2,'0') AS clock, count(e.event_id) AS seen
FROM (SELECT DISTINCT event_type, unnest(range(571,691)||range(781,901)) AS m FROM ev) g LEFT JOIN (SELECT event_id, event_type AS et, hour(ts)*60+minute(ts) AS em FROM ev) e ON e.et=g.event_type AND e.em=g.m GROUP BY event_type, m""")
def session_grid(spark, sf):
    """Events per expected session minute and type, zero where there are none."""
    rows = st.events(spark, sf).withColumn("minute", sx.clock_minute(F.col("ts")))
    grid = rows.select("event_type").distinct().select("event_type", F.explode(gr.grid_array(1)).alias("minute"))
    counts = rows.groupBy("event_type", "minute").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["event_type", "minute"], "left").select(
        "event_type", sx.clock_text(F.col("minute")).alias("clock"), F.coalesce("n", F.lit(0)).alias("seen"))


@query("fill_timeline", "points", """
SELECT CAST(g.d AS VARCHAR) AS trade_date, g.rank_type, g.code, lpad(CAST(m//60 AS VARCHAR),2,'0')||':'||lpad(CAST(m%60 AS VARCHAR),2,'0') AS clock, p.dark_money
FROM (SELECT k.d, k.rank_type, k.code, unnest(CASE WHEN c.closed THEN range(575,691,5)||range(785,901,5) ELSE range(575,691,5)||range(785,896,5) END) AS m
 FROM (SELECT DISTINCT d, rank_type, code FROM points) k JOIN (SELECT rank_type, code, bool_or(minute_index=47) AS closed FROM points GROUP BY rank_type, code) c ON c.rank_type=k.rank_type AND c.code=k.code) g
LEFT JOIN points p ON p.d=g.d AND p.rank_type=g.rank_type AND p.code=g.code AND hour(p.snapshot_at)*60+minute(p.snapshot_at)=g.m""")
def fill_timeline(spark, sf):
    made = cal.fill_timeline(st.money_points(spark, sf), ["rank_type", "code"], ["dark_money"])
    return made.select(text("trade_date"), "rank_type", "code", "clock", "dark_money")


# -- scalars -----------------------------------------------------------------

@query("grid_positions", "ev", """
SELECT event_id, CASE WHEN m%5=0 AND m BETWEEN 575 AND 690 THEN (m-575)//5 WHEN m%5=0 AND m BETWEEN 785 AND 900 THEN 24+(m-785)//5 END AS point_index,
 CASE WHEN m=570 THEN 0 WHEN m BETWEEN 571 AND 690 THEN (m-571)//5 WHEN m BETWEEN 781 AND 900 THEN 24+(m-781)//5 END AS bar_index,
 (m BETWEEN 571 AND 690) OR (m BETWEEN 781 AND 900) AS on_minutes FROM (SELECT event_id, hour(ts)*60+minute(ts) AS m FROM ev)""")
def grid_positions(spark, sf):
    minute = sx.clock_minute(F.col("ts"))
    return st.events(spark, sf).select("event_id", gr.point_index(minute).alias("point_index"),
                                       gr.bar_index(minute).alias("bar_index"), gr.on_minute_grid(minute).alias("on_minutes"))


@query("fixed_point", "", """
SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice*10000) AS BIGINT) AS e4, CAST(round(l_discount*1000000) AS BIGINT) AS ppm, CAST(CAST(round(l_extendedprice*10000) AS BIGINT) AS DOUBLE)/10000 AS back FROM lineitem""")
def fixed_point(spark, sf):
    price = F.col("l_extendedprice")
    return st.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", sx.scale_e4(price).alias("e4"), sx.scale_ppm(F.col("l_discount")).alias("ppm"),
        sx.unscale_e4(sx.scale_e4(price)).alias("back"))


@query("lenient_numbers", "", """
SELECT o_orderkey, coalesce(CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT), 0) AS whole, coalesce(TRY_CAST(raw AS DOUBLE),0) AS real_, coalesce(TRY_CAST(split_part(raw,'.',1) AS BIGINT),0) AS head,
 coalesce(TRY_CAST(regexp_extract(raw,'^([0-9]+)',1) AS BIGINT),0) AS prefix FROM (SELECT o_orderkey,
 CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) WHEN 'O' THEN CAST(o_custkey AS VARCHAR)||'.5' ELSE o_orderpriority END AS raw FROM orders)""")
def lenient_numbers(spark, sf):
    raw = (F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string"))
           .when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
           .otherwise(F.col("o_orderpriority")))
    r = F.col("raw")
    return st.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", sx.long_or_zero(r).alias("whole"), sx.double_or_zero(r).alias("real_"),
        sx.leading_long(r).alias("head"), sx.numeric_prefix(r).alias("prefix"))


@query("epoch_instants", "ev", """
SELECT event_id, strftime(make_timestamp(CAST(epoch(date_trunc('second',ts)) AS BIGINT)*1000000),'%Y-%m-%dT%H:%M:%SZ') AS from_seconds, strftime(make_timestamp(CAST(epoch(date_trunc('second',ts)) AS BIGINT)*1000000),'%Y-%m-%dT%H:%M:%SZ') AS from_millis,
 event_type AS kept, strftime(ts,'%Y-%m-%d') AS quote_date FROM ev""")
def epoch_instants(spark, sf):
    rows = st.events(spark, sf)
    origin = F.lit("1970-01-01").cast("date")
    seconds = (F.datediff("trade_date", origin).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
               + F.second("ts"))
    return rows.select("event_id", sx.epoch_to_text(seconds.cast("string")).alias("from_seconds"),
                       sx.epoch_to_text((seconds * 1000 + 7).cast("string")).alias("from_millis"),
                       sx.epoch_to_text(F.col("event_type")).alias("kept"),
                       sx.quote_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("string").alias("quote_date"))


@query("dates_and_clocks", "", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS compact, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso, CASE WHEN length(CAST(o_custkey AS VARCHAR))>6 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR),6,'0') END AS clock,
 CAST(sign(o_totalprice-250000) AS INTEGER) AS sign_, abs(o_totalprice-round(o_totalprice,0))<=0.0001 AS same FROM orders""")
def dates_and_clocks(spark, sf):
    price = F.col("o_totalprice")
    return st.table(spark, sf, "orders").select(
        "o_orderkey", sx.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("compact"),
        sx.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("iso"),
        sx.six_digit_clock(F.col("o_custkey")).alias("clock"), sx.sign_of(price - 250000).alias("sign_"),
        sx.same_price(price, F.round(price, 0)).alias("same"))


@query("json_round_trip", "ev", "SELECT event_id, k, '{\"k\":'||k||'}' AS packed FROM ev")
def json_round_trip(spark, sf):
    parsed = F.from_json("props", "map<string,bigint>")
    return st.table(spark, sf, "events").select(
        "event_id", F.element_at(parsed, "k").alias("k"), F.to_json(parsed).alias("packed"))


@query("decode_documents", "", "SELECT doc_id, text FROM documents")
def decode_documents(spark, sf):
    """Whole texts through bytes: UTF-8 is taken as it is."""
    return st.table(spark, sf, "documents").select("doc_id", sx.decode_text(F.col("text").cast("binary")).alias("text"))
