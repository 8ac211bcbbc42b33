"""Feature and label queries over the stand-in daily table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.ordinals import midrank_percentiles
from tidemark.operators import features as ft
from tidemark.operators import labels as lb
from tidemark.operators.calendar import with_date_index
from tidemark.operators.membership import primary_industry_by_date
from tidemark.plans import standin as st
from tidemark.session import stored
from tidemark.plans.registry import query, text
from tidemark.schemas import KEY

def keys():
    return [text("trade_date"), *KEY]


def _series(spark, sf):
    return with_date_index(ft.usable(st.daily_close(spark, sf)), st.sealed_dates(spark, sf))


def _industries(spark, sf, index):
    return primary_industry_by_date(*st.membership_tables(spark, sf, index, "industry"), index)


@query("usable_rows", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code, turnover FROM daily WHERE rank_type<>'stock' OR quote_available""")
def usable_rows(spark, sf):
    return ft.usable(st.daily_close(spark, sf)).select(*keys(), "turnover")


@query("cross_section_percentile", "use", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code,
 (CAST(rank() OVER (PARTITION BY d,rank_type ORDER BY -rank)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY d,rank_type,rank) AS DOUBLE)/2)/count(*) OVER (PARTITION BY d,rank_type) AS rank_percentile,
 (CAST(rank() OVER (PARTITION BY d,rank_type ORDER BY turnover)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY d,rank_type,turnover) AS DOUBLE)/2)/count(*) OVER (PARTITION BY d,rank_type) AS turnover_percentile,
 (CAST(rank() OVER (PARTITION BY d,rank_type ORDER BY dark_money)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY d,rank_type,dark_money) AS DOUBLE)/2)/count(*) OVER (PARTITION BY d,rank_type) AS dark_money_percentile
FROM use""")
def cross_section_percentile(spark, sf):
    rows = ft.usable(st.daily_close(spark, sf)).select("trade_date", *KEY, "rank", "turnover", "dark_money")
    rows = stored(rows)
    return ft.cross_section_percentiles(rows).select(
        *keys(), "rank_percentile", "turnover_percentile", "dark_money_percentile")


@query("balance_percentile_by_nation", "", """
SELECT c_custkey, c_nationkey,
 (CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(round(c_acctbal*100) AS BIGINT))-1 AS DOUBLE)
  +CAST(count(*) OVER (PARTITION BY c_nationkey, CAST(round(c_acctbal*100) AS BIGINT)) AS DOUBLE)/2)/count(*) OVER (PARTITION BY c_nationkey) AS balance_percentile
FROM customer""")
def balance_percentile_by_nation(spark, sf):
    rows = st.table(spark, sf, "customer").select("c_custkey", "c_nationkey", st.cents(F.col("c_acctbal")).alias("v"))
    return midrank_percentiles(rows, ["c_nationkey"], {"balance_percentile": "v"}).drop("v")


@query("price_percentile_by_flag", "", """
SELECT l_orderkey, l_linenumber, l_returnflag,
 (CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY CAST(round(l_extendedprice*100) AS BIGINT))-1 AS DOUBLE)
  +CAST(count(*) OVER (PARTITION BY l_returnflag, CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/2)/count(*) OVER (PARTITION BY l_returnflag) AS price_percentile
FROM lineitem""")
def price_percentile_by_flag(spark, sf):
    rows = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                  st.cents(F.col("l_extendedprice")).alias("v"))
    return midrank_percentiles(rows, ["l_returnflag"], {"price_percentile": "v"}).drop("v")


_SELF = ",\n".join(
    f"CASE WHEN count(*) OVER w{n}={n} AND date_idx-min(date_idx) OVER w{n}<=59 THEN "
    f"(len(list_filter(list(turnover) OVER w{n}, lambda x: x<turnover))+len(list_filter(list(turnover) OVER w{n}, lambda x: x=turnover))/2.0)/{n} END AS self_turnover_percentile_{n}"
    for n in (5, 10, 20, 60))
_SELF_WINDOWS = ", ".join(
    f"w{n} AS (PARTITION BY rank_type,market,code ORDER BY date_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    for n in (5, 10, 20, 60))


@query("self_percentile", "use", f"""
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code, {_SELF} FROM use WINDOW {_SELF_WINDOWS}""")
def self_percentile(spark, sf):
    rows = ft.self_percentiles(_series(spark, sf), "turnover", "self_turnover_percentile")
    return rows.select(*keys(), *[f"self_turnover_percentile_{n}" for n in ft.SELF_WINDOWS])


@query("rank_change", "use", """
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code, coalesce(p.rank-u.rank,0) AS rank_change_1
FROM use u LEFT JOIN use p ON p.rank_type=u.rank_type AND p.market=u.market AND p.code=u.code AND p.date_idx=u.date_idx-1""")
def rank_change(spark, sf):
    return _series(spark, sf).withColumn("rank_change_1", ft.rank_change()).select(*keys(), "rank_change_1")


@query("money_acceleration", "use", """
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code,
  coalesce(u.main_money_inflow-2*p.main_money_inflow+o.main_money_inflow,0) AS money_acceleration
FROM use u LEFT JOIN use p ON p.rank_type=u.rank_type AND p.market=u.market AND p.code=u.code AND p.date_idx=u.date_idx-1
LEFT JOIN use o ON o.rank_type=u.rank_type AND o.market=u.market AND o.code=u.code AND o.date_idx=u.date_idx-2""")
def money_acceleration(spark, sf):
    rows = _series(spark, sf).withColumn("money_acceleration", ft.second_difference("main_money_inflow"))
    return rows.select(*keys(), "money_acceleration")


_STREAK = """
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code,
  CAST(least(60, u.date_idx - coalesce((SELECT max(i.date_idx) FROM idx i WHERE i.date_idx<=u.date_idx AND NOT EXISTS
   (SELECT 1 FROM use p WHERE p.rank_type=u.rank_type AND p.market=u.market AND p.code=u.code AND p.date_idx=i.date_idx AND p.main_money_inflow>0)),-1)) AS INTEGER)
  AS consecutive_inflow_days FROM use u"""


@query("inflow_streak", "use", _STREAK)
def inflow_streak(spark, sf):
    rows = ft.add_streak(_series(spark, sf), "main_money_inflow", "consecutive_inflow_days")
    return rows.select(*keys(), "consecutive_inflow_days")


_CURVE = """
SELECT d, rank_type, market, code, list(dark_money ORDER BY minute_index) AS c FROM points GROUP BY d, rank_type, market, code HAVING count(*)=48"""
_MOVES = "list_transform(range(1,49), lambda i: CASE WHEN i=1 THEN c[1] ELSE c[i]-c[i-1] END)"
_SHAPE = f"""
SELECT d, rank_type, market, code,
 CASE WHEN c[48]<>0 THEN CAST(c[24] AS DOUBLE)/c[48] ELSE 0.0 END AS morning_dark_share,
 CASE WHEN c[48]<>0 THEN CAST(c[42]-c[24] AS DOUBLE)/c[48] ELSE 0.0 END AS afternoon_dark_share,
 CASE WHEN c[48]<>0 THEN CAST(c[48]-c[42] AS DOUBLE)/c[48] ELSE 0.0 END AS late_dark_share,
 CAST(list_position(m, list_max(m))-1 AS INTEGER) AS max_inflow_minute_index,
 CAST(list_position(m, list_min(m))-1 AS INTEGER) AS max_outflow_minute_index,
 m[48]-m[47] AS tail_acceleration,
 list_min(list_transform(range(1,49), lambda i: c[i]-list_max(c[1:i]))) AS max_dark_drawdown,
 list_max(c)>0 AND list_min(c)<0 AS intraday_reversal, c[48] AS final
FROM (SELECT *, {_MOVES} AS m FROM curve)"""


@query("curve_shape", "points", f""", curve AS ({_CURVE}), shape AS ({_SHAPE})
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code, * EXCLUDE (d, rank_type, market, code, final) FROM shape""")
def curve_shape(spark, sf):
    curves = ft.day_curves(st.money_points(spark, sf), ["trade_date", *KEY]).filter(F.col("curve").isNotNull())
    shaped = ft.curve_shape(curves)
    return shaped.select(*keys(), *[c for c in ft.CURVE_COLUMNS if c != "curve_available"])


@query("curve_available", "points", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code, count(*)=48 AS curve_available FROM points GROUP BY d, rank_type, market, code""")
def curve_available(spark, sf):
    shaped = ft.curve_shape(ft.day_curves(st.money_points(spark, sf), ["trade_date", *KEY]))
    return shaped.select(*keys(), "curve_available")


@query("price_money_divergence", "points daily", f""", curve AS ({_CURVE})
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code,
  coalesce(u.change_pct<>0 AND CAST(c.c[48] AS DOUBLE)*u.change_pct<0, false) AS price_money_divergence
FROM daily u LEFT JOIN curve c ON c.d=u.d AND c.rank_type=u.rank_type AND c.market=u.market AND c.code=u.code""")
def price_money_divergence(spark, sf):
    curves = ft.day_curves(st.money_points(spark, sf), ["trade_date", *KEY]).filter(F.col("curve").isNotNull())
    ends = curves.select("trade_date", *KEY, F.get("curve", F.lit(ft.LAST)).alias("_final"))  # one number a key is joined, not its array
    joined = st.daily_close(spark, sf).select("trade_date", *KEY, "change_pct").join(ends, ["trade_date", *KEY], "left")
    return joined.select(*keys(), ft.price_money_divergence(F.col("_final"), F.col("change_pct"))
                         .alias("price_money_divergence"))




@query("daily_features", "use points primary_ind", f""", curve AS ({_CURVE}), shape AS ({_SHAPE}), selfp AS (
 SELECT d, rank_type, market, code, {_SELF}, {_SELF.replace("turnover", "dark_money")} FROM use WINDOW {_SELF_WINDOWS}),
 streak AS ({_STREAK})
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code, u.name, coalesce(i.industry_code,'') AS primary_industry_code,
 CASE WHEN u.dark_money<0 THEN -u.dark_activity ELSE u.dark_activity END AS signed_dark_activity,
 CASE WHEN u.turnover<>0 THEN CAST(u.main_money_inflow AS DOUBLE)/u.turnover ELSE 0.0 END AS capital_intensity,
 CASE WHEN u.turnover<>0 THEN CAST(u.regular_money+u.dark_money AS DOUBLE)/u.turnover ELSE 0.0 END*100 AS control_coefficient,
 (CAST(rank() OVER (PARTITION BY u.d,u.rank_type ORDER BY -u.rank)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY u.d,u.rank_type,u.rank) AS DOUBLE)/2)/count(*) OVER (PARTITION BY u.d,u.rank_type) AS rank_percentile,
 (CAST(rank() OVER (PARTITION BY u.d,u.rank_type ORDER BY u.turnover)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY u.d,u.rank_type,u.turnover) AS DOUBLE)/2)/count(*) OVER (PARTITION BY u.d,u.rank_type) AS turnover_percentile,
 (CAST(rank() OVER (PARTITION BY u.d,u.rank_type ORDER BY u.dark_money)-1 AS DOUBLE)+CAST(count(*) OVER (PARTITION BY u.d,u.rank_type,u.dark_money) AS DOUBLE)/2)/count(*) OVER (PARTITION BY u.d,u.rank_type) AS dark_money_percentile,
 s.* EXCLUDE (d, rank_type, market, code), coalesce(p1.rank-u.rank,0) AS rank_change_1, k.consecutive_inflow_days,
 coalesce(u.main_money_inflow-2*p1.main_money_inflow+p2.main_money_inflow,0) AS money_acceleration,
 h.d IS NOT NULL AS curve_available, coalesce(h.morning_dark_share,0.0) AS morning_dark_share,
 coalesce(h.afternoon_dark_share,0.0) AS afternoon_dark_share, coalesce(h.late_dark_share,0.0) AS late_dark_share,
 coalesce(h.max_inflow_minute_index,-1) AS max_inflow_minute_index, coalesce(h.max_outflow_minute_index,-1) AS max_outflow_minute_index,
 coalesce(h.tail_acceleration,0) AS tail_acceleration, coalesce(h.max_dark_drawdown,0) AS max_dark_drawdown,
 coalesce(h.intraday_reversal,false) AS intraday_reversal,
 coalesce(u.change_pct<>0 AND CAST(h.final AS DOUBLE)*u.change_pct<0, false) AS price_money_divergence
FROM use u LEFT JOIN primary_ind i ON u.rank_type='stock' AND i.stock_code=u.code AND i.d=u.d
LEFT JOIN selfp s ON s.d=u.d AND s.rank_type=u.rank_type AND s.market=u.market AND s.code=u.code
LEFT JOIN streak k ON k.trade_date=CAST(u.d AS VARCHAR) AND k.rank_type=u.rank_type AND k.market=u.market AND k.code=u.code
LEFT JOIN shape h ON h.d=u.d AND h.rank_type=u.rank_type AND h.market=u.market AND h.code=u.code
LEFT JOIN use p1 ON p1.rank_type=u.rank_type AND p1.market=u.market AND p1.code=u.code AND p1.date_idx=u.date_idx-1
LEFT JOIN use p2 ON p2.rank_type=u.rank_type AND p2.market=u.market AND p2.code=u.code AND p2.date_idx=u.date_idx-2""")
def daily_features(spark, sf):
    index = st.sealed_dates(spark, sf)
    made = ft.daily_features(stored(st.daily_close(spark, sf)), st.money_points(spark, sf),
                             _industries(spark, sf, index), index)
    return made.withColumn("trade_date", F.col("trade_date").cast("string"))


@query("features_of_a_slice", "use", """
SELECT CAST(u.d AS VARCHAR) AS trade_date, u.rank_type, u.market, u.code, coalesce(p.rank-u.rank,0) AS rank_change_1
FROM use u LEFT JOIN use p ON p.rank_type=u.rank_type AND p.market=u.market AND p.code=u.code AND p.date_idx=u.date_idx-1
WHERE u.d>=DATE '2024-01-20'""")
def features_of_a_slice(spark, sf):
    made = ft.daily_features(stored(st.daily_close(spark, sf)), st.money_points(spark, sf), None, st.sealed_dates(spark, sf),
                             first="2024-01-20")
    return made.select(*keys(), "rank_change_1")


@query("feature_scalars", "use", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code,
 CASE WHEN dark_money<0 THEN -dark_activity ELSE dark_activity END AS signed_dark_activity,
 CASE WHEN turnover<>0 THEN CAST(main_money_inflow AS DOUBLE)/turnover ELSE 0.0 END AS capital_intensity,
 CASE WHEN turnover<>0 THEN CAST(regular_money+dark_money AS DOUBLE)/turnover ELSE 0.0 END*100 AS control_coefficient FROM use""")
def feature_scalars(spark, sf):
    return ft.usable(st.daily_close(spark, sf)).select(
        *keys(), ft.signed_activity().alias("signed_dark_activity"), ft.capital_intensity().alias("capital_intensity"),
        ft.control_coefficient().alias("control_coefficient"))


@query("read_features", "use", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code,
 CASE WHEN turnover<>0 THEN CAST(main_money_inflow AS DOUBLE)/turnover ELSE 0.0 END AS capital_intensity FROM use WHERE rank_type='concept'""")
def read_features(spark, sf):
    rows = ft.usable(st.daily_close(spark, sf)).withColumn("capital_intensity", ft.capital_intensity())
    return ft.read_features(rows, rank_type="concept").select(*keys(), "capital_intensity")


# -- labels ------------------------------------------------------------------

def label_keys():
    return [text("signal_date"), "horizon", *KEY]


@query("forward_return", "use", """
SELECT CAST(s.d AS VARCHAR) AS signal_date, h.horizon, s.rank_type, s.market, s.code, t.close_price/s.close_price-1 AS return_rate
FROM use s CROSS JOIN (SELECT unnest([1,3,5,10,20]) AS horizon) h
JOIN use t ON t.rank_type=s.rank_type AND t.market=s.market AND t.code=s.code AND t.date_idx=s.date_idx+h.horizon
WHERE s.close_price>0 AND t.close_price>0""")
def forward_return(spark, sf):
    rows = lb.forward_returns(_series(spark, sf).select("trade_date", "date_idx", *KEY, "close_price"))
    return rows.withColumnRenamed("trade_date", "signal_date").select(*label_keys(), "return_rate")


@query("favorable_adverse", "rets", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, market, code, max_favorable_return, max_adverse_return FROM rets""")
def favorable_adverse(spark, sf):
    rows = lb.forward_returns(_series(spark, sf).select("trade_date", "date_idx", *KEY, "close_price"))
    return rows.withColumnRenamed("trade_date", "signal_date").select(
        *label_keys(), "max_favorable_return", "max_adverse_return")


@query("future_labels", "labels", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, CAST(target_date AS VARCHAR) AS target_date, horizon, rank_type, market, code,
 return_rate, relative_industry_return, max_favorable_return, max_adverse_return FROM labels""")
def future_labels(spark, sf):
    index = st.sealed_dates(spark, sf)
    made = lb.future_labels(stored(st.daily_close(spark, sf)), _industries(spark, sf, index), index)
    return made.select(*label_keys(), text("target_date"), "return_rate", "relative_industry_return",
                       "max_favorable_return", "max_adverse_return")


@query("relabel_after_reseal", "labels idx", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, market, code, return_rate FROM labels
WHERE date_idx BETWEEN (SELECT date_idx FROM idx WHERE d=DATE '2024-01-15')-20 AND (SELECT date_idx FROM idx WHERE d=DATE '2024-01-15')""")
def relabel_after_reseal(spark, sf):
    made = lb.future_labels(st.daily_close(spark, sf), None, st.sealed_dates(spark, sf), changed="2024-01-15")
    return made.select(*label_keys(), "return_rate")


@query("industry_relative", "labels", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, market, code, relative_industry_return FROM labels
WHERE rank_type='stock' AND relative_industry_return IS NOT NULL""")
def industry_relative(spark, sf):
    index = st.sealed_dates(spark, sf)
    made = lb.future_labels(stored(st.daily_close(spark, sf)), _industries(spark, sf, index), index)
    return made.filter((F.col("rank_type") == "stock") & F.col("relative_industry_return").isNotNull()).select(
        *label_keys(), "relative_industry_return")


def revisions(spark, sf):
    """One revision per sealed day."""
    return st.sealed_dates(spark, sf).select(
        "trade_date", F.concat(F.lit("rev-"), F.date_format("trade_date", "yyyyMMdd")).alias("revision_id"),
        F.lit(1).alias("revision_no"), F.lit(None).cast("string").alias("previous_revision_id"))


@query("current_labels", "rets idx", """
SELECT CAST(signal_date AS VARCHAR) AS signal_date, horizon, rank_type, market, code,
 'rev-'||strftime(target_date,'%Y%m%d') AS target_revision_id, return_rate
FROM rets JOIN idx ON idx.d=rets.target_date WHERE horizon=5 AND rets.target_date<DATE '2024-01-20'""")
def current_labels(spark, sf):
    made = lb.future_labels(st.daily_close(spark, sf), None, st.sealed_dates(spark, sf),
                            revisions=revisions(spark, sf))
    # Days from the 20th on were sealed under another id since.
    current = revisions(spark, sf).withColumn(
        "revision_id", F.when(F.col("trade_date") >= F.lit("2024-01-20").cast("date"), F.concat("revision_id", F.lit("b")))
        .otherwise(F.col("revision_id")))
    return lb.current_labels(made, current, horizon=5).select(*label_keys(), "target_revision_id", "return_rate")
