"""The stand-in tables as SQL common table expressions for the DuckDB oracle."""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
SELECT event_id, ts, user_id, event_type, value, CAST(round(value*100) AS BIGINT) AS cents, CAST(ts AS DATE) AS d,
  CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
  CASE WHEN event_type IN ('error','view') THEN -1 ELSE 1 END AS sgn,
  CAST((hour(ts)*60+minute(ts))//30 AS INTEGER) AS bucket,
  CAST(user_id+600000 AS VARCHAR) AS scode, CAST(CASE WHEN user_id%5=0 THEN 0 ELSE 1 END AS BIGINT) AS smarket,
  CASE WHEN user_id%11=0 THEN '*ST U' ELSE 'U' END || user_id AS sname
FROM events"""),
    "ent": (("ev",), """
SELECT *, 'stock' AS rank_type, smarket AS market, scode AS code, sname AS name FROM ev
UNION ALL SELECT *, 'concept', 90, 'BK'||event_type, event_type FROM ev
UNION ALL SELECT *, 'industry', 90, 'IND'||(k%7), 'IND'||(k%7) FROM ev"""),
    "daily": (("ent",), """
SELECT *, dark_money+regular_money AS main_money_inflow, volume-1 AS rank,
  CASE WHEN rank_type='stock' THEN seen ELSE volume%13<>0 END AS quote_available,
  open_price AS previous_close, close_price-open_price AS change_value, CASE WHEN open_price>0 THEN close_price/open_price-1 ELSE 0.0 END AS change_pct,
  CASE WHEN open_price>0 THEN (high_price-low_price)/open_price ELSE 0.0 END AS amplitude, CAST(volume AS DOUBLE)/100 AS turnover_rate,
  CASE WHEN turnover<>0 THEN CAST(abs(dark_money) AS DOUBLE)/CAST(turnover AS DOUBLE) ELSE 0.0 END AS dark_activity,
  CASE WHEN turnover<>0 THEN CAST(dark_money+regular_money AS DOUBLE)/CAST(turnover AS DOUBLE) ELSE 0.0 END AS dark_inflow_ratio,
  CAST(d AS TIMESTAMP)+INTERVAL 15 HOUR AS snapshot_at
FROM (SELECT d, rank_type, market, code, name, CAST(sum(cents) AS BIGINT) AS turnover,
  CAST(sum(sgn*cents) AS BIGINT) AS dark_money,
  CAST(sum(CASE WHEN k%2=0 THEN cents ELSE -cents END) AS BIGINT) AS regular_money, count(*) AS volume,
  arg_min(value, event_id) AS open_price, arg_max(value, event_id) AS close_price,
  max(value) AS high_price, min(value) AS low_price,
  count(*) FILTER (event_type IN ('purchase','signup')) AS up_count,
  count(*) FILTER (event_type='error') AS down_count, count(*) FILTER (event_type IN ('view','click')) AS flat_count,
  bool_or(event_type<>'error') AS seen, bool_or(event_type='purchase' OR k%3=0) AS money_available
  FROM ent GROUP BY ALL)"""),
    "idx": (("ev",), """
SELECT d, CAST(row_number() OVER (ORDER BY d)-1 AS INTEGER) AS date_idx FROM (SELECT DISTINCT d FROM ev)"""),
    "use": (("daily", "idx"), """
SELECT daily.*, date_idx FROM daily JOIN idx USING (d) WHERE rank_type<>'stock' OR quote_available"""),
    "moved": (("ent",), """
SELECT d, rank_type, market, code, name, bucket, CAST(sum(sgn*cents) AS BIGINT) AS mdark,
  CAST(sum(CASE WHEN k%2=0 THEN cents ELSE -cents END) AS BIGINT) AS mreg
FROM ent GROUP BY ALL"""),
    "points": (("moved",), """
SELECT d, rank_type, market, code, name, minute_index, dark_money, regular_money,
  dark_money+regular_money AS main_money_inflow,
  CAST(d AS TIMESTAMP) + to_minutes(CASE WHEN minute_index<24 THEN 570+(minute_index+1)*5 ELSE 780+(minute_index-23)*5 END) AS snapshot_at
FROM (SELECT g.d, g.rank_type, g.market, g.code, g.name, g.b AS minute_index,
   CAST(sum(coalesce(m.mdark,0)) OVER w AS BIGINT) AS dark_money,
   CAST(sum(coalesce(m.mreg,0)) OVER w AS BIGINT) AS regular_money
  FROM (SELECT d, rank_type, market, code, name, unnest(CASE WHEN (rank_type='stock' AND ascii(right(code,1))%4=0) OR (rank_type<>'stock' AND ascii(right(code,1))%4<>3) THEN range(0,48) ELSE list(CAST(bucket AS BIGINT)) END) AS b
        FROM moved GROUP BY d, rank_type, market, code, name) g
  LEFT JOIN moved m ON m.d=g.d AND m.rank_type=g.rank_type AND m.market=g.market AND m.code=g.code AND m.bucket=g.b
  WINDOW w AS (PARTITION BY g.d, g.rank_type, g.market, g.code ORDER BY g.b ROWS UNBOUNDED PRECEDING))"""),
    "bars": (("ev",), """
SELECT d, bucket AS minute_index, smarket AS market, scode AS code, arg_min(value,event_id) AS open_price,
  max(value) AS high_price, min(value) AS low_price, arg_max(value,event_id) AS close_price,
  count(*) AS volume, count(*) AS turnover,
  CASE WHEN user_id%2=0 THEN 'trend_1m' ELSE 'direct_5m' END AS source
FROM ev WHERE event_type IN ('click','purchase','signup') GROUP BY d, bucket, smarket, scode, user_id"""),
    "scans": (("ev",), """
SELECT DISTINCT d, scode AS stock_code, smarket AS stock_market, sname AS stock_name, 'BK'||event_type AS board_code,
  'concept' AS board_type, ascii(event_type) AS source_order FROM ev
UNION SELECT DISTINCT d, scode, smarket, sname, 'IND'||(k%7), 'industry', CAST(k%7 AS INTEGER) FROM ev"""),
    "changes": (("scans", "idx"), """
SELECT stock_code, stock_market, stock_name, board_code, board_type, source_order, i.d AS effective_date, change_type FROM (
 SELECT s.*, x.date_idx AS at, 'added' AS change_type FROM scans s JOIN idx x USING (d)
  WHERE x.date_idx>0 AND NOT EXISTS (SELECT 1 FROM scans p JOIN idx y USING (d) WHERE y.date_idx=x.date_idx-1
   AND p.stock_code=s.stock_code AND p.board_code=s.board_code)
 UNION ALL
 SELECT s.*, x.date_idx+1, 'removed' FROM scans s JOIN idx x USING (d)
  WHERE x.date_idx<(SELECT max(date_idx) FROM idx) AND NOT EXISTS (SELECT 1 FROM scans p JOIN idx y USING (d)
   WHERE y.date_idx=x.date_idx+1 AND p.stock_code=s.stock_code AND p.board_code=s.board_code)) c
JOIN idx i ON i.date_idx=c.at"""),
    "primary_ind": (("scans",), """
SELECT d, stock_code, arg_min(board_code, row(source_order, board_code)) AS industry_code
FROM scans WHERE board_type='industry' GROUP BY d, stock_code"""),
    "rets": (("use",), """
SELECT s.d AS signal_date, t.d AS target_date, h.horizon, s.rank_type, s.market, s.code, s.date_idx,
  t.close_price/s.close_price-1 AS return_rate,
  (SELECT max(p.close_price/s.close_price-1) FROM use p WHERE p.rank_type=s.rank_type AND p.market=s.market AND p.code=s.code
    AND p.close_price>0 AND p.date_idx BETWEEN s.date_idx+1 AND s.date_idx+h.horizon) AS max_favorable_return,
  (SELECT min(p.close_price/s.close_price-1) FROM use p WHERE p.rank_type=s.rank_type AND p.market=s.market AND p.code=s.code
    AND p.close_price>0 AND p.date_idx BETWEEN s.date_idx+1 AND s.date_idx+h.horizon) AS max_adverse_return
FROM use s CROSS JOIN (SELECT unnest([1,3,5,10,20]) AS horizon) h
JOIN use t ON t.rank_type=s.rank_type AND t.market=s.market AND t.code=s.code AND t.date_idx=s.date_idx+h.horizon
WHERE s.close_price>0 AND t.close_price>0"""),
    "labels": (("rets", "primary_ind"), """
SELECT r.*, r.return_rate - b.return_rate AS relative_industry_return FROM rets r
LEFT JOIN primary_ind p ON r.rank_type='stock' AND p.stock_code=r.code AND p.d=r.signal_date
LEFT JOIN rets b ON b.rank_type='industry' AND b.code=p.industry_code AND b.signal_date=r.signal_date AND b.horizon=r.horizon"""),
    "runs": ((), """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS snapshot_at,
  CASE o_orderkey%3 WHEN 0 THEN 'industry' WHEN 1 THEN 'concept' ELSE 'stock' END AS rank_type,
  CASE WHEN o_orderstatus='F' THEN 'success' WHEN o_orderstatus='P' THEN 'partial' WHEN o_orderkey%2=0 THEN 'failed' ELSE 'skipped' END AS status,
  CAST(o_orderdate AS DATE) AS requested_date, o_orderdate AS started_at,
  CASE WHEN o_orderkey%5<>0 THEN o_orderdate + to_minutes(o_orderkey%50) END AS finished_at,
  CAST(round(o_totalprice*100) AS BIGINT) AS fetched_total, o_custkey%60000 AS duration_ms
FROM orders"""),
    "quotes": (("ev",), """
SELECT d, scode AS code, arg_max(value,event_id) AS latest_price, arg_min(value,event_id) AS open_price,
  max(value) AS high_price, min(value) AS low_price, count(*) AS volume, CAST(sum(cents) AS BIGINT) AS turnover,
  CAST(count(*) AS DOUBLE)/10 AS turnover_rate
FROM ev WHERE event_type='purchase' GROUP BY d, scode"""),
    "research": (("points", "bars"), """
SELECT d, minute_index, market, code, coalesce(p.dark_money,0) AS dark_money, coalesce(p.regular_money,0) AS regular_money,
  coalesce(p.main_money_inflow,0) AS main_money_inflow, p.d IS NOT NULL AS money_available,
  CAST(coalesce(round(b.open_price*10000),0) AS BIGINT) AS open_price_e4,
  CAST(coalesce(round(b.high_price*10000),0) AS BIGINT) AS high_price_e4,
  CAST(coalesce(round(b.low_price*10000),0) AS BIGINT) AS low_price_e4,
  CAST(coalesce(round(b.close_price*10000),0) AS BIGINT) AS close_price_e4,
  coalesce(b.volume,0) AS volume, b.d IS NOT NULL AS kline_available
FROM (SELECT * FROM points WHERE rank_type='stock') p FULL JOIN bars b USING (d, minute_index, market, code)"""),
}


def with_tables(names: str, body: str) -> str:
    """``WITH`` the named stand-ins (space separated) and what they need, then ``body``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _CTES[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    # Pinned: DuckDB would otherwise re-evaluate a table once per mention.
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name][1]}\n)" for name in ordered)
    return f"WITH {clauses}\n{body.strip()}" if ordered else body.strip()
