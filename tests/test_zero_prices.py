"""Events of value 0: their stocks have a price and, as the SQL says, their bars are stored."""

import duckdb

from compare import compare
from tidemark.operators.bars import archive_bars
from tidemark.plans import standin as st
from tidemark.plans.catalog import ORACLES, QUERIES


def worthless(spark, root):
    rows = [(1, "2024-01-07 09:00:00", 340, "click", 0.0, '{"k": 1}'), (2, "2024-01-07 10:00:00", 341, "click", 2.5, '{"k": 2}'),
            (3, "2024-01-07 11:00:00", 341, "view", 0.0, '{"k": 3}'), (4, "2024-01-08 09:00:00", 343, "purchase", 0.0, '{"k": 4}'),
            (5, "2024-01-08 10:00:00", 343, "click", 1.0, '{"k": 5}')]
    (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
     .selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1)
     .write.parquet(f"{root}/events.parquet"))
    return root


def test_no_stock_is_refused_for_a_price_of_nothing(spark, root):
    minutes, official = st.stock_minutes(spark, worthless(spark, root))
    good, rejected = archive_bars(minutes, official)
    assert rejected.count() == 0 and good.count() == 3 * 48
    assert good.agg({"low_price": "min"}).first()[0] == st.TICK


def test_runs_over_events_of_value_0_equal_their_sql(spark, root):
    sf = worthless(spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    assert compare(spark, con, QUERIES["resumable_bars"], ORACLES["resumable_bars"], sf) is None
