"""The coverage query against its SQL on a day whose minutes are all there."""

import duckdb
from compare import compare, connect

from tidemark.plans.catalog import ORACLES, QUERIES


def test_key_without_a_missing_minute_is_as_in_the_sql(spark, root):
    duckdb.sql(f"""COPY (SELECT row_number() OVER () AS event_id, ts, 1::BIGINT AS user_id, event_type, 1.0 AS value, '{{"k": 1}}' AS props FROM
        (SELECT TIMESTAMP '2024-01-02' + to_minutes(m) AS ts, t AS event_type FROM range(1440) r(m), (VALUES ('click'), ('view')) v(t)
         WHERE t = 'click' OR m <> 600)) TO '{root}/events.parquet' (FORMAT parquet)""")
    assert compare(spark, connect(root), QUERIES["coverage"], ORACLES["coverage"], root) is None
    assert [r["event_type"] for r in QUERIES["coverage"](spark, root).collect()] == ["view"]
