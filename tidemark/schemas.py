"""Row layouts of the archive tables, as Spark StructTypes.

Dates are DATE, instants TIMESTAMP, money and volume BIGINT, prices and ratios
DOUBLE.  ``*_available`` bits say whether the numbers next to them were
observed; zeros beside a cleared bit mean "unknown".
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOL, DATE, TS = T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()

# The enumerations the tables may hold.
RANK_TYPES = ("stock", "industry", "concept")
BOARD_TYPES = ("industry", "concept")
CHANGE_TYPES = ("added", "removed")
SNAPSHOT_KINDS = ("research_5m", "daily_close")

KEY = ["rank_type", "market", "code"]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _many(kind: T.DataType, *names: str) -> list[tuple[str, T.DataType]]:
    return [(name, kind) for name in names]


RANK_RECORD = _struct(
    ("trade_date", DATE), ("snapshot_at", TS), ("rank_type", STRING), ("rank", LONG), ("market", LONG),
    *_many(STRING, "code", "name", "quote_time"),
    ("latest_price_raw", LONG),
    *_many(DOUBLE, "open_price", "high_price", "low_price", "close_price", "previous_close",
           "change_value", "change_pct"),
    *_many(LONG, "volume", "turnover"),
    *_many(DOUBLE, "turnover_rate", "amplitude"),
    *_many(BOOL, "quote_available", "money_available"),
    *_many(LONG, "dark_money", "regular_money", "main_money_inflow"),
    *_many(DOUBLE, "dark_activity", "dark_inflow_ratio"),
    *_many(LONG, "up_count", "flat_count", "down_count"),
    *_many(STRING, "leader_name", "leader_code"),
    *_many(INT, "source_version", "source_sort_flag"),
    ("source_descending", BOOL), ("fetched_at", TS),
)

MONEY_POINT = _struct(
    ("trade_date", DATE), ("snapshot_at", TS), ("rank_type", STRING), ("rank", LONG), ("market", LONG),
    *_many(STRING, "code", "name"),
    *_many(LONG, "dark_money", "regular_money", "main_money_inflow", "source_time"),
    ("fetched_at", TS),
)

BAR_POINT = _struct(
    ("trade_date", DATE), ("minute_index", INT), ("market", LONG), *_many(STRING, "code", "source"),
    *_many(DOUBLE, "open_price", "high_price", "low_price", "close_price"),
    *_many(LONG, "volume", "turnover"),
    *_many(DOUBLE, "amplitude", "change_pct", "change_value", "turnover_rate"),
    ("fetched_at", TS),
)

STOCK_RESEARCH = _struct(
    ("trade_date", DATE), ("minute_index", INT), ("market", LONG), ("code", STRING),
    *_many(LONG, "money_rank", "dark_money", "regular_money", "main_money_inflow"),
    ("money_available", BOOL),
    *_many(LONG, "open_price_e4", "high_price_e4", "low_price_e4", "close_price_e4", "volume", "turnover",
           "amplitude_ppm", "change_pct_ppm", "change_value_e4", "turnover_rate_ppm"),
    ("kline_available", BOOL),
)

RELATION = _struct(
    ("stock_code", STRING), ("stock_market", LONG), *_many(STRING, "stock_name", "board_code", "board_name",
                                                           "board_type"),
    ("source_order", INT), *_many(STRING, "relation_source", "relation_scope"),
    ("detected_at", TS), ("raw_data", STRING),
)
RELATION_BASELINE = T.StructType([T.StructField("baseline_date", DATE)] + RELATION.fields)
RELATION_CHANGE = T.StructType(
    [T.StructField("effective_date", DATE), T.StructField("change_type", STRING)]
    + RELATION.fields + [T.StructField("run_id", STRING)])
RELATION_CURRENT = T.StructType(RELATION.fields + [T.StructField("since_date", DATE)])

QUOTE = _struct(
    ("code", STRING), ("market", LONG), ("name", STRING),
    *_many(DOUBLE, "latest_price", "open_price", "high_price", "low_price", "previous_close", "change_pct",
           "change_value"),
    *_many(LONG, "volume", "turnover"),
    *_many(DOUBLE, "turnover_rate", "amplitude"),
    ("quote_time", STRING), ("fetched_at", TS), ("available", BOOL),
)

RAW_PAGE = _struct(
    ("trade_date", DATE), ("snapshot_at", TS), ("snapshot_kind", STRING), ("rank_type", STRING), ("page", LONG),
    ("body", T.BinaryType()), ("fetched_at", TS),
)

REVISION = _struct(
    ("revision_id", STRING), ("trade_date", DATE), ("revision_no", INT), ("previous_revision_id", STRING),
    ("content_sha256", STRING), ("created_at", TS),
)

RUN = _struct(
    ("run_id", STRING), ("snapshot_at", TS), *_many(STRING, "snapshot_kind", "rank_type", "status"),
    ("requested_date", DATE), ("actual_trade_date", DATE),
    *_many(LONG, "expected_total", "fetched_total", "page_count", "attempt_count"),
    *_many(TS, "started_at", "finished_at"), ("duration_ms", LONG), *_many(STRING, "error_code", "error_message"),
)

RUN_ROLLUP = _struct(
    *_many(STRING, "rank_type", "status"), *_many(LONG, "run_count", "record_count", "duration_ms"),
    ("latest_success_at", TS),
)

CALENDAR_FILE = _struct(
    ("holidays", T.ArrayType(STRING)), ("workdays", T.ArrayType(STRING)),
    *_many(STRING, "valid_through", "updated_at", "source"),
)
