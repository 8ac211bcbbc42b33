"""Small tables for tests, filled from the archive schemas."""

import datetime as dt

from tidemark import schemas
from tidemark.functions.grid import HALF_POINTS, NOON_START, OPENING

ZERO = {"string": "", "bigint": 0, "double": 0.0, "boolean": False, "int": 0}


def day(text):
    return dt.date.fromisoformat(text)


def at(date, hour, minute):
    return dt.datetime.combine(day(date) if isinstance(date, str) else date, dt.time(hour, minute))


def point_time(date, index):
    minute = OPENING + (index + 1) * 5 if index < HALF_POINTS else NOON_START + (index - HALF_POINTS + 1) * 5
    return at(date, minute // 60, minute % 60)


def _row(schema, values):
    unknown = set(values) - set(schema.names)
    assert not unknown, unknown
    return tuple(values.get(f.name, ZERO.get(f.dataType.simpleString())) for f in schema.fields)


def records(spark, rows):
    """Rank records; quoted and with money unless told otherwise, stamped 15:00."""
    filled = []
    for row in rows:
        base = {"quote_available": True, "money_available": True, "rank": 1, "market": 0}
        base.update(row)
        base["trade_date"] = day(base["trade_date"])
        base.setdefault("snapshot_at", at(base["trade_date"], 15, 0))
        base.setdefault("fetched_at", at(base["trade_date"], 15, 1))
        filled.append(_row(schemas.RANK_RECORD, base))
    return spark.createDataFrame(filled, schemas.RANK_RECORD)


def curve(date, rank_type, code, values, market=0, first=0):
    return [{"trade_date": date, "rank_type": rank_type, "code": code, "market": market, "minute_index": i,
             "dark_money": v} for i, v in enumerate(values, start=first)]


def points(spark, rows):
    schema = "trade_date date, snapshot_at timestamp, rank_type string, market bigint, code string, name string, " \
             "minute_index int, dark_money bigint, regular_money bigint, main_money_inflow bigint, source_time bigint, " \
             "fetched_at timestamp"
    data = []
    for r in rows:
        stamp = point_time(r["trade_date"], r["minute_index"])
        dark, regular = r["dark_money"], r.get("regular_money", 0)
        data.append((day(r["trade_date"]), stamp, r["rank_type"], r.get("market", 0), r["code"], r["code"],
                     r["minute_index"], dark, regular, dark + regular, int(stamp.strftime("%y%m%d%H%M")), stamp))
    return spark.createDataFrame(data, schema)


def relations(spark, rows, schema=schemas.RELATION):
    filled = []
    for row in rows:
        base = {"relation_source": "feed", "relation_scope": "list", "board_type": "concept", "stock_market": 0,
                "source_order": 1, "detected_at": at("2026-08-10", 16, 0)}
        base.update(row)
        base.setdefault("stock_name", base["stock_code"])
        base.setdefault("board_name", base["board_code"])
        for name in ("baseline_date", "effective_date", "since_date"):
            if isinstance(base.get(name), str):
                base[name] = day(base[name])
        filled.append(_row(schema, base))
    return spark.createDataFrame(filled, schema)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]
