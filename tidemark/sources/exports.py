"""CSV and Parquet exports of archive slices."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.views import range_series, type_order

# Column lists and formats of the exported files.
SERIES_COLUMNS = ("trade_date", "snapshot_at", "rank_type", "rank", "code", "name", "latest_price_raw", "change_pct",
                  "dark_money", "regular_money", "main_money_inflow", "dark_activity", "dark_inflow_ratio", "up_count",
                  "down_count")
CLOSE_COLUMNS = ("revision_id", "trade_date", "snapshot_kind", "snapshot_at", "rank_type", "rank", "code", "name",
                 "open_price", "high_price", "low_price", "close_price", "previous_close", "change_value", "change_pct",
                 "volume", "turnover", "turnover_rate", "amplitude", "quote_available", "latest_price_raw", "dark_money",
                 "regular_money", "main_money_inflow", "dark_activity", "dark_inflow_ratio", "up_count", "flat_count",
                 "down_count")
FOUR_DIGITS = ("open_price", "high_price", "low_price", "close_price", "previous_close", "change_value")
EIGHT_DIGITS = ("change_pct", "turnover_rate", "amplitude", "dark_activity", "dark_inflow_ratio")
BYTE_ORDER_MARK = "﻿"

DATASETS = ("revisions", "daily_close", "daily_features", "future_labels", "future_label_history", "board_money_5m",
            "stock_research_5m")


def fixed(value: Column, digits: int) -> Column:
    """Number as plain text with exactly ``digits`` decimals."""
    return F.round(value, digits).cast(f"decimal(30,{digits})").cast("string")


def _as_text(rows: DataFrame, columns: Sequence[str], missing: dict[str, Column]) -> DataFrame:
    shaped = []
    for name in columns:
        value = F.col(name) if name in rows.columns else missing.get(name, F.lit(0))
        if name in FOUR_DIGITS:
            value = fixed(value.cast("double"), 4)
        elif name in EIGHT_DIGITS:
            value = fixed(value.cast("double"), 8)
        elif name == "snapshot_at":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX") if dict(rows.dtypes)[name] == "timestamp" \
                else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        shaped.append(value.cast("string").alias(name))
    return rows.select(*shaped)


def series_csv(curve: DataFrame, rank_type: str, code: str, start: str, end: str) -> DataFrame:
    """Text columns of one board's five-minute series in a time range."""
    return _as_text(range_series(curve, rank_type, code, start, end), SERIES_COLUMNS, {})


def close_csv(daily: DataFrame, trade_date: str | None = None, revision_id: str = "") -> DataFrame:
    """Text columns of the closes of a date: industries, concepts, stocks, each by rank."""
    rows = daily if trade_date is None else daily.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    ordered = rows.orderBy("trade_date", type_order(), "rank")
    return _as_text(ordered, CLOSE_COLUMNS, {"revision_id": F.lit(revision_id), "snapshot_kind": F.lit("daily_close"),
                                             "snapshot_at": F.lit(None).cast("string")})


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with header and byte-order mark; order follows the sorted partitions (eager write).

    The mark sits before the first header name of every part file.
    """
    first, *rest = rows.columns
    marked = rows.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def _between(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return rows.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def dataset(name: str, tables: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """One exportable slice; ``tables`` has current, revisions, daily_close, features, labels, curves."""
    current = tables["current"].select("trade_date", "revision_id")
    if name == "revisions":
        return _between(tables["revisions"], "trade_date", start, end)
    if name == "daily_close":
        return _between(tables["daily_close"], "trade_date", start, end)
    if name == "daily_features":
        rows = _between(tables["daily_features"], "trade_date", start, end)
        return rows.join(F.broadcast(current), ["trade_date", "revision_id"], "left_semi")
    if name in ("future_labels", "future_label_history"):
        rows = _between(tables["future_labels"], "signal_date", start, end)
        if name == "future_label_history":
            return rows
        for side in ("signal", "target"):
            pointer = current.select(F.col("trade_date").alias(f"{side}_date"),
                                     F.col("revision_id").alias(f"{side}_revision_id"))
            rows = rows.join(F.broadcast(pointer), pointer.columns, "left_semi")
        return rows
    if name in ("board_money_5m", "stock_research_5m"):
        return _between(tables[name], "trade_date", start, end)
    raise ValueError(f"unknown dataset {name}; known: {', '.join(DATASETS)}")


SORTS = {
    "revisions": ["trade_date", "revision_no"], "daily_close": ["trade_date", "rank_type", "rank"],
    "daily_features": ["trade_date", "rank_type", "code"],
    "future_labels": ["signal_date", "horizon", "rank_type", "code"],
    "future_label_history": ["signal_date", "horizon", "rank_type", "code", "target_revision_id"],
    "board_money_5m": ["trade_date", "rank_type", "code", "snapshot_at"],
    "stock_research_5m": ["trade_date", "market", "code", "minute_index"],
}


def export_datasets(tables: dict[str, DataFrame], start: str, end: str, output: str, kind: str = "parquet",
                    names: Sequence[str] = DATASETS) -> DataFrame:
    """Write slices as zstd Parquet and/or CSV, then the manifest; returns the manifest (eager writes).

    Rows are counted while they are written.  A range without a current
    revision is an error, found before anything is written.
    """
    if start > end:
        raise ValueError("start must not be after end")
    if kind not in ("parquet", "csv", "both"):
        raise ValueError("kind is parquet, csv or both")
    spark = tables["current"].sparkSession
    chosen = (_between(tables["revisions"], "trade_date", start, end)
              .join(F.broadcast(tables["current"].select("trade_date", "revision_id")), ["trade_date", "revision_id"],
                    "left_semi"))
    if not chosen.limit(1).collect():
        raise ValueError("no current revision in the range")
    counts = {}
    for name in names:
        rows = dataset(name, tables, start, end).sortWithinPartitions(*SORTS[name])
        if kind in ("parquet", "both"):
            counts[name] = _observed_write(rows, f"{output}/{name}", "parquet")
        if kind in ("csv", "both"):
            flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c)
                                 for c, t in rows.dtypes])
            counts[name] = _observed_write(flat, f"{output}/{name}_csv", "csv")
    return _write_manifest(spark, chosen, counts, start, end, output)


def _observed_write(rows: DataFrame, path: str, kind: str) -> int:
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if kind == "parquet":
        watched.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        write_csv(watched, path)
    return int(seen.get["rows"])


def _write_manifest(spark: SparkSession, revisions: DataFrame, counts: dict[str, int], start: str, end: str,
                    output: str) -> DataFrame:
    listed = revisions.agg(F.array_sort(F.collect_list(F.struct(
        F.col("trade_date").cast("string").alias("trade_date"), "revision_id", "revision_no", "content_sha256",
        F.col("created_at").cast("string").alias("created_at")))).alias("revisions"))
    sizes = json.dumps({name: {"rows": rows} for name, rows in counts.items()})
    manifest = listed.select(
        F.lit(start).alias("from_date"), F.lit(end).alias("to_date"), "revisions",
        F.from_json(F.lit(sizes), "map<string,struct<rows:bigint>>").alias("datasets"))
    manifest.write.mode("overwrite").json(f"{output}/manifest")
    return spark.read.json(f"{output}/manifest")
