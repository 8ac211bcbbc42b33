"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = ["daily_features", "future_labels", "scan_qualified", "cross_section_percentile", "price_percentile_by_flag",
            "self_percentile", "inflow_streak", "curve_shape", "members_by_date", "supplier_of_part_changes",
            "parse_board_constituents", "parse_rank_pages", "bars_5m", "merge_money_and_bars", "rank_orders_by_priority",
            "archive_manifest", "coverage", "lineitem_set_digest", "stitch_cumulative", "roll_up_runs", "close_page", "export_files", "save_daily_close"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("OFF")
    for name in ("events", "lineitem", "orders", "customer"):  # files into the page cache, JVM warm
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
