"""Completeness of the daily archive: coverage, manifest, digests, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import digest_of_sums, merged_sums, set_digest, set_sums, typed_line
from tidemark.functions.grid import CLOSE, MINUTES, POINTS, grid_array, on_five_minute_grid
from tidemark.functions.scalars import clock_text

BOARDS = ("industry", "concept")


def _clocks(minutes: Column) -> Column:
    return F.transform(minutes, clock_text)


def coverage(minute_board: DataFrame, keys: tuple[str, ...] = ("trade_date", "rank_type"),
             minute: Column | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct minutes, five-minute points and close seen per key, with the ordered missing clocks.

    Distinct minutes of a day (at most 1440) are all a key ever collects.  Keys
    of ``wanted`` without any row have a row in which everything is missing.
    """
    at = minute if minute is not None else (F.hour("snapshot_at") * 60 + F.minute("snapshot_at")).cast("int")
    seen = minute_board.groupBy(*keys).agg(F.collect_set(at).alias("_m"))
    if wanted is not None:
        seen = (wanted.select(*keys).distinct().join(seen, list(keys), "left")
                .withColumn("_m", F.coalesce("_m", F.array().cast("array<int>"))))
    research = F.filter("_m", on_five_minute_grid)
    closed = F.array_contains("_m", CLOSE)
    return seen.select(
        *keys, F.lit(MINUTES).alias("expected_minutes"), F.size("_m").alias("collected_minutes"),
        F.lit(POINTS).alias("expected_research"), F.size(research).alias("collected_research"),
        F.lit(1).alias("expected_daily_close"), closed.cast("int").alias("collected_daily_close"),
        _clocks(F.array_except(grid_array(1), F.col("_m"))).alias("missing_minutes"),
        _clocks(F.array_except(grid_array(5), F.col("_m"))).alias("missing_research"),
        F.when(closed, F.array().cast("array<string>")).otherwise(F.array(F.lit("15:00"))).alias("missing_daily_close"))


def archive_coverage(closes: DataFrame, points: DataFrame, minutes: DataFrame | None = None) -> DataFrame:
    """Coverage of every (date, type) of archived closes: minutes from the minute boards, points from the curves.

    Each is what its own table holds, 0 where it holds nothing; the close is there, as it is being archived.
    """
    keys = ["trade_date", "rank_type"]
    seen = coverage(points, wanted=closes)
    none = points.limit(0) if minutes is None else minutes
    work = coverage(none, wanted=closes).select(*keys, *[F.col(f).alias(f"_{f}") for f in ("collected_minutes", "missing_minutes")])
    columns = {"collected_minutes": F.col("_collected_minutes"), "missing_minutes": F.col("_missing_minutes"),
               "collected_daily_close": F.lit(1), "missing_daily_close": F.array().cast("array<string>")}
    return seen.join(work, keys).withColumns(columns).select(*seen.columns)


def both_board_types(dated: DataFrame) -> DataFrame:
    """(trade_date, rank_type) of both board types for every date of ``dated``."""
    kinds = F.explode(F.array(*[F.lit(b) for b in BOARDS])).alias("rank_type")
    return dated.select("trade_date").distinct().select("trade_date", kinds)


def stock_quality(daily: DataFrame, research: DataFrame) -> DataFrame:
    """Expected and stored stock rows per date; money and bar rows are sums of the bits."""
    stocks = daily.filter(F.col("rank_type") == "stock").groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("daily_close_rows"), F.count_if("quote_available").alias("daily_kline_rows"))
    rows = research.groupBy("trade_date").agg(
        F.count_if("money_available").alias("money_rows"), F.count_if("kline_available").alias("kline_rows"))
    return (stocks.join(rows, "trade_date", "left").fillna(0, ["money_rows", "kline_rows"])
            .select("trade_date", F.col("daily_close_rows").alias("expected_stocks"), F.lit(POINTS).alias("expected_points"),
                    F.col("daily_kline_rows").alias("expected_kline_stocks"), "money_rows", "kline_rows",
                    "daily_close_rows", "daily_kline_rows"))


def bar_sources(research_sources: DataFrame) -> DataFrame:
    """Securities per bar source and date as one map, with the total of points."""
    per_source = research_sources.groupBy("trade_date", "source").agg(F.sum("point_count").alias("_points"))
    return per_source.groupBy("trade_date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "source", F.floor(F.col("_points") / POINTS).cast("bigint"))))).alias("kline_source_counts"),
        F.sum("_points").alias("source_points"))


def code_set_digest(daily: DataFrame) -> DataFrame:
    """Count and digest of the set of ``type|market|code`` lines of each date: one form for any number of lines."""
    line = F.concat_ws("|", "rank_type", F.col("market").cast("string"), "code")
    lines = daily.select("trade_date", line.alias("_line")).distinct()
    return set_digest(lines, ["trade_date"], F.col("_line"), "code_set_sha256").select(
        "trade_date", F.col("line_count").alias("code_count"), "code_set_sha256")


def archive_manifest(daily: DataFrame, board_money: DataFrame, research: DataFrame, sources: DataFrame,
                     quality: DataFrame | None = None) -> DataFrame:
    """One row per date: row counts by type, code digest, bar provenance, errors, status.

    Checks compare totals, as a date is sealed as a whole.  A date is complete
    when no check fails.
    """
    def typed(kind: str) -> Column:
        return F.col("rank_type") == kind

    closes = daily.groupBy("trade_date").agg(
        F.count_if(typed("industry")).alias("industry_close_rows"),
        F.count_if(typed("concept")).alias("concept_close_rows"),
        F.count_if(typed("stock")).alias("stock_close_rows"),
        F.count_if(typed("stock") & F.col("quote_available")).alias("stock_daily_kline_rows"))
    money = board_money.groupBy("trade_date").agg(
        F.count_if(typed("industry")).alias("industry_money_rows"),
        F.count_if(typed("concept")).alias("concept_money_rows"))
    points = research.groupBy("trade_date").agg(
        F.count_if("money_available").alias("stock_money_rows"), F.count_if("kline_available").alias("stock_kline_rows"))
    expected = (quality if quality is not None else stock_quality(daily, research)).select(
        "trade_date", F.col("expected_stocks").alias("expected_stock_rows"),
        F.col("expected_kline_stocks").alias("_kline_stocks"),
        (F.col("expected_kline_stocks") * F.col("expected_points")).alias("expected_stock_kline_rows"))
    dates = (closes.select("trade_date").union(money.select("trade_date")).union(expected.select("trade_date"))
             .distinct())
    counts = ["industry_close_rows", "industry_money_rows", "concept_close_rows", "concept_money_rows",
              "stock_close_rows", "stock_money_rows", "stock_kline_rows", "stock_daily_kline_rows",
              "expected_stock_rows", "expected_stock_kline_rows", "code_count", "source_points", "_kline_stocks"]
    wide = dates
    for part in (closes, money, points, expected, code_set_digest(daily), bar_sources(sources)):
        wide = wide.join(part, "trade_date", "left")
    wide = wide.fillna(0, counts).fillna("", ["code_set_sha256"])
    errors = manifest_errors()
    return (wide.withColumn("validation_errors", errors)
            .withColumn("status", F.when(F.size("validation_errors") == 0, "complete").otherwise("incomplete"))
            .select("trade_date", "status", *counts[:10], F.col("code_count"), "code_set_sha256",
                    F.coalesce("kline_source_counts", F.create_map().cast("map<string,bigint>"))
                    .alias("kline_source_counts"), "validation_errors"))


def manifest_errors() -> Column:
    """Sorted texts of failed checks over the manifest's count columns.

    Fixed values: the wording of the checks.
    """
    def differs(label: str, actual: str, wanted: Column) -> Column:
        return F.when(F.col(actual) != wanted, F.concat(
            F.lit(f"{label}: expected "), wanted.cast("string"), F.lit(", got "), F.col(actual).cast("string")))

    def board(kind: str) -> Column:
        closes = F.col(f"{kind}_close_rows")
        return F.when(closes == 0, F.lit(f"{kind} daily close is missing")).otherwise(
            differs(f"{kind} money rows", f"{kind}_money_rows", closes * POINTS))

    archived = F.col("expected_stock_rows") > 0
    checks = [
        board("industry"), board("concept"),
        F.when(~archived, F.lit("stock archive quality is missing")),
        F.when(archived, differs("stock daily close rows", "stock_close_rows", F.col("expected_stock_rows"))),
        F.when(archived, differs("stock money rows", "stock_money_rows", F.col("_kline_stocks") * POINTS)),
        F.when(archived, differs("stock daily kline rows", "stock_daily_kline_rows", F.col("_kline_stocks"))),
        F.when(archived, differs("stock five-minute kline rows", "stock_kline_rows",
                                 F.col("expected_stock_kline_rows"))),
        differs("stock kline provenance rows", "source_points", F.col("stock_kline_rows")),
    ]
    return F.array_sort(F.array_compact(F.array(*checks)))


def current_manifest(dates: DataFrame, manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest of each asked date with its current revision; an empty incomplete one when absent."""
    counts = [name for name, kind in manifest.dtypes if kind in ("int", "bigint")]
    now = current.select("trade_date", F.col("revision_id").alias("current_revision_id"), "revision_no")
    return (dates.select("trade_date").join(manifest, "trade_date", "left").join(now, "trade_date", "left")
            .fillna(0, counts + ["revision_no"]).fillna("", ["code_set_sha256", "current_revision_id"])
            .fillna("incomplete", ["status"])
            .withColumns({"kline_source_counts": F.coalesce("kline_source_counts",
                                                            F.create_map().cast("map<string,bigint>")),
                          "validation_errors": F.coalesce("validation_errors", F.array().cast("array<string>"))}))


def archive_status(daily: DataFrame, board_money: DataFrame, research: DataFrame, quality: DataFrame,
                   scans: DataFrame | None = None) -> DataFrame:
    """Per date: has_daily_close, has_end_of_day, has_bars, has_membership_scan."""
    closes = daily.groupBy("trade_date").agg(
        F.max(F.col("rank_type") == "stock").alias("has_daily_close"),
        F.max(F.col("rank_type") == "industry").alias("_industry"),
        F.max(F.col("rank_type") == "concept").alias("_concept"))
    curves = (board_money.groupBy("trade_date", "rank_type")
              .agg(F.count_distinct("snapshot_at").alias("_times"))
              .groupBy("trade_date").agg(F.count_if(F.col("_times") == POINTS).alias("_curves")))
    money = research.groupBy("trade_date").agg(F.count_if("money_available").alias("_money"))
    expected = F.col("expected_kline_stocks") * F.col("expected_points")
    no = F.lit(False)
    joined = closes.join(curves, "trade_date", "left").join(quality, "trade_date", "left").join(money, "trade_date", "left")
    done = (F.col("has_daily_close") & F.col("_industry") & F.col("_concept") & (F.col("_curves") == len(BOARDS))
            & (F.col("daily_close_rows") == F.col("expected_stocks"))
            & (F.col("daily_kline_rows") == F.col("expected_kline_stocks"))
            & (F.coalesce("_money", F.lit(0)) == expected))
    status = joined.select("trade_date", "has_daily_close", F.coalesce(done, no).alias("has_end_of_day"),
                           F.coalesce(F.col("kline_rows") == expected, no).alias("has_bars"))
    if scans is None:
        return status.withColumn("has_membership_scan", no)
    synced = scans.filter(F.col("status") == "success").select("trade_date").distinct().withColumn("_ok", F.lit(True))
    return (status.join(synced, "trade_date", "left")
            .withColumn("has_membership_scan", F.coalesce("_ok", no)).drop("_ok"))


def missing_bars(daily: DataFrame, research: DataFrame) -> DataFrame:
    """Quoted stocks of each date with fewer than 48 bars, in rank order."""
    quoted = (daily.filter((F.col("rank_type") == "stock") & F.col("quote_available"))
              .select("trade_date", "market", "code", "rank"))
    stored = research.groupBy("trade_date", "market", "code").agg(F.count_if("kline_available").alias("_bars"))
    return (quoted.join(stored, ["trade_date", "market", "code"], "left")
            .withColumn("bar_rows", F.coalesce("_bars", F.lit(0))).filter(F.col("bar_rows") < POINTS)
            .select("trade_date", "market", "code", "rank", "bar_rows").orderBy("trade_date", "rank"))


def inconsistent_quality(quality: DataFrame, daily: DataFrame) -> DataFrame:
    """Dates whose quality row does not fit the stored closes; bars must not be fetched for them."""
    closes = daily.groupBy("trade_date").agg(
        F.count_if((F.col("rank_type") == "stock") & F.col("quote_available")).alias("close_stocks"))
    return (quality.join(closes, "trade_date", "left").fillna(0, ["close_stocks"])
            .filter((F.col("expected_points") != POINTS) | (F.col("close_stocks") != F.col("expected_kline_stocks")))
            .select("trade_date", "expected_kline_stocks", "close_stocks", "expected_points"))


DIGEST_PARTS = 16
NOT_CONTENT = ("fetched_at", "run_id", "created_at", "updated_at")


def content_leaves(tables: dict[str, DataFrame], date: str = "trade_date", key: str = "code",
                   without: Sequence[str] = NOT_CONTENT) -> DataFrame:
    """Leaves of the digest tree: sums of line hashes per (date, table, part of the keys).

    A leaf is mergeable, so a node of the tree (a table of a date, a date, an
    archive) is the sum of its leaves and need not read a row again.  Leaves are
    kept per date; sealing a date anew makes that date's leaves only.  Fetch
    stamps do not count.  Tables without ``key`` are split by all of a line.
    """
    leaves = None
    for name, table in tables.items():
        columns = [(c, kind) for c, kind in table.dtypes if c not in without]
        # Maps have no text form of their own, and bytes need not be text.
        line = typed_line([F.to_json(F.col(c)) if kind.startswith("map") else F.base64(c) if kind == "binary"
                           else F.col(c).cast("string") for c, kind in columns])
        spread = F.col(key) if key in table.columns else line
        rows = table.select(date, F.lit(name).alias("table"), F.pmod(F.xxhash64(spread), F.lit(DIGEST_PARTS)).cast("int").alias("part"),
                            line.alias("_line"))
        made = set_sums(rows, [date, "table", "part"], F.col("_line"))
        leaves = made if leaves is None else leaves.unionByName(made)
    return leaves


def replaced_leaves(leaves: DataFrame, changed: dict[str, DataFrame]) -> DataFrame:
    """Leaves of an archive that has ``changed`` in place of its tables of these names; those of all others are taken over."""
    return leaves.filter(~F.col("table").isin(list(changed))).unionByName(content_leaves(changed))


def content_nodes(leaves: DataFrame, level: Sequence[str]) -> DataFrame:
    """Digests of the tree's nodes at a level, e.g. (trade_date, table): a root is the sum of what is below it."""
    return merged_sums(leaves, level).select(*level, "line_count", digest_of_sums().alias("digest"))


def content_differences(left: DataFrame, right: DataFrame, date: str = "trade_date") -> DataFrame:
    """(date, table, part) in which two archives differ, and their line counts; leaves are compared, not rows."""
    level = [date, "table", "part"]
    a, b = (content_nodes(x, level).withColumnsRenamed({"line_count": f"{side}_lines", "digest": f"_{side}"})
            for side, x in (("left", left), ("right", right)))
    return (a.join(b, level, "full_outer").filter(~F.col("_left").eqNullSafe(F.col("_right")))
            .select(*level, *[F.coalesce(f"{side}_lines", F.lit(0)).alias(f"{side}_lines") for side in ("left", "right")]))


def content_digest(tables: dict[str, DataFrame], date: str = "trade_date",
                   without: tuple[str, ...] = ("fetched_at", "run_id", "created_at", "updated_at")) -> DataFrame:
    """One digest per date over all rows of several tables, independent of row order.

    Each table contributes a multiset digest, so nothing is sorted or gathered;
    fetch stamps do not count.
    """
    parts = None
    for name, table in tables.items():
        columns = [c for c in table.columns if c not in without]
        # A map has no text form of its own.
        text = [F.to_json(F.col(c)) if kind.startswith("map") else F.col(c).cast("string")
                for c, kind in table.dtypes if c in columns]
        digest = set_digest(table, [date], typed_line(text), "_digest").select(
            date, F.lit(name).alias("_table"), "_digest")
        parts = digest if parts is None else parts.unionByName(digest)
    return parts.groupBy(date).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "_table", "_digest"))), "\n"), 256)
        .alias("content_sha256"))
