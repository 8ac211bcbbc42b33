"""Building, repairing, compacting and sealing the daily archive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE, on_five_minute_grid
from tidemark.functions.scalars import clock_minute, numeric_prefix, repaired_money_bit
from tidemark.operators.enrich import (eligible_only, enrich_board_quotes, enrich_stock_quotes, merge_close_money,
                                       misdated_quotes, only_quoted, rank_at_time)
from tidemark.operators.quality import both_board_types, content_digest, coverage

MONEY = ("dark_money", "regular_money", "main_money_inflow")
CLOSE_KEY = ["trade_date", "rank_type", "market", "code"]


# -- set-like writes ---------------------------------------------------------

def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the table does not hold yet (to be appended)."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def insert_or_replace(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], recency: Column) -> DataFrame:
    """Table content after an upsert; among incoming copies of a key the latest wins.

    Only the incoming side is aggregated; stored rows meet an anti-join.
    """
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    newest = (incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), recency).alias("_r"))
              .select(*keys, "_r.*").select(*incoming.columns))
    return existing.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


# -- repairs -----------------------------------------------------------------

def repair_availability(points: DataFrame) -> DataFrame:
    """Rows with any money carry the money bit."""
    return points.withColumn("money_available", repaired_money_bit(
        F.col("money_available"), *[F.col(m) for m in MONEY]))


def drop_board_placeholders(points: DataFrame) -> DataFrame:
    return points.filter(F.col("money_available"))


def drop_stock_placeholders(research: DataFrame, daily: DataFrame) -> DataFrame:
    """Drop rows with neither money nor bar, and all rows of stocks unquoted that day."""
    unquoted = (daily.filter((F.col("rank_type") == "stock") & ~F.col("quote_available"))
                .select("trade_date", "market", "code"))
    return (research.filter(F.col("money_available") | F.col("kline_available"))
            .join(unquoted, ["trade_date", "market", "code"], "left_anti"))


def promote_close_rows(snapshots: DataFrame) -> DataFrame:
    """15:00 board rows filed as research points become daily closes unless one is there already."""
    misplaced = ((F.col("snapshot_kind") == "research_5m") & F.col("rank_type").isin("industry", "concept")
                 & (clock_minute(F.col("snapshot_at")) == CLOSE))
    stay = snapshots.filter(~misplaced)
    moved = snapshots.filter(misplaced).withColumn("snapshot_kind", F.lit("daily_close"))
    keys = ["trade_date", "snapshot_kind", "snapshot_at", "rank_type", "code"]
    return stay.unionByName(insert_if_absent(stay, moved, keys))


# -- compaction --------------------------------------------------------------

@dataclass(frozen=True)
class Compaction:
    """Rows to append to the curve and close tables, coverage per (date, type), dates safe to purge."""

    curve_rows: DataFrame
    close_rows: DataFrame
    coverage: DataFrame
    purgeable: DataFrame


def compact_intraday(minute_board: DataFrame, curve: DataFrame, daily: DataFrame) -> Compaction:
    """Fold minute boards of all their dates into five-minute points and closes.

    Existing points and closes stay.  A date may be purged only if both board
    types have a 15:00 board.
    """
    at = clock_minute(F.col("snapshot_at"))
    boards = minute_board.filter(F.col("rank_type").isin("industry", "concept"))
    points = boards.filter(on_five_minute_grid(at)).select(
        "trade_date", "snapshot_at", "rank_type", "rank", "market", "code", "name", *MONEY, "money_available",
        numeric_prefix(F.col("quote_time")).alias("source_time"), "fetched_at")
    closes = boards.filter(at == CLOSE).withColumn("snapshot_kind", F.lit("daily_close"))
    seen = coverage(boards, wanted=both_board_types(minute_board))
    ready = (seen.groupBy("trade_date").agg(F.sum("collected_daily_close").alias("_closed"))
             .filter(F.col("_closed") == 2).select("trade_date"))
    return Compaction(
        insert_if_absent(curve, points, ["trade_date", "snapshot_at", "rank_type", "market", "code"]),
        insert_if_absent(daily, closes, CLOSE_KEY), seen, ready)


def archived_dates(board_coverage: DataFrame, quality: DataFrame, before: str) -> DataFrame:
    """Dates before a cut whose board coverage and stock archive are complete."""
    boards = (board_coverage.filter((F.col("collected_research") == F.col("expected_research"))
                                    & (F.col("collected_daily_close") == F.col("expected_daily_close")))
              .groupBy("trade_date").agg(F.count(F.lit(1)).alias("_types")).filter(F.col("_types") == 2))
    wanted = F.col("expected_kline_stocks") * F.col("expected_points")
    stocks = quality.filter((F.col("money_rows") == wanted) & (F.col("kline_rows") == wanted)
                            & (F.col("daily_close_rows") == F.col("expected_stocks"))
                            & (F.col("daily_kline_rows") == F.col("expected_kline_stocks")))
    return (boards.filter(F.col("trade_date") < F.lit(before).cast("date")).select("trade_date")
            .join(stocks.select("trade_date"), "trade_date", "left_semi"))


def purge_archived(minute_board: DataFrame, raw_pages: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of the minute boards and raw pages once ``done`` dates are archived.

    ``done`` is one row per date, hence the broadcasts.  Close pages are kept.
    """
    rows = minute_board.join(F.broadcast(done), "trade_date", "left_anti")
    pages = raw_pages.filter(F.col("snapshot_kind") == "daily_close").unionByName(
        raw_pages.filter(F.col("snapshot_kind") != "daily_close").join(F.broadcast(done), "trade_date", "left_anti"))
    return rows, pages


# -- a day's archive ---------------------------------------------------------

@dataclass(frozen=True)
class ArchiveDay:
    """Closes and money points to save, and why anything was left out (or voids the day)."""

    closes: DataFrame
    points: DataFrame
    errors: DataFrame


def archive_boards(ranked: DataFrame, quotes: DataFrame, points: DataFrame,
                   on: Sequence[str] = ("code",)) -> ArchiveDay:
    """Ranked boards -> strict quotes -> ranked curves -> closing money.

    Many dates go in one plan when ``on`` names trade_date too.
    """
    rows, errors = enrich_board_quotes(ranked, quotes, on)
    curves = rank_at_time(points.join(rows.select("trade_date", "rank_type", "market", "code"),
                                      ["trade_date", "rank_type", "market", "code"], "left_semi"))
    return ArchiveDay(merge_close_money(rows, curves), curves, errors)


def archive_stocks(ranked: DataFrame, quotes: DataFrame, points: DataFrame, trade_date: str | Column,
                   on: Sequence[str] = ("code",)) -> ArchiveDay:
    """Ranked stocks -> quotes -> quoted only -> ranked curves of those -> closing money.

    ``trade_date`` is what quotes must be dated: one date, or a column of
    ``quotes`` when many dates go in one plan.
    """
    rows = only_quoted(enrich_stock_quotes(ranked, quotes, on))
    curves, _ = eligible_only(points, rows)
    curves = rank_at_time(curves)
    wrong = misdated_quotes(quotes, trade_date).select(
        F.lit("stock").alias("rank_type"), "code", F.lit("wrong_date").alias("reason"))
    return ArchiveDay(merge_close_money(rows, curves), curves, wrong)


# -- sealing -----------------------------------------------------------------

def seal_archive(manifest: DataFrame, tables: dict[str, DataFrame], revisions: DataFrame,
                 revision_prefix: str, sealed_at: Column) -> DataFrame:
    """Revision rows for every complete date: a known date keeps id and number, the digest is renewed.

    A revision labels a date; its content is the tables as they are.
    """
    complete = manifest.filter(F.col("status") == "complete").select("trade_date")
    digests = content_digest(tables).join(complete, "trade_date", "left_semi")
    known = revisions.select("trade_date", F.col("revision_id").alias("_id"), F.col("revision_no").alias("_no"))
    return digests.join(known, "trade_date", "left").select(
        F.coalesce("_id", F.concat(F.lit(revision_prefix), F.date_format("trade_date", "yyyyMMdd")))
        .alias("revision_id"), "trade_date", F.coalesce("_no", F.lit(1)).alias("revision_no"),
        F.lit(None).cast("string").alias("previous_revision_id"), "content_sha256", sealed_at.alias("created_at"))


def orphan_revisions(revisions: DataFrame, current: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Revisions no pointer, feature or label refers to."""
    rest = revisions
    for table, column in ((current, "revision_id"), (features, "revision_id"), (labels, "signal_revision_id"),
                          (labels, "target_revision_id")):
        used = table.select(F.col(column).alias("revision_id")).distinct()
        rest = rest.join(used, "revision_id", "left_anti")
    return rest


def by_revision(table: DataFrame, revisions: DataFrame, revision_id: str, date: str = "trade_date") -> DataFrame:
    """Rows of the date a revision stands for (one-row broadcast, prunes date partitions)."""
    one = revisions.filter(F.col("revision_id") == revision_id).select(F.col("trade_date").alias(date), "revision_id")
    return table.join(F.broadcast(one), date)


def list_revisions(revisions: DataFrame, trade_date: str) -> DataFrame:
    return (revisions.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
            .withColumn("previous_revision_id", F.coalesce("previous_revision_id", F.lit("")))
            .orderBy(F.desc("revision_no")))
