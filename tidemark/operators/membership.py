"""Board membership over time: baseline, change events, as-of views, full-scan diffs.

Tables (see ``schemas``): ``baseline`` has a full listing per baseline date,
``changes`` the later added/removed events.  An edge is one
(stock, board, source, scope).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["stock_code", "board_code", "relation_source", "relation_scope"]
ATTRIBUTES = ["stock_market", "stock_name", "board_name", "board_type", "source_order", "detected_at", "raw_data"]
RELATION_COLUMNS = ["stock_code", "stock_market", "stock_name", "board_code", "board_name", "board_type",
                    "source_order", "relation_source", "relation_scope", "detected_at", "raw_data"]

# Guards against a truncated upstream listing: share of the previous state a
# scan must keep, and the sizes from which the guards apply.
KEEP_PERCENT, MIN_EDGES, MIN_BOARDS = 90, 1000, 100


def _events(baseline: DataFrame, changes: DataFrame) -> DataFrame:
    start = baseline.select(F.col("baseline_date").alias("effective_date"), F.lit("added").alias("change_type"),
                            *RELATION_COLUMNS)
    return start.unionByName(changes.select("effective_date", "change_type", *RELATION_COLUMNS))


def _recency() -> Column:
    """Order of events on one edge; at a full tie the removal counts as later."""
    return F.struct("effective_date", "detected_at", "change_type")


def _last_events(events: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Latest event per key as a map-side combined aggregate (no window, no skewed sort)."""
    return (events.groupBy(*keys)
            .agg(F.max_by(F.struct("effective_date", "change_type", *carried), _recency()).alias("_e"))
            .select(*keys, "_e.*"))


def members_as_of(baseline: DataFrame, changes: DataFrame, as_of: str, stock_code: str | None = None,
                  board_type: str | None = None, boards: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Edges in force on a date: latest baseline up to it plus the changes since.

    ``boards`` is one or more board codes, or a DataFrame with ``board_code``
    (joined, so any number of boards goes in one pass).  Filters are applied
    before the aggregate and reach the scan.  Without a baseline the result is
    empty.  Attributes are those of the winning event.
    """
    day = F.lit(as_of).cast("date")

    def narrowed(table: DataFrame) -> DataFrame:
        if stock_code is not None:
            table = table.filter(F.col("stock_code") == stock_code)
        if board_type is not None:
            table = table.filter(F.col("board_type") == board_type)
        if isinstance(boards, DataFrame):
            table = table.join(boards.select("board_code").distinct(), "board_code", "left_semi")
        elif boards is not None:
            table = table.filter(F.col("board_code").isin(*[b for b in boards if b]))
        return table

    chosen = baseline.filter(F.col("baseline_date") <= day).agg(F.max("baseline_date")).scalar()
    events = _events(narrowed(baseline).filter(F.col("baseline_date") == chosen),
                     narrowed(changes).filter((F.col("effective_date") >= chosen) & (F.col("effective_date") <= day)))
    carried = [c for c in RELATION_COLUMNS if c not in EDGE]
    return (_last_events(events, EDGE, carried).filter(F.col("change_type") == "added")
            .select(*RELATION_COLUMNS, "effective_date"))


def stock_boards(members: DataFrame) -> DataFrame:
    return members.orderBy("board_type", "source_order", "board_code")


def board_stocks(members: DataFrame) -> DataFrame:
    return members.orderBy("board_code", "stock_code")


def changes_on(changes: DataFrame, trade_date: str, board_type: str | None = None) -> DataFrame:
    rows = changes.filter(F.col("effective_date") == F.lit(trade_date).cast("date"))
    if board_type is not None:
        rows = rows.filter(F.col("board_type") == board_type)
    return rows.orderBy("change_type", "board_type", "board_code", "stock_code")


def membership_intervals(baseline: DataFrame, changes: DataFrame, keys: Sequence[str] = EDGE,
                         attributes: Sequence[str] = ATTRIBUTES, by: Sequence[str] = ()) -> DataFrame:
    """Validity intervals ``[valid_from, valid_to)`` of every edge; open ones end in NULL.

    Events are reduced to one per edge and day before the window, so a window
    partition holds at most one row per day.  ``by`` names keys to deal the
    events by once; steps that group by these and more then exchange nothing.
    """
    keys = list(keys)
    attributes = [a for a in attributes if a not in keys]
    events = _events(baseline, changes).withColumn("_day", F.col("effective_date"))
    daily = _last_events(events.repartition(*by) if by else events, keys + ["_day"], attributes)
    w = Window.partitionBy(*keys).orderBy("_day")
    return (daily.withColumn("valid_to", F.lead("_day").over(w))
            .filter(F.col("change_type") == "added")
            .select(*keys, *attributes, F.col("_day").alias("valid_from"), "valid_to"))


def members_by_date(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """One row per edge and sealed date it is in force on.

    Interval ends become date positions through a broadcast calendar (one row
    per calendar day of the sealed range); expanding positions then yields
    exactly the result rows, with no range join.
    """
    low = index.agg(F.min("trade_date")).scalar()
    beyond = index.agg(F.date_add(F.max("trade_date"), 1)).scalar()
    days = index.agg(F.explode(F.sequence(F.min("trade_date"), F.date_add(F.max("trade_date"), 1))).alias("day"))
    position = (days.join(F.broadcast(index.withColumnRenamed("trade_date", "day")), "day", "left")
                .select("day", F.count("date_idx").over(
                    Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("at")))
    kept = [c for c in intervals.columns if c not in ("valid_from", "valid_to")]
    held = (intervals.withColumns({"_from": F.greatest("valid_from", low),
                                   "_to": F.least(F.coalesce("valid_to", beyond), beyond)})
            .filter(F.col("_from") < F.col("_to"))
            .join(F.broadcast(position.toDF("_from", "_first")), "_from")
            .join(F.broadcast(position.toDF("_to", "_end")), "_to")
            .filter(F.col("_first") < F.col("_end")))
    return (held.select(*kept, F.explode(F.sequence(F.col("_first").cast("int"), (F.col("_end") - 1).cast("int"))).alias("date_idx"))
            .join(F.broadcast(index), "date_idx"))


def primary_industry(baseline: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """(stock_code, industry_code): the active industry with the lowest (order, code) on a date.

    Here an edge is (stock, board) whatever source reported it.
    """
    day = F.lit(as_of).cast("date")
    chosen = baseline.filter(F.col("baseline_date") <= day).agg(F.max("baseline_date")).scalar()
    industry = F.col("board_type") == "industry"
    events = _events(baseline.filter(industry & (F.col("baseline_date") == chosen)),
                     changes.filter(industry & (F.col("effective_date") >= chosen) & (F.col("effective_date") <= day)))
    active = _last_events(events, ["stock_code", "board_code"], ["source_order"]).filter(F.col("change_type") == "added")
    return (active.groupBy("stock_code").agg(F.min(F.struct("source_order", "board_code"))["board_code"]
                                             .alias("industry_code")))


def primary_industry_spans(baseline: DataFrame, changes: DataFrame) -> DataFrame:
    """(stock_code, industry_code, valid_from, valid_to): the primary industry of each stock between its own boundaries.

    The days on which an industry of a stock begins or ends cut its time; in
    each piece the lowest active (order, code) leads.  Work follows a stock's own
    events, not the calendar, and neighbouring pieces of one industry are one.
    The events are dealt by stock once; every step after that stays in place.
    """
    industry = F.col("board_type") == "industry"
    spans = membership_intervals(baseline.filter(industry), changes.filter(industry), ["stock_code", "board_code"], ["source_order"],
                                 ["stock_code"])
    own = Window.partitionBy("stock_code").orderBy("valid_from")
    # Both ends of a span as rows, placed among the days of their stock; an open end comes last.
    ends = spans.select("*", F.explode(F.when(F.col("valid_from").isNull(), F.array("valid_to"))
                                       .otherwise(F.array("valid_from", "valid_to"))).alias("_at"))
    placed = ends.withColumn("_place", F.dense_rank().over(Window.partitionBy("stock_code").orderBy(F.asc_nulls_last("_at"))))
    span = Window.partitionBy("stock_code", "board_code", "valid_from").orderBy("_place")
    reach = placed.withColumn("_end", F.lead("_place").over(span)).filter(F.col("_end").isNotNull() | F.col("_at").isNotNull())
    begins = F.col("_end").isNotNull()
    each = reach.select("stock_code", "_place", "_at", F.when(begins, F.struct("source_order", "board_code")).alias("_active"), F.explode(
        F.when(begins, F.sequence("_place", F.col("_end") - 1)).otherwise(F.array("_place"))).alias("_piece"))
    pieces = (each.groupBy("stock_code", "_piece")
              .agg(F.max(F.when(F.col("_piece") == F.col("_place"), F.col("_at"))).alias("valid_from"), F.min("_active").alias("_first"))
              .withColumn("valid_to", F.lead("valid_from").over(own)).filter(F.col("_first").isNotNull())
              .select("stock_code", "valid_from", "valid_to", F.col("_first")["board_code"].alias("industry_code")))
    # A piece goes on with the one before if that has the same industry and ends where it begins.
    goes_on = (F.lag("industry_code").over(own) == F.col("industry_code")) & (F.lag("valid_to").over(own) == F.col("valid_from"))
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(own)
    last = F.max(F.struct("valid_from", "valid_to"))["valid_to"]
    return (pieces.withColumn("_run", run).groupBy("stock_code", "industry_code", "_run")
            .agg(F.min("valid_from").alias("valid_from"), last.alias("valid_to")).drop("_run"))


def primary_industry_by_date(baseline: DataFrame, changes: DataFrame, index: DataFrame) -> DataFrame:
    """(trade_date, stock_code, industry_code) for all sealed dates in one plan: a row a result, none an edge and date."""
    return members_by_date(primary_industry_spans(baseline, changes), index).select("trade_date", "stock_code", "industry_code")


def members_from_snapshot(snapshot: DataFrame, deltas: DataFrame, as_of: str, board_type: str | None = None) -> DataFrame:
    """Edges in force on a date from the members of an earlier one and the changes since (see ``sources.memberships``).

    ``snapshot`` has the columns of ``members_as_of``; the rows of ``deltas`` are
    later than it.
    """
    since = deltas.filter(F.col("effective_date") <= F.lit(as_of).cast("date"))
    if board_type is not None:
        snapshot, since = (x.filter(F.col("board_type") == board_type) for x in (snapshot, since))
    columns = ["effective_date", "change_type", *RELATION_COLUMNS]
    events = snapshot.withColumn("change_type", F.lit("added")).select(*columns).unionByName(since.select(*columns))
    carried = [c for c in RELATION_COLUMNS if c not in EDGE]
    return (_last_events(events, EDGE, carried).filter(F.col("change_type") == "added")
            .select(*RELATION_COLUMNS, "effective_date"))


def snapshot_diff(previous: DataFrame, scan: DataFrame, keys: Sequence[str] = EDGE) -> DataFrame:
    """Edges only in ``scan`` ('added') or only in ``previous`` ('removed'), both unique on ``keys``."""
    keys = list(keys)
    old = previous.select(*keys, F.lit(True).alias("_old"))
    new = scan.select(*keys, F.lit(True).alias("_new"))
    return (old.join(new, keys, "full_outer")
            .filter(F.col("_old").isNull() | F.col("_new").isNull())
            .select(*keys, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change_type")))


def scans_to_events(scans: DataFrame, keys: Sequence[str], date: str, index: DataFrame, unique: bool = False) -> DataFrame:
    """Change events between consecutive full scans of many dates at once.

    ``index`` maps each scan date to its position.  An edge is added where the
    previous scan lacks it and removed at the next scan that lacks it; every
    edge appears once per scan date, so its window is as long as the calendar.
    ``unique`` says that no scan lists an edge twice, which saves an exchange.
    """
    keys = list(keys)
    listed = scans.select(*keys, date)
    seen = (listed if unique else listed.distinct()).join(F.broadcast(index), date)
    last = index.agg(F.max("date_idx")).scalar()
    w = Window.partitionBy(*keys).orderBy("date_idx")
    marked = seen.select(*keys, "date_idx", F.lag("date_idx").over(w).alias("_before"),
                         F.lead("date_idx").over(w).alias("_after"))
    added = F.when((F.col("date_idx") > 0) & (F.coalesce(F.col("_before"), F.lit(-2)) != F.col("date_idx") - 1),
                   F.struct(F.col("date_idx").alias("at"), F.lit("added").alias("change_type")))
    removed = F.when((F.col("date_idx") < last) & (F.coalesce(F.col("_after"), F.lit(-2)) != F.col("date_idx") + 1),
                     F.struct((F.col("date_idx") + 1).alias("at"), F.lit("removed").alias("change_type")))
    return (marked.select(*keys, F.inline(F.array_compact(F.array(added, removed))))
            .join(F.broadcast(index.select(F.col("date_idx").alias("at"), F.col(date).alias("effective_date"))), "at")
            .select(*keys, "effective_date", "change_type"))


def relation_errors(rows: DataFrame, industry_catalog: DataFrame | None = None,
                    concept_catalog: DataFrame | None = None) -> DataFrame:
    """Rows (and catalog codes) a scan must not contain, as (stock_code, board_code, reason)."""
    reason = (F.when((F.coalesce("stock_code", F.lit("")) == "") | (F.coalesce("board_code", F.lit("")) == ""),
                     "empty_code")
              .when(~F.coalesce(F.col("board_type").isin("industry", "concept"), F.lit(False)), "unknown_board_type"))
    bad = rows.select("stock_code", "board_code", reason.alias("reason")).filter(F.col("reason").isNotNull())
    if industry_catalog is not None and concept_catalog is not None:
        both = (industry_catalog.select("board_code").join(concept_catalog.select("board_code"), "board_code", "left_semi")
                .distinct().select(F.lit("").alias("stock_code"), "board_code", F.lit("in_both_catalogs").alias("reason")))
        bad = bad.unionByName(both)
    return bad


@dataclass(frozen=True)
class ScanOutcome:
    """Frames a membership scan leads to; nothing is written yet.

    ``summary`` is one row: status, reason, relation_count, board_count,
    added_count, removed_count, baseline_built.  Status is one of ``baseline``,
    ``unchanged`` (keep everything as it is), ``applied``, ``rejected``.
    """

    baseline: DataFrame
    changes: DataFrame
    current: DataFrame
    summary: DataFrame


def apply_membership_scan(scan: DataFrame, baseline: DataFrame, current: DataFrame, changes: DataFrame,
                          trade_date: str, detected_at: Column, run_id: str) -> ScanOutcome:
    """Turn one complete scan into change events and a new current state.

    A rerun on the same day starts from the state before that day's events and
    replaces them.  ``changes`` of the outcome holds the day's events only.
    """
    day = F.lit(trade_date).cast("date")
    today = changes.filter(F.col("effective_date") == day)
    back = (today.filter(F.col("change_type") == "removed")
            .select(*RELATION_COLUMNS, F.col("effective_date").alias("since_date")))
    kept = current.select(*RELATION_COLUMNS, "since_date").join(
        today.filter(F.col("change_type") == "added").select(*EDGE), EDGE, "left_anti")
    # An edge both kept and restored keeps its since_date and takes the restored attributes.
    older = kept.select(*EDGE, F.col("since_date").alias("_since"))
    only_kept = kept.join(back.select(*EDGE), EDGE, "left_anti")
    restored = (back.join(older, EDGE, "left").withColumn("since_date", F.coalesce("_since", "since_date"))
                .drop("_since"))
    previous = only_kept.unionByName(restored)

    diff = snapshot_diff(previous, scan)
    added = (scan.select(*RELATION_COLUMNS).join(diff.filter(F.col("change_type") == "added").select(*EDGE), EDGE)
             .withColumn("change_type", F.lit("added")))
    removed = (previous.select(*RELATION_COLUMNS)
               .join(diff.filter(F.col("change_type") == "removed").select(*EDGE), EDGE)
               .withColumn("change_type", F.lit("removed")))
    events = (added.unionByName(removed)
              .withColumns({"effective_date": day, "detected_at": detected_at, "run_id": F.lit(run_id)})
              .select("effective_date", "change_type", *RELATION_COLUMNS, "run_id"))
    state = (scan.select(*RELATION_COLUMNS)
             .join(previous.select(*EDGE, "since_date"), EDGE, "left")
             .withColumn("since_date", F.coalesce("since_date", day)))
    first = scan.select(day.alias("baseline_date"), *RELATION_COLUMNS)
    return ScanOutcome(first, events, state, _scan_summary(scan, baseline, current, previous, diff))


def _scan_summary(scan: DataFrame, baseline: DataFrame, current: DataFrame, previous: DataFrame, diff: DataFrame) -> DataFrame:
    board = F.concat_ws(":", "board_type", "board_code")

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(board).alias("b")).select(
            F.lit(name).alias("part"), "n", "b")

    moved = snapshot_diff(current, scan).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("moved").alias("part"), "n", F.lit(0).cast("bigint").alias("b"))
    changed = diff.agg(F.count_if(F.col("change_type") == "added").alias("n"),
                       F.count_if(F.col("change_type") == "removed").alias("b")).select(
        F.lit("diff").alias("part"), "n", "b")
    parts = (tagged(scan, "scan").unionByName(tagged(current, "current")).unionByName(tagged(previous, "previous"))
             .unionByName(tagged(baseline, "baseline")).unionByName(moved).unionByName(changed))

    def of(part: str, column: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(column)))

    row = parts.agg(of("scan", "n").alias("relation_count"), of("scan", "b").alias("board_count"),
                    of("baseline", "n").alias("_baseline"), of("current", "n").alias("_current"), of("previous", "n").alias("_previous"),
                    of("previous", "b").alias("_previous_boards"), of("moved", "n").alias("_moved"),
                    of("diff", "n").alias("added_count"), of("diff", "b").alias("removed_count"))
    shrunk = ((F.col("_previous") >= MIN_EDGES)
              & (F.col("relation_count") * 100 < F.col("_previous") * KEEP_PERCENT))
    fewer = ((F.col("_previous_boards") >= MIN_BOARDS)
             & (F.col("board_count") * 100 < F.col("_previous_boards") * KEEP_PERCENT))
    moved = F.col("_moved") > 0
    reason = (F.when(F.col("relation_count") == 0, "empty_scan").when(F.col("_baseline") == 0, "")
              .when(F.col("_current") == 0, "current_state_missing").when(moved & shrunk, "fewer_relations")
              .when(moved & fewer, "fewer_boards").otherwise(""))
    status = (F.when(F.col("reason") != "", "rejected").when(F.col("_baseline") == 0, "baseline")
              .when(~moved, "unchanged").otherwise("applied"))
    applied = F.col("status") == "applied"
    return (row.withColumn("reason", reason).withColumn("status", status)
            .select("status", "reason", "relation_count", "board_count",
                    F.when(applied, F.col("added_count")).otherwise(0).alias("added_count"),
                    F.when(applied, F.col("removed_count")).otherwise(0).alias("removed_count"),
                    (F.col("status") == "baseline").alias("baseline_built")))
