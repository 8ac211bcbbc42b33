"""Multi-day condition screening with an explanation for every candidate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_main_board, is_special_treatment
from tidemark.operators.calendar import complete_dates

# Screenable fields by what must have been observed for them.
ALWAYS = ("turnover", "turnover_rate", "change_pct", "close_price", "amplitude", "volume")
NEED_MONEY = ("control_coefficient", "dark_money", "regular_money", "main_money_inflow")
NEED_RANK = ("dark_activity", "dark_inflow_ratio", "rank", "up_count", "flat_count", "down_count")
FIELDS = ALWAYS + NEED_MONEY + NEED_RANK
OPERATORS = ("gt", "gte", "lt", "lte", "eq", "between")


class InvalidScan(ValueError):
    """The request breaks a limit; raised before any job starts."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: float
    max_value: float | None = None


@dataclass(frozen=True)
class Scope:
    main_board_only: bool = False
    exclude_st: bool = False
    require_qualified_concepts: bool = False


@dataclass(frozen=True)
class ScanRequest:
    as_of: str
    consecutive_days: int
    concept_conditions: Sequence[Condition] = ()
    stock_conditions: Sequence[Condition] = ()
    concept_match: str = "all"
    stock_match: str = "all"
    scope: Scope = field(default_factory=Scope)


def default_request(as_of: str) -> ScanRequest:
    """The standing three-day template (fixed values)."""
    def template(turnover: float) -> tuple[Condition, ...]:
        return (Condition("turnover", "gt", turnover), Condition("turnover_rate", "gt", 0.03),
                Condition("change_pct", "between", 0.01, 0.06),
                Condition("control_coefficient", "between", 1.5, 6.0))

    return ScanRequest(as_of, 3, template(5e10), template(2e8), scope=Scope(True, True, True))


def validate(request: ScanRequest) -> ScanRequest:
    if not request.as_of:
        raise InvalidScan("as_of is required")
    if request.consecutive_days < 1:
        raise InvalidScan("consecutive_days must be at least 1")
    for mode in (request.concept_match, request.stock_match):
        if mode not in ("all", "any"):
            raise InvalidScan("match must be all or any")
    for side in (request.concept_conditions, request.stock_conditions):
        for c in side:
            if c.field not in FIELDS or c.operator not in OPERATORS:
                raise InvalidScan(f"unsupported condition {c.field} {c.operator}")
            if not math.isfinite(c.value):
                raise InvalidScan("value must be finite")
            if c.operator == "between" and (
                    c.max_value is None or not math.isfinite(c.max_value) or c.max_value < c.value):
                raise InvalidScan("between needs max_value >= value")
    return request


# Why a candidate is turned down, in the order the reasons apply.
REASONS = ("non_main_board", "st_excluded", "missing_daily_close", "condition_failed")


# -- one day -----------------------------------------------------------------

METRICS = ("turnover", "turnover_rate", "change_pct", "dark_money", "regular_money", "main_money_inflow",
           "dark_activity", "dark_inflow_ratio", "rank", "close_price", "amplitude", "volume", "up_count",
           "flat_count", "down_count")


def with_metrics(rows: DataFrame) -> DataFrame:
    """Add the control coefficient (0 unless turnover is positive) and rank_available."""
    control = F.when(F.col("turnover") > 0,
                     (F.col("regular_money") + F.col("dark_money")).cast("double") / F.col("turnover") * 100)
    return rows.withColumns({"control_coefficient": F.coalesce(control, F.lit(0.0)),
                             "rank_available": F.col("rank") > 0})


def field_available(name: str) -> Column:
    if name in NEED_MONEY:
        return F.col("money_available")
    if name in NEED_RANK:
        return F.col("rank_available")
    return F.lit(True)


def condition_passes(c: Condition) -> Column:
    """Comparison of one field; an unavailable field fails every operator."""
    actual = F.col(c.field).cast("double")
    compared = {
        "gt": actual > c.value, "gte": actual >= c.value, "lt": actual < c.value, "lte": actual <= c.value,
        "eq": actual == c.value,
    }
    hit = actual.between(c.value, c.max_value) if c.operator == "between" else compared[c.operator]
    return F.coalesce(field_available(c.field) & hit, F.lit(False))


def evaluation(conditions: Sequence[Condition], mode: str) -> Column:
    """Struct (trade_date, matched, conditions[...]) of a row; no conditions always match."""
    details = [F.struct(F.lit(c.field).alias("field"), F.lit(c.operator).alias("operator"),
                        F.lit(float(c.value)).alias("value"),
                        F.lit(None if c.max_value is None else float(c.max_value)).cast("double").alias("max_value"),
                        F.col(c.field).cast("double").alias("actual_value"),
                        field_available(c.field).alias("available"), condition_passes(c).alias("passed"))
               for c in conditions]
    matched = F.lit(True)
    if conditions:
        tests = [condition_passes(c) for c in conditions]
        matched = tests[0]
        for test in tests[1:]:
            matched = (matched & test) if mode == "all" else (matched | test)
    empty = "array<struct<field:string,operator:string,value:double,max_value:double,actual_value:double," \
            "available:boolean,passed:boolean>>"
    listed = F.array(*details) if details else F.from_json(F.lit("[]"), empty)
    return F.struct(F.col("trade_date").alias("trade_date"), matched.alias("matched"), listed.alias("conditions"))


def present_all_days(rows: DataFrame, keys: Sequence[str], days: int | Column, date: str = "trade_date") -> DataFrame:
    """Keys seen on every one of ``days`` dates."""
    return (rows.groupBy(*keys).agg(F.count_distinct(date).alias("_n")).filter(F.col("_n") == days).drop("_n"))


def day_runs(rows: DataFrame, keys: Sequence[str], conditions: Sequence[Condition], mode: str) -> DataFrame:
    """Per key over the scanned days: what was present, what failed first, all days.

    ``rows`` holds scanned days only, one row per key and day, so the arrays
    have one element a scanned day.
    """
    metric = F.struct("trade_date", *METRICS, "control_coefficient", "money_available", "rank_available")
    judged = with_metrics(rows).withColumn("_eval", evaluation(conditions, mode))
    failed = ~F.col("_eval.matched")
    return judged.groupBy(*keys).agg(
        F.max_by("name", "trade_date").alias("_name"),
        F.collect_set("trade_date").alias("_present"),
        F.min(F.when(failed, F.col("trade_date"))).alias("_failed_date"),
        F.min_by("_eval", F.when(failed, F.col("trade_date"))).alias("_failed_eval"),
        F.array_sort(F.collect_list(metric)).alias("days"),
        F.array_sort(F.collect_list("_eval")).alias("evaluations"),
        F.max_by("control_coefficient", "trade_date").alias("_last_control"))


# -- the scan ----------------------------------------------------------------

@dataclass(frozen=True)
class ScanResult:
    """``rejections`` is the full set; ``rejection_page`` cuts a page of it."""

    dates: DataFrame
    concepts: DataFrame
    stocks: DataFrame
    rejections: DataFrame
    stats: DataFrame


def scan_dates(daily: DataFrame, request: ScanRequest, counts: DataFrame | None = None) -> DataFrame:
    """The last n complete dates, or no row at all when there are fewer; with ``counts`` the closes are not read."""
    chosen = complete_dates(daily, request.as_of, request.consecutive_days, counts=counts)
    listed = chosen.agg(F.array_sort(F.collect_list("trade_date")).alias("_d"))
    return (listed.filter(F.size("_d") == request.consecutive_days)
            .select(F.explode("_d").alias("trade_date")))


def screen_concepts(rows: DataFrame, request: ScanRequest) -> DataFrame:
    """All concepts present on every scanned day, with ``reason`` NULL when qualified."""
    n = request.consecutive_days
    runs = day_runs(rows.filter((F.col("rank_type") == "concept") & F.col("quote_available")), ["code"],
                    request.concept_conditions, request.concept_match)
    return (runs.filter(F.size("_present") == n)
            .select("code", F.col("_name").alias("name"), "days", "evaluations", "_last_control",
                    F.when(F.col("_failed_date").isNotNull(), "condition_failed").alias("reason"),
                    F.col("_failed_date").alias("failed_date"), F.col("_failed_eval").alias("evaluation")))


def stocks_of_concepts(members: DataFrame, concepts: DataFrame) -> DataFrame:
    """Universe: members of the given concepts with their concepts in code order.

    A repeated stock takes name and market from its last board.  The array is
    bounded by the concept catalog; distinct edges go in.
    """
    named = concepts.select(F.col("code").alias("board_code"), F.col("name").alias("_concept"))
    edges = (members.filter(F.col("board_type") == "concept")
             .select("stock_code", "stock_market", "stock_name", "board_code").distinct().join(named, "board_code"))
    return (edges.groupBy(F.col("stock_code").alias("code"))
            .agg(F.max_by(F.struct("stock_market", "stock_name"), "board_code").alias("_s"),
                 F.array_sort(F.collect_list(F.struct(F.col("board_code").alias("code"),
                                                      F.col("_concept").alias("name")))).alias("concepts"))
            .select("code", F.col("_s.stock_market").alias("market"), F.col("_s.stock_name").alias("name"), "concepts"))


def screen_stocks(rows: DataFrame, universe: DataFrame, dates: DataFrame, request: ScanRequest) -> DataFrame:
    """Every stock of the universe with its days, or the first reason it fails."""
    runs = day_runs(rows.filter((F.col("rank_type") == "stock") & F.col("quote_available")), ["market", "code"],
                    request.stock_conditions, request.stock_match).drop("_name")
    expected = dates.agg(F.array_sort(F.collect_list("trade_date"))).scalar()
    joined = (universe.join(runs, ["market", "code"], "left")
              .withColumn("_missing", F.array_min(F.array_except(
                  expected, F.coalesce("_present", F.array().cast("array<date>"))))))
    scope = request.scope
    missing_first = F.col("_missing").isNotNull() & (
        F.col("_failed_date").isNull() | (F.col("_missing") < F.col("_failed_date")))
    off_board = ~is_main_board(F.col("market"), F.col("code")) if scope.main_board_only else F.lit(False)
    special = is_special_treatment(F.col("name")) if scope.exclude_st else F.lit(False)
    tests = (off_board, special, missing_first, F.col("_failed_date").isNotNull())
    reason = F.coalesce(*[F.when(test, name) for test, name in zip(tests, REASONS)])
    judged = joined.withColumn("reason", reason)
    failing = F.col("reason") == "condition_failed"
    return judged.select(
        "market", "code", "name", "concepts", "days", "evaluations", "_last_control", "reason",
        F.when(F.col("reason") == "missing_daily_close", F.col("_missing"))
        .when(failing, F.col("_failed_date")).alias("failed_date"),
        F.when(failing, F.col("_failed_eval")).alias("evaluation"))


def focus_scan(daily: DataFrame, members: DataFrame, request: ScanRequest, counts: DataFrame | None = None) -> ScanResult:
    """Dates, concept screen, universe, stock screen, explanations, counters.

    ``members`` are the edges in force on the scan's last day
    (``members_as_of``).  The scanned dates are one row a day, so the daily
    table is cut by a broadcast join that prunes its date partitions.  With
    ``counts`` (``date_completeness``, as the writers keep it) finding the dates
    reads a row a date, and no other partition of the closes is ever read.
    """
    validate(request)
    dates = scan_dates(daily, request, counts)
    rows = daily.join(F.broadcast(dates), "trade_date", "left_semi")
    concepts = screen_concepts(rows, request)
    qualified = concepts.filter(F.col("reason").isNull())
    if request.scope.require_qualified_concepts:
        universe = stocks_of_concepts(members, qualified)
    else:
        last = dates.agg(F.max("trade_date")).scalar()
        universe = (rows.filter((F.col("rank_type") == "stock") & F.col("quote_available")
                                & (F.col("trade_date") == last))
                    .select("code", "market", "name",
                            F.array().cast("array<struct<code:string,name:string>>").alias("concepts")))
    stocks = screen_stocks(rows, universe, dates, request)
    chosen = stocks.filter(F.col("reason").isNull())
    rejected = (concepts.select(F.lit("concept").alias("kind"), F.lit(0).cast("bigint").alias("market"), "code", "name",
                                "reason", "failed_date", "evaluation")
                .unionByName(stocks.select(F.lit("stock").alias("kind"), "market", "code", "name", "reason",
                                           "failed_date", "evaluation"))
                .filter(F.col("reason").isNotNull()))
    order = [F.desc("_last_control"), F.asc("code")]
    return ScanResult(
        dates, qualified.orderBy(*order).select("code", "name", "days", "evaluations"),
        chosen.orderBy(*order).select("market", "code", "name", "concepts", "days", "evaluations"),
        rejected, scan_stats(concepts, stocks))


def rejection_page(rejections: DataFrame, page: int, size: int) -> DataFrame:
    """One page of rejections by kind, code and market."""
    if page < 1 or size < 1:
        raise ValueError("page and size from 1")
    return rejections.orderBy("kind", "code", "market").offset((page - 1) * size).limit(size)


def scan_stats(concepts: DataFrame, stocks: DataFrame) -> DataFrame:
    """One row of counters."""
    both = (concepts.select(F.lit("concept").alias("kind"), "reason")
            .unionByName(stocks.select(F.lit("stock").alias("kind"), "reason")))
    concept, stock, fine = F.col("kind") == "concept", F.col("kind") == "stock", F.col("reason").isNull()
    return both.agg(
        F.count_if(concept).alias("concepts_evaluated"), F.count_if(concept & fine).alias("concepts_qualified"),
        F.count_if(stock).alias("stocks_evaluated"), F.count_if(stock & fine).alias("stocks_qualified"),
        F.count_if(F.col("reason") == "non_main_board").alias("non_main_board_excluded"),
        F.count_if(F.col("reason") == "st_excluded").alias("st_excluded"),
        F.count_if(F.col("reason") == "missing_daily_close").alias("missing_record_excluded"))
