"""Forward-return labels over sealed dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordinals import salted_left_join
from tidemark.operators.calendar import date_index, with_date_index
from tidemark.operators.features import usable
from tidemark.schemas import KEY

HORIZONS = (1, 3, 5, 10, 20)


def forward_paths(rows: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = KEY,
                  close: str = "close_price", index: str = "date_idx") -> DataFrame:
    """Add per horizon h the target close and the best and worst close on the way.

    One partitioning and sort serves all frames; range frames on the date index
    make a missing day simply absent, so no self-join is needed.
    """
    good = F.when(F.col(close) > 0, F.col(close))
    base = rows.withColumn("_close", good)
    w = Window.partitionBy(*keys).orderBy(index)
    frames = {}
    for h in horizons:
        frames[f"_target_{h}"] = F.first("_close").over(w.rangeBetween(h, h))
        frames[f"_best_{h}"] = F.max("_close").over(w.rangeBetween(1, h))
        frames[f"_worst_{h}"] = F.min("_close").over(w.rangeBetween(1, h))
    return base.withColumns(frames)


def forward_returns(rows: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = KEY,
                    close: str = "close_price", index: str = "date_idx") -> DataFrame:
    """Long form: one row per key, signal and horizon whose target close exists."""
    paths = forward_paths(rows, horizons, keys, close, index)
    per_horizon = F.array(*[
        F.struct(F.lit(h).alias("horizon"),
                 (F.col(f"_target_{h}") / F.col("_close") - 1).alias("return_rate"),
                 (F.col(f"_best_{h}") / F.col("_close") - 1).alias("max_favorable_return"),
                 (F.col(f"_worst_{h}") / F.col("_close") - 1).alias("max_adverse_return"))
        for h in horizons])
    carried = [c for c in rows.columns if c != close]
    return (paths.select(*carried, F.inline(per_horizon))
            .filter(F.col("return_rate").isNotNull()))


def future_labels(daily: DataFrame, industries: DataFrame | None = None, sealed: DataFrame | None = None,
                  horizons: Sequence[int] = HORIZONS, revisions: DataFrame | None = None,
                  changed: str | None = None) -> DataFrame:
    """Labels of every key and signal date, with the industry-relative return for stocks.

    ``industries`` (trade_date, stock_code, industry_code) is the signal-day
    industry.  ``changed`` limits the work to signals a resealed date can
    affect: its index minus the longest horizon up to the date itself.
    """
    index = date_index(sealed if sealed is not None else daily)
    longest = max(horizons)
    near, at = index, None
    if changed is not None:
        at = index.filter(F.col("trade_date") == F.lit(changed).cast("date")).agg(F.max("date_idx")).scalar()
        near = index.filter(F.col("date_idx").between(at - longest, at + longest))
    rows = with_date_index(usable(daily), near).select("trade_date", "date_idx", *KEY, "close_price")
    labels = forward_returns(rows, horizons)
    if changed is not None:
        labels = labels.filter(F.col("date_idx").between(at - longest, at))

    if industries is None:
        labels = labels.withColumn("relative_industry_return", F.lit(None).cast("double"))
    else:
        labels = industry_relative(labels, industries)
    targets = index.select(F.col("trade_date").alias("target_date"), F.col("date_idx").alias("_target_idx"))
    labels = (labels.withColumn("_target_idx", F.col("date_idx") + F.col("horizon"))
              .join(F.broadcast(targets), "_target_idx")
              .select(F.col("trade_date").alias("signal_date"), "target_date", "horizon", *KEY, "return_rate",
                      "relative_industry_return", "max_favorable_return", "max_adverse_return"))
    return attach_revisions(labels, revisions) if revisions is not None else labels


def industry_relative(labels: DataFrame, industries: DataFrame) -> DataFrame:
    """Stock return minus the return of its signal-day industry over the same dates.

    Many stocks share an industry, so the join on the industry is salted; the
    industry side has one row per industry, date and horizon.
    """
    held = industries.select("trade_date", F.lit("stock").alias("rank_type"), F.col("stock_code").alias("code"),
                             F.col("industry_code").alias("_industry"))
    boards = (labels.filter(F.col("rank_type") == "industry")
              .groupBy(F.col("code").alias("_industry"), "date_idx", "horizon")
              .agg(F.min_by("return_rate", "market").alias("_board_return")))
    known = labels.join(held, ["trade_date", "rank_type", "code"], "left")
    return (salted_left_join(known, boards, ["_industry", "date_idx", "horizon"], ["code", "market"])
            .withColumn("relative_industry_return", F.col("return_rate") - F.col("_board_return"))
            .drop("_industry", "_board_return"))


def attach_revisions(labels: DataFrame, revisions: DataFrame) -> DataFrame:
    """Add the current revision ids of both dates (revisions: one small row per date)."""
    ids = revisions.select("trade_date", "revision_id")
    signal = ids.select(F.col("trade_date").alias("signal_date"), F.col("revision_id").alias("signal_revision_id"))
    target = ids.select(F.col("trade_date").alias("target_date"), F.col("revision_id").alias("target_revision_id"))
    return labels.join(F.broadcast(signal), "signal_date").join(F.broadcast(target), "target_date")


def current_labels(labels: DataFrame, current: DataFrame, signal_revision: str | None = None,
                   target_revision: str | None = None, horizon: int | None = None) -> DataFrame:
    """Stored labels whose target revision is still current, or pinned to one target.

    ``current`` maps trade_date to the revision in force.
    """
    rows = labels
    if signal_revision is not None:
        rows = rows.filter(F.col("signal_revision_id") == signal_revision)
    if horizon:
        rows = rows.filter(F.col("horizon") == horizon)
    if target_revision is not None:
        rows = rows.filter(F.col("target_revision_id") == target_revision)
    else:
        now = current.select(F.col("trade_date").alias("target_date"), F.col("revision_id").alias("target_revision_id"))
        rows = rows.join(F.broadcast(now), ["target_date", "target_revision_id"], "left_semi")
    return rows.orderBy("horizon", "rank_type", "code")
