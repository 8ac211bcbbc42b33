"""Raw money ticks to checked five-minute money points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grid import CLOSE, POINTS, on_five_minute_grid, point_index
from tidemark.functions.scalars import clock_text


def parse_money_ticks(ticks: DataFrame, include_close: bool = True,
                      keys: Sequence[str] = ("trade_date", "rank_type", "market", "code"),
                      requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Money points of sound curves, and the rejected curves as (keys, reason).

    ``ticks`` has the keys (with the wanted trade_date), ``time`` as the number
    yyMMddHHmm, and the three amounts.  A curve is sound when every tick is of
    the wanted date and main = dark + regular on the grid, no point repeats and
    all 48 (47 without the close) are there.  Of ``requested`` keys, those
    without any tick are rejected as ``no_ticks``.
    """
    keys = list(keys)
    text = F.lpad(F.col("time").cast("string"), 10, "0")
    timed = ticks.withColumns({
        "_minute": (F.substring(text, 7, 2).cast("int") * 60 + F.substring(text, 9, 2).cast("int")),
        "_dated": F.substring(text, 1, 6) == F.date_format("trade_date", "yyMMdd")})
    last = CLOSE if include_close else CLOSE - 5
    wanted = on_five_minute_grid(F.col("_minute")) & (F.col("_minute") <= last)
    balanced = F.col("main_money_inflow") == F.col("dark_money") + F.col("regular_money")
    points = POINTS if include_close else POINTS - 1
    # A bit per grid point: a curve's state is one number, and a point that repeats adds a tick but no bit.
    bit = F.when(wanted, F.call_function("shiftleft", F.lit(1).cast("bigint"), point_index(F.col("_minute"))))
    verdict = timed.groupBy(*keys).agg(
        F.max(~F.col("_dated")).alias("_foreign"), F.max(wanted & ~balanced).alias("_unbalanced"),
        F.count_if(wanted).alias("_ticks"), F.bit_count(F.bit_or(bit)).alias("_seen")).select(
        *keys, "_foreign", "_unbalanced", F.coalesce("_seen", F.lit(0)).alias("_points"),
        (F.col("_ticks") > F.coalesce("_seen", F.lit(0))).alias("_repeated"))
    reason = (F.when(F.col("_foreign"), "wrong_date").when(F.col("_repeated"), "duplicate_point")
              .when(F.col("_unbalanced"), "inconsistent_money").when(F.col("_points") != points, "point_count"))
    judged = verdict.select(*keys, reason.alias("reason"))
    rejected = judged.filter(F.col("reason").isNotNull())
    if requested is not None:
        silent = requested.select(*keys).distinct().join(verdict.select(*keys), keys, "left_anti")
        rejected = rejected.unionByName(silent.withColumn("reason", F.lit("no_ticks")))
    # One row a curve is hashed; the ticks are not sorted.
    kept = judged.filter(F.col("reason").isNull()).select(*keys).hint("shuffle_hash")
    sound = timed.filter(wanted).join(kept, keys, "left_semi")
    at = F.concat_ws(" ", F.col("trade_date").cast("string"), clock_text(F.col("_minute"))).cast("timestamp_ntz")
    carried = [c for c in ticks.columns if c not in keys and c != "time"]
    return (sound.select(*keys, at.alias("snapshot_at"), *carried, F.col("time").alias("source_time")), rejected)
