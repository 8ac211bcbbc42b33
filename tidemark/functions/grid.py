"""The trading-session grid: 240 minutes, 48 five-minute points.

Minutes are counted since midnight.  The morning runs 09:31-11:30, the
afternoon 13:01-15:00; five-minute points stand at the end of each bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import clock_text

OPENING, MORNING_END, NOON_START, CLOSE = 9 * 60 + 30, 11 * 60 + 30, 13 * 60, 15 * 60
HALF_POINTS = 24
POINTS = 48
MINUTES = 240


def on_minute_grid(minute: Column) -> Column:
    return minute.between(OPENING + 1, MORNING_END) | minute.between(NOON_START + 1, CLOSE)


def on_five_minute_grid(minute: Column) -> Column:
    return on_minute_grid(minute) & (F.pmod(minute, F.lit(5)) == 0)


def point_index(minute: Column) -> Column:
    """0..47 for a five-minute point, NULL off the grid."""
    index = F.when(minute <= MORNING_END, (minute - OPENING) / 5 - 1).otherwise(
        HALF_POINTS + (minute - NOON_START) / 5 - 1)
    return F.when(on_five_minute_grid(minute), index.cast("int"))


def bar_index(minute: Column) -> Column:
    """Bar 0..47 a one-minute row falls in; 09:30 joins bar 0; NULL elsewhere."""
    morning = F.greatest(F.floor((minute - OPENING - 1) / 5), F.lit(0))
    afternoon = HALF_POINTS + F.floor((minute - NOON_START - 1) / 5)
    return F.when(minute.between(OPENING, MORNING_END), morning).when(
        minute.between(NOON_START + 1, CLOSE), afternoon).cast("int")


def index_minute(index: Column) -> Column:
    """Minute of day of point ``index``."""
    return F.when(index < HALF_POINTS, OPENING + (index + 1) * 5).otherwise(
        NOON_START + (index - HALF_POINTS + 1) * 5).cast("int")


def index_clock(index: Column) -> Column:
    return clock_text(index_minute(index))


def grid_array(step: int = 1, until: int = CLOSE) -> Column:
    """Expected minutes of a session as one array literal."""
    return F.concat(
        F.sequence(F.lit(OPENING + step), F.lit(MORNING_END), F.lit(step)),
        F.sequence(F.lit(NOON_START + step), F.lit(until), F.lit(step)))


def session_grid(spark: SparkSession, step: int = 1) -> DataFrame:
    """Expected clocks of one session: (position, minute, clock)."""
    return (spark.range(1).select(F.posexplode(grid_array(step)).alias("position", "minute"))
            .withColumn("clock", clock_text(F.col("minute"))))
