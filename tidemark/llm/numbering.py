"""Gapless row numbers along a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

_INDEX_BITS = 33  # of a generated id, the bits that count rows inside a partition


def numbered(df: DataFrame, order: Sequence[Column], keep: Sequence[str | Column], out: str = "row") -> tuple[DataFrame, int]:
    """Columns ``keep`` of all rows with ``out``, their number from 0 along ``order``, and how many rows there are (eager).

    Rows are dealt by ranges of ``order`` and sorted inside a range, so neither
    a window nor a task ever holds more than one range; rows that are equal in
    ``order`` are dealt by the place they were read from, so that not even a
    third of all rows with one key makes a large range.  Only ``keep`` is
    stored.  Range bounds come from a sample, hence the stored copy: numbers
    are the same after a retry.  One row count a range comes to the driver.

    Rows equal in ``order`` are numbered in no stated sequence: name enough
    columns that such rows need not be told apart.
    """
    spark = df.sparkSession
    tie = "__tie"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(tie))
    ranged = stored(dealt.sortWithinPartitions(*order, F.col(tie)).select(*keep, F.monotonically_increasing_id().alias(tie)))
    slice_of = F.shiftright(tie, _INDEX_BITS)
    sizes = {r["slice"]: r["n"] for r in ranged.groupBy(slice_of.alias("slice")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    before = spark.createDataFrame(starts, "__slice long, __before long")
    inside = F.col(tie).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    rows = (ranged.withColumn("__slice", slice_of).join(F.broadcast(before), "__slice")  # a row a range
            .withColumn(out, F.col("__before") + inside))
    return rows.drop("__slice", "__before", tie), total
