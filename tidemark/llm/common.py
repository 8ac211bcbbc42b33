"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tidemark_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Return to the system what earlier work of this Python worker freed.

    Workers serve one stage after another, and allocators keep what was freed
    beside the executor's heap; a stage that needs much memory starts with this.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of some C libraries only
    if trim is not None:
        trim(0)


def on_text(spark: SparkSession, make: Callable[[], Callable[[str | None], object]], kind: str) -> Callable[[Column], Column]:
    """A column function from text to ``kind``, run on Arrow batches (a dict per text for several fields).

    ``make`` builds the per-text function once per task (models are read
    there, not per row).  Rows keep all their other columns in the JVM, so
    neither extra columns nor their types reach Python.
    """
    ship(spark)

    kind = DataType.fromDDL(kind)
    many = isinstance(kind, StructType)

    def values(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()
        for batch in texts:
            yield pd.Series([one(x) for x in batch], dtype=object)

    def structs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in texts:
            yield pd.DataFrame([one(x) for x in batch], columns=kind.names)

    return F.pandas_udf(structs if many else values, kind)


def fold(doc_id: str | Column, parts: int) -> Column:
    """CRC-32 of the id written as text, modulo ``parts``; NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` at most, chosen by a hash of ``key`` (all rows, if there are no more).

    One count decides the share; which rows are taken depends on their keys
    alone, so a rerun or a lost task takes the same ones.
    """
    total = df.count()
    if total <= most:
        return df
    cut = int(most / total * 2**32)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(977)), F.lit(2**32)) < F.lit(cut))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
