"""Session defaults and the stored tables used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.  Sizes that depend on the
# cluster (shuffle partitions, executor memory) stay with the caller.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the package defaults; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, set on the context if needed.

    A machine-local folder is only made up for ``local`` masters, i.e. tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None)
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if not target:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        target = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(target)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back (an eager write).

    Cuts the lineage for plans that use a derived table several times, and
    fixes rows and partitions where a later step must see exactly the same
    ones after a retry.  Unlike ``checkpoint`` it is computed once, and readers
    keep column pruning, filters and size statistics.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(*frames: DataFrame) -> Iterator[None]:
    """Keep frames that several steps of a writer use, so that each is computed once.

    Lost parts are computed again from their inputs; nothing outlives the block.
    """
    own = [frame for frame in frames if not frame.is_cached]
    for frame in own:
        frame.persist()
    try:
        yield
    finally:
        for frame in own:
            frame.unpersist()
