"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local session without
    that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="terraspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    # the shuffles behind a table that is written are not needed again
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    path = f"{shared_dir(spark).rstrip('/')}/terraspark/{name}-{uuid.uuid4().hex}"
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that ``written`` made in this process and nobody has removed.
_MADE: list[str] = []


def made(since: int | None = None):
    """Without an argument a mark; with one, the folders written since it."""
    return len(_MADE) if since is None else _MADE[since:]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that ``written`` made and that no table to come is read from."""
    jvm = getattr(spark, "_jvm", None)
    for path in paths if jvm is not None else ():
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.remove(path)


def named(paths: list[str], *names: str) -> list[str]:
    """Those of the folders that were written under one of the names."""
    return [p for p in paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def portions(batch, column: int, most: int = 1 << 24):
    """The rows of an Arrow batch in order, in slices of at most ``most`` bytes of text; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row, done = 0, 0
    while row < batch.num_rows:
        last = max(int(np.searchsorted(ends, done + most, "right")), row + 1)
        yield batch.slice(row, last - row)
        row, done = last, int(ends[last - 1])
