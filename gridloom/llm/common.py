"""Pieces the training-data operators share: durable tables and narrow views of the input.

Every operator begins with :func:`view`, which keeps only the columns it needs, so further columns
of any name in the input never clash with internal ones.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as most contracts define them: runs without ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset and driver and executors are one
    process (local mode, as in tests), a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below :func:`shared_dir`, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs neither recompute it nor
    depend on an executor that may be lost, and its rows are the same for each of them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended first; the folder is the cluster's to clean
            return


def view(df: DataFrame, **columns: str | Column) -> DataFrame:
    """df with these columns only, under these names."""
    return df.select(*(df[c].alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power_of_two(n: float, least: int = 1, most: int = 1 << 30) -> int:
    """The smallest power of two that is at least n, between two bounds."""
    out = least
    while out < n and out < most:
        out *= 2
    return out


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
