"""What several operators of the subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffloom.session import cut_lineage, shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\f\r"

__all__ = ["ASCII_SPACE", "WORD", "bounded_batches", "cut_lineage", "group_key", "release", "table", "text_of", "written"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def group_key(column: str) -> Column:
    """A never-null key that keeps null apart from every string, so that plain joins serve."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("0"))


def bounded_batches(spark: SparkSession, size: int = 4 * 1024 * 1024) -> None:
    """Hand rows to Python in batches of bounded bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which is much smaller than a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop plans and broadcast tables that nothing refers to any more.

    Iterations of many small jobs fill a small driver otherwise: what they broadcast is only
    cleaned up after a full collection.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
