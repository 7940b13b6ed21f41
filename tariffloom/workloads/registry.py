"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Workload:
    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in WORKLOADS:
            raise ValueError(f"duplicate query name: {name}")
        WORKLOADS[name] = Workload(name, tuple(covers.split()), build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: documents that a task grows into constants, cells or notices
DEALT = 1000


def spread(df: DataFrame, key: str, rows: int = DEALT) -> DataFrame:
    """``df`` dealt out by ``key`` to as many tasks as a shuffle has, or more where a task would get over
    ``rows`` rows: a small file is one task, and so would be all rows that it grows into."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // rows)), key)
