"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cpus: int | str = "*", memory: str = "12g", app: str = "tariffloom") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and stream state.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall back to a
    temporary folder, since other machines could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from there.

    Lost executors cost no more than reading it again.  Unlike an eager checkpoint, which works the
    rows out once to count and once more to write them, this runs ``df`` once.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema):
        shared_dir(spark)
        return df.checkpoint(eager=True)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def not_broadcast(df: DataFrame, unique: bool = False) -> DataFrame:
    """``df`` as a side of a join that is shuffled, whatever size Spark expects of it.

    Spark takes rows that were exploded for as large as those they came from, and Parquet for as large
    as its compressed files, so it would gather millions of rows in the driver to broadcast them.
    ``unique``: the join's keys are (nearly) unique in ``df``, so its part is hashed instead of sorted.
    """
    return df.hint("shuffle_hash" if unique else "merge")


#: rows that a task holds where rows are dealt out by key
DEALT_ROWS = 20_000


def dealt(df: DataFrame, *keys: str, rows: int = DEALT_ROWS) -> DataFrame:
    """``df`` (written, so that counting it is cheap) dealt out by ``keys``, about ``rows`` rows to a task.

    Windows and groups whose keys contain ``keys``, and joins by just these, take over the number of tasks,
    so their tasks do not grow with the input as those of a fixed number of shuffle partitions do.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // rows)), *keys)
