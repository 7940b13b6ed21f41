"""Append-only inputs as streams: decisions, edits and arriving workbooks.

Every sink writes one folder a batch, which a repeated batch replaces.  State therefore lies in the
shared folder, not in the executors, and an input that arrives late counts like any other.  What is
kept per key (first decisions) lies in buckets, and a batch rewrites only the buckets it touches;
what is kept per document (baselines, reports) names the batch that wrote it last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tariffloom.operators.edits import apply_edits
from tariffloom.plans.match import MatchSettings, match_documents
from tariffloom.session import cut_lineage
from tariffloom.sources.files import DECISION_SCHEMA, latest_before
from tariffloom.sources.spreadsheets import parse_workbooks

#: buckets of a kept table
BUCKETS = 64


def decision_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Decisions as they are appended; damaged lines are dropped.  ``at`` is null where the time
    cannot be read; such a decision stays."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    parsed = lines.select(F.from_json("value", DECISION_SCHEMA).alias("d")).select("d.*")
    return parsed.filter(F.col("run_id").isNotNull() & F.col("item_id").isNotNull()).withColumn("at", F.try_to_timestamp("reviewed_at"))


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, one folder a batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, path: str, names: list[str], index: str, before: int | None = None) -> DataFrame:
    """Which batch wrote each of ``names`` last, from the small tables ``index`` of batches before ``before``."""
    rows = spark.read.parquet(f"{path}/{index}")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy(*names).agg(F.max("batch").alias("batch"))


def keep_first(stream: DataFrame, keys: list[str], order: list[Column | str], path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A table of the first row of each key by ``order``, kept up to date batch by batch.

    A row of a batch replaces the one kept only if it comes before it, so the table does not hang
    on which batch brought a row.  Rows that are equal in ``order`` are told apart by all their columns.
    Keys are hashed into buckets; a batch reads and writes anew only the buckets of its keys.
    :func:`kept_rows` reads the table.
    """
    names = stream.columns
    rest = [c for c in names if c not in keys]

    def first(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*keys, "bucket").agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("row"))
        return best.select(*keys, "row.*", "bucket")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        first(batch.withColumn("bucket", bucket)).write.mode("overwrite").parquet(f"{path}/new/batch={batch_id}")
        rows = spark.read.parquet(f"{path}/new/batch={batch_id}")
        touched = rows.select("bucket").distinct()
        if batch_id:
            held = _current(spark, path, ["bucket"], "index", batch_id).join(touched, "bucket", "left_semi")
            kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows")
            rows = first(rows.unionByName(kept.join(held, ["bucket", "batch"], "left_semi").drop("batch")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{path}/index/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that :func:`keep_first` keeps; ``schema`` is that of its stream."""
    fields = [*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(f"{path}/rows")
    return rows.join(_current(spark, path, ["bucket"], "index"), ["bucket", "batch"], "left_semi").select(*schema.names)


def first_decisions(decisions: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the first decision of each run, item and action, however late its file comes: the
    earliest readable time, then unreadable ones by their text."""
    order = [F.col("at").isNull(), "at", "reviewed_at", "input_label", "selected_label", "manual_input"]
    return keep_first(decisions, ["run_id", "item_id", "action"], order, path, checkpoint, buckets)


def current_cells(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last value per cell, by ``seq``, over all batches of edits."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys, "column").agg(F.max(F.struct("seq", "value")).alias("e")).select(
        *keys, "column", "e.seq", "e.value")


def revalidate_edited(edits: DataFrame, table: DataFrame, keys: list[str], table_key: str,
                      suite: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """On every batch of edits, keep them and check again just the tables they touched.

    Tables are checked with all edits kept so far, so that earlier batches last and an older edit
    that comes late does not win.  ``path/findings`` gets the findings of a batch, ``path/checked``
    the tables it checked; :func:`current_findings` reads both.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/edits/batch={batch_id}")
        touched = spark.read.parquet(f"{path}/edits/batch={batch_id}").select(table_key).distinct()
        kept = spark.read.parquet(f"{path}/edits").drop("batch").join(touched, table_key, "left_semi")
        rows = apply_edits(table.join(touched, table_key, "left_semi"), kept, keys)
        suite(rows).write.mode("overwrite").parquet(f"{path}/findings/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{path}/checked/batch={batch_id}")

    return edits.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, path: str, table_key: str) -> DataFrame:
    """The findings that each table had when it was checked last; a mended table has none."""
    last = spark.read.parquet(f"{path}/checked").groupBy(table_key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/findings").join(last, [table_key, "batch"], "left_semi").drop("batch")


def workbook_files(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """New ``*.xlsx`` files of a directory as a stream of ``doc_id, content``."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.xlsx").option(
        "maxFilesPerTrigger", files_per_batch).schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(directory)
    return files.select(F.col("path").alias("doc_id"), "content")


def arriving_workbooks(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Cells of new workbooks, handed on per batch."""
    return parse_workbooks(files).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


REPORTS = ("items", "summary", "alerts", "anomalies", "missing")


def match_on_arrival(files: DataFrame, registry: DataFrame, archive: DataFrame, path: str, checkpoint: str,
                     settings: MatchSettings = MatchSettings()) -> StreamingQuery:
    """Match every arriving workbook with its baseline, the latest one of an earlier year that is there.

    ``registry``: keys, ``year``, ``path`` (a document id of ``archive`` or of an arriving file) and
    ``seq``; ``archive``: cells of earlier documents.
    """
    return match_cells_on_arrival(parse_workbooks(files), registry, archive, path, checkpoint, settings)


def match_cells_on_arrival(cells: DataFrame, registry: DataFrame, archive: DataFrame, path: str, checkpoint: str,
                           settings: MatchSettings = MatchSettings()) -> StreamingQuery:
    """:func:`match_on_arrival` for documents that arrive as cells (all cells of a document in one batch).

    A batch works on the documents that it brings and on earlier ones whose baseline it brings; only
    these are matched, and their reports replace those of earlier batches.  A document that comes again
    is matched again, and so are those that have it as baseline.  ``path/chosen`` has the baseline of each
    document (null without one) and each of ``REPORTS`` gets a folder a batch; :func:`current_report`
    and :func:`current_baselines` read them.
    """
    keys = [c for c in registry.columns if c not in ("year", "path", "seq")]
    listed = cut_lineage(archive.select("doc_id").distinct())

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/cells/batch={batch_id}")
        spark.read.parquet(f"{path}/cells/batch={batch_id}").select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/arrived/batch={batch_id}")
        new = spark.read.parquet(f"{path}/arrived/batch={batch_id}")
        arrived = _current(spark, path, ["doc_id"], "arrived", batch_id + 1)
        there = listed.unionByName(arrived.select("doc_id")).distinct().withColumnRenamed("doc_id", "path")
        usable = registry.join(there, "path", "left_semi")
        wanted = registry.join(arrived.select(F.col("doc_id").alias("path")), "path", "left_semi").withColumnRenamed("path", "target_doc")
        picked = wanted.join(latest_before(wanted.select(*keys, "year").distinct(), usable.select(*registry.columns), keys), [*keys, "year"], "left")
        # a document that stands in the registry more than once goes by its last entry
        chosen = picked.groupBy("target_doc").agg(F.max_by(F.struct(F.col("path").alias("base_doc")), "seq").alias("b")).select("target_doc", "b.base_doc")
        touched = new.withColumnRenamed("doc_id", "touched")
        again = chosen.join(touched, F.col("target_doc") == F.col("touched"), "left_semi").unionByName(
            chosen.join(touched, F.col("base_doc") == F.col("touched"), "left_semi")).distinct()
        again.write.mode("overwrite").parquet(f"{path}/chosen/batch={batch_id}")
        work = spark.read.parquet(f"{path}/chosen/batch={batch_id}")
        pairs = work.filter("base_doc is not null").select(F.col("target_doc").alias("pair_id"), "base_doc", "target_doc")
        needed = pairs.select(F.explode(F.array("base_doc", "target_doc")).alias("doc_id")).distinct()
        own = spark.read.parquet(f"{path}/cells").join(arrived, ["doc_id", "batch"], "left_semi").select(*archive.columns)
        kept = archive.join(arrived, "doc_id", "left_anti").unionByName(own).join(needed, "doc_id", "left_semi")
        report = match_documents(kept, pairs, settings)
        for name in REPORTS:
            report[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return cells.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_baselines(spark: SparkSession, path: str) -> DataFrame:
    """``target_doc, base_doc`` of every document that arrived and is registered; ``base_doc`` is null without an earlier one."""
    rows = spark.read.parquet(f"{path}/chosen")
    return rows.join(_current(spark, path, ["target_doc"], "chosen"), ["target_doc", "batch"], "left_semi").select("target_doc", "base_doc")


def current_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the report as each document's last matching left it."""
    last = _current(spark, path, ["target_doc"], "chosen").withColumnRenamed("target_doc", "pair_id")
    return spark.read.parquet(f"{path}/{name}").join(last, ["pair_id", "batch"], "left_semi").drop("batch")
