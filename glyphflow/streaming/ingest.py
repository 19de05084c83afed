"""Streaming ingest: postings of arriving documents, kept by micro-batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_postings
from ..sources.corpus import from_documents_table


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting has one of its own machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glyphflow-")
    return f"{at.rstrip('/')}/ingest-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, at: str) -> DataFrame:
    """The rows of a Parquet table as a stream; the table is a folder of files, or a single file, which a stream reads from its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    rows = spark.readStream.schema(spark.read.parquet(at).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return rows.parquet(at)
    return rows.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def ingest(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the postings of a stream of (doc_id, text, lang) below out, and which documents came in which batch.

    A micro-batch has folders of its own that a second run of it replaces, so a restart neither loses
    nor doubles postings.
    """

    def store(batch: DataFrame, number: int) -> None:
        docs = from_documents_table(batch)
        build_postings(docs).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        docs.select(F.col("id").alias("doc_id")).distinct().write.mode("overwrite").parquet(f"{out}/documents/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_postings(spark: SparkSession, out: str) -> DataFrame:
    """Postings of all batches; a document that came again counts as it came last, with no postings if it came empty."""
    last = spark.read.parquet(f"{out}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/postings").join(last, ["doc_id", "batch"]).select("term", "doc_id", "tf", "positions")


def stored_counts(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, terms, tokens) of stored_postings(); postings are counted by batch before the join, so a row for each document is shuffled and not one for each posting."""
    last = spark.read.parquet(f"{out}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    counts = spark.read.parquet(f"{out}/postings").groupBy("doc_id", "batch").agg(F.count("*").alias("terms"), F.sum(F.col("tf").cast("long")).alias("tokens"))
    return counts.join(last, ["doc_id", "batch"]).select("doc_id", "terms", "tokens")


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n): events of a stream by time window, with a watermark for late rows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n")


def write_counts(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps a stream's counts as a table below out, which every batch replaces as a whole."""

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return counts.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
