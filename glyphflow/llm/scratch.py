"""Shared scratch space, row identities and exact removal of rows.

Written tables cut lineage and survive the loss of executors.  Everything goes below
``spark.checkpoint.dir`` as the session has it.  Only a local session, as in tests, may do without that
setting and gets a folder of its own; on a cluster a folder of one machine would lose rows, so that fails.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches of this size reach Python, however long the texts, and readers hold as few rows at a time.
LEAN = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}

#: Bits of a removal filter: 64 for each removed row, between 2^16 and 2^24 (a broadcast table of 2^18 rows, 4 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24


def base(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glyphflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession):
    """Within it, jobs hand small batches to Python."""
    before = {k: spark.conf.get(k) for k in LEAN}
    try:
        for k, v in LEAN.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read again."""
    spark = df.sparkSession
    with lean(spark):
        df.write.parquet(at := fresh(spark, name))
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written(), once nothing reads them any more."""
    for df in frames:
        at = getattr(df, "_scratch", None)
        if at:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage: only then does Spark delete the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def null_safe(*values: Column) -> list[Column]:
    """The values with a flag for each that is null, so that a hash tells nulls apart."""
    return [x for v in values for x in (v, v.isNull())]


def identity(*values: Column) -> list[Column]:
    """128 bits that tell rows with other values apart, nulls included: columns key_a and key_b."""
    return [F.xxhash64(*null_safe(*values)).alias("key_a"), F.xxhash64(F.lit("second"), *null_safe(*values)).alias("key_b")]


def without(docs: DataFrame, values: list[Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose identity() of values is in gone (key_a, key_b), a written table; no Python.

    Whole rows are shuffled only where a bit filter lets them through: its words are a table of at most
    2^18 rows, so it can be broadcast whatever the number of rows to remove.  Behind it an exact anti join
    decides; where the filter is full, that join has all rows.
    """
    n = gone.count()
    if not n:
        return docs
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * n - 1).bit_length()))
    names = docs.columns
    a, b, w, m = (f"_{x}_{uuid.uuid4().hex}" for x in ("a", "b", "word", "mask"))  # clash with no column of docs

    def word(key: Column) -> Column:
        return F.shiftright(key.bitwiseAND(F.lit(bits - 1)), 6)

    def bit(key: Column) -> Column:
        return key.bitwiseAND(F.lit(63)).cast("int")

    one = F.lit(1).cast("long")
    words = gone.select(word(F.col("key_a")).alias(w), F.call_function("shiftleft", one, bit(F.col("key_a"))).alias("x")).groupBy(w).agg(F.bit_or("x").alias(m))
    key_a, key_b = identity(*values)
    keyed = docs.select("*", key_a.alias(a), key_b.alias(b))
    marked = keyed.withColumn(w, word(F.col(a))).join(F.broadcast(words), w, "left")  # 2^18 rows at most
    hit = F.coalesce(F.call_function("shiftright", F.col(m), bit(F.col(a))).bitwiseAND(one), F.lit(0).cast("long")) == 1
    maybe = marked.where(hit).join(gone.select(F.col("key_a").alias(a), F.col("key_b").alias(b)), [a, b], "left_anti")
    quoted = [F.col(f"`{c}`") for c in names]
    return marked.where(~hit).select(*quoted).unionByName(maybe.select(*quoted))
