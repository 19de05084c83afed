"""Sources of documents: a folder of text files by language, a table, or rows in memory."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

COLUMNS = ("id", "title", "language", "original", "normalized", "searchable", "searchable_title")


def prepared(docs: DataFrame) -> DataFrame:
    """The document schema from (id, title, language, original)."""
    docs = docs.withColumns({"original": F.coalesce("original", F.lit("")), "title": F.coalesce("title", F.lit(""))})
    docs = docs.withColumn("normalized", T.normalize(F.col("original")))
    return docs.withColumns({"searchable": T.fold_case(F.col("normalized")), "searchable_title": T.to_searchable(F.col("title"))})


def fallback_title(language: Column, base: Column) -> Column:
    """A capitalised language and the file's name, "document" written as a word of its own."""
    return F.concat_ws(" ", F.concat(F.upper(F.substring(language, 1, 1)), F.expr("substring(language, 2)")), F.trim(F.replace(base, F.lit("document"), F.lit("Document "))))


def load_corpus(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Documents of root/<language>/<file>.txt, with their load order ``ord``.

    A first line ``TITLE: ...`` is the title; the body is what follows, without leading white space.
    strict: a file that isn't UTF-8 fails the load.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root if "://" in root else f"file://{os.path.abspath(root)}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"corpus directory not found: {root}")
    depth = len(root.split("://")[-1].rstrip("/").split("/"))
    raw = spark.read.format("binaryFile").options(pathGlobFilter="*.txt", recursiveFileLookup="true").load(root)
    parts = F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/")
    raw = raw.select("content", parts.alias("parts")).where(F.size("parts") == F.lit((depth if root.startswith("/") or "://" in root else len(os.path.abspath(root).split("/"))) + 2))
    text = F.decode(F.expr("content"), F.lit("UTF-8")) if not strict else F.validate_utf8(F.expr("cast(content as string)"))
    names = raw.select(F.element_at("parts", -2).alias("language"), F.element_at("parts", -1).alias("file"))
    order = names.withColumn("ord", F.row_number().over(Window.partitionBy("language").orderBy("file")))  # names only, no texts
    raw = raw.select(F.element_at("parts", -2).alias("language"), F.element_at("parts", -1).alias("file"), text.alias("raw")).join(order, ["language", "file"])
    base = F.replace(F.col("file"), F.lit(".txt"), F.lit(""))
    has = F.startswith(F.col("raw"), F.lit("TITLE:"))
    cut = F.instr("raw", "\n")
    head = F.when(cut > 0, F.expr("substring(raw, 7, instr(raw, '\n') - 7)")).otherwise(F.expr("substring(raw, 7)"))
    body = F.when(~has, F.col("raw")).when(cut > 0, F.regexp_replace(F.expr("substring(raw, instr(raw, '\n') + 1)"), r"^[\s\x1C-\x1F]+", "")).otherwise("")
    trimmed = F.regexp_replace(head, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    docs = raw.select(
        F.concat_ws("-", "language", base).alias("id"), F.when(has, trimmed).otherwise(fallback_title(F.col("language"), base)).alias("title"), "language", body.alias("original"), "ord",
    )
    return prepared(docs)


def from_documents_table(docs: DataFrame) -> DataFrame:
    """The document schema from a table (doc_id, text, lang)."""
    language = F.coalesce("lang", F.lit(""))
    name = F.concat(F.upper(F.substring(language, 1, 1)), F.substring(language, 2, 1 << 30))
    return prepared(docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(name, F.lit(" Document "), F.col("doc_id").cast("string")).alias("title"), language.alias("language"), F.col("text").alias("original")))


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Documents from (id, title, language, text) rows."""
    return prepared(spark.createDataFrame(rows, "id string, title string, language string, original string"))


def register_views(docs: DataFrame, prefix: str = "") -> None:
    """Temporary views documents, postings and dictionary over prepared documents, for SQL."""
    from ..operators import index as ix

    docs.createOrReplaceTempView(f"{prefix}documents")
    ix.build_postings(docs).createOrReplaceTempView(f"{prefix}postings")
    ix.build_dictionary(docs).createOrReplaceTempView(f"{prefix}dictionary")


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, in the column json; nulls are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
