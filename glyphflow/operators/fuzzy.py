"""Edit distance, suggestions for unknown words, and query correction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from pyspark.sql.window import Window

from ..functions.text import by_slices

SUGGESTIONS = 5


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def distance_bounded(a: Column, b: Column, most: int) -> Column:
    """The distance if it is at most most, else most + 1."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def max_distance_for(keyword: str) -> int:
    n = len(keyword)
    return 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 8 else 3


def max_distance(keyword: Column) -> Column:
    n = F.length(keyword)
    return F.when(n <= 2, 0).when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def dp_table(a: str, b: str) -> list[list[int]]:
    """Distances of all prefixes of a (rows) and b (columns)."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        rows.append(row)
    return rows


def edit_script(a: str, b: str) -> list[str]:
    """Steps from a to b; going back through the table, a match comes before a substitution, a deletion and an insertion."""
    table, i, j, out = dp_table(a, b), len(a), len(b), []
    while i or j:
        here = table[i][j]
        if i and j and a[i - 1] == b[j - 1] and here == table[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append(f"MATCH {a[i]}")
        elif i and j and here == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(f"SUBSTITUTE {a[i]} -> {b[j]}")
        elif i and here == table[i - 1][j] + 1:
            i -= 1
            out.append(f"DELETE {a[i]}")
        else:
            j -= 1
            out.append(f"INSERT {b[j]}")
    return out[::-1]


def target_of(script: Column) -> Column:
    """What a script makes: the last character of every step that isn't a deletion."""
    return F.array_join(F.transform(F.filter(script, lambda x: ~F.startswith(x, F.lit("DELETE"))), lambda x: F.substring(x, -1, 1)), "")


def source_of(script: Column) -> Column:
    """What a script starts from."""
    return F.array_join(F.transform(F.filter(script, lambda x: ~F.startswith(x, F.lit("INSERT"))), lambda x: F.when(F.startswith(x, F.lit("SUBSTITUTE")), F.substring(x, 12, 1)).otherwise(F.substring(x, -1, 1))), "")


#: Bytes of words that scripts and tables are made of at a time; a letter's row of a table takes a hundred times its size.
WORD_BYTES = 1 << 16


@F.arrow_udf(ArrayType(StringType()))
def edit_script_udf(words: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from by_slices(edit_script, pa.list_(pa.string()), WORD_BYTES)(words)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def dp_table_udf(words: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from by_slices(dp_table, pa.list_(pa.list_(pa.int32())), WORD_BYTES)(words)


def suggest(terms: DataFrame, keywords: list[str], limit: int = SUGGESTIONS) -> DataFrame:
    """(keyword, rank, term, distance, df): the nearest dictionary terms of each keyword.

    Keywords are few (a request has fifty at most), so they are an array beside each term and not a
    join; lengths are compared before distances, and distances stop at their bound.
    """
    asked = list(dict.fromkeys(keywords))
    hits = []
    for k in asked:
        most = max_distance_for(k)
        near = F.abs(F.length("term") - len(k)) <= most
        d = F.when(near, F.levenshtein(F.col("term"), F.lit(k), most))
        hits.append(F.when(d >= 0, F.struct(F.lit(k).alias("keyword"), d.alias("distance"))))
    if not hits:
        return terms.select(F.lit("").alias("keyword"), F.lit(1).alias("rank"), "term", F.lit(0).alias("distance"), "df").where("false")
    found = terms.select("term", "df", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit")).select("hit.keyword", "term", "hit.distance", "df")
    order = Window.partitionBy("keyword").orderBy("distance", F.desc("df"), "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("keyword", "rank", "term", "distance", "df")
