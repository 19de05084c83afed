"""Licence scans: sparse TF-IDF cosine against licence templates, then inheritance down directories.

Units of a file are its whole text, its paragraphs (runs between lines without letters and digits), its
lines and its sentences.  A unit's features are its words (runs of a-z and 0-9 after lower-casing) and its
pairs of neighbouring words, which tell versions and variants apart.  A word weighs
``tf * ln((N + 1) / (df + 1))``, with df the number of files that hold it, counted over all N files.  A pair of a
template weighs like the rarer of its words.  Words and pairs of no template weigh like a word of no file,
each once.  A unit has the licence of the template with the highest cosine, if that
is THRESHOLD or more; a file has that of its best unit (ties: the first licence by name).  The column near
names other licences whose score is within NEAR of it.

Only files that hold a cue are cut into units.  Cues are the words of a template without which the rest
of the template cannot reach the threshold (the squared weights of all else stay below its square), so
this filter loses nothing.

A file whose name says licence (LICENSE, LICENCE, COPYING, COPYRIGHT, NOTICE, UNLICENSE, any case and
extension) gives its licence to its directory; a file without a licence of its own has that of the
nearest directory above it (its own first) that has one.  Of several licence files in a directory the
best scoring counts.

Everything is DataFrame functions and SQL.  Defined cases: null texts hold nothing; a null path has no name
and no directory; repeated rows are judged each; an empty table gives no rows;
other columns are given back, but for those that are called like one of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .scratch import identity, written

THRESHOLD = 0.75
NEAR = 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def words_of(text: Column) -> Column:
    return F.split(F.translate(text, UPPER, LOWER), r"[^a-z0-9]+")


def features(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def features_of(text: Column) -> Column:
    """Words and pairs of neighbouring words; blank for what precedes the first and follows the last."""
    words = F.filter(words_of(text), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def units_of(text: Column) -> Column:
    """The whole text, its lines, paragraphs and sentences, each once."""
    cuts = (r"\r\n|[\n\r]", r"(?:\r\n|[\n\r])[^\p{L}\p{N}\r\n]*(?:\r\n|[\n\r])", r"[.!?][ \t\r\n]+")
    return F.array_distinct(F.concat(F.array(text), *[F.split(text, cut) for cut in cuts]))


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}L" if isinstance(value, int) else f"{value!r}D"


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table as SQL values; words are of a-z, 0-9 and spaces."""
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)} as t({names})")


def weights_of(templates, idf: dict[str, float], df: dict[str, int], threshold: float) -> tuple[set[str], list[tuple[int, str, str, float]]]:
    """The cues, chosen by what they carry for each file that holds them, and (template, licence, feature, weight) with weights of length one."""
    cues, weights = set(), []
    for k, (name, text) in enumerate(templates):
        fs = features(template_words(text))
        weight = {f: fs.count(f) * max(idf[w] for w in f.split()) for f in fs}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        unit = {f: x / norm for f, x in weight.items()}
        left = {f: x * x for f, x in unit.items()}
        while sum(left.values()) >= (threshold * 0.999) ** 2:  # without a word its pairs are missing too
            gain: dict[str, float] = {}
            for f, x in left.items():
                for w in set(f.split()):
                    gain[w] = gain.get(w, 0) + x
            cue = min(gain, key=lambda w: (-gain[w] / (df.get(w, 0) + 1), w))
            cues.add(cue)
            left = {f: x for f, x in left.items() if cue not in f.split()}
        weights += [(k, name, f, x) for f, x in sorted(unit.items())]
    return cues, weights


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, near, origin, *others) of files (path, text, *others): origin is own, inherited or none.

    others are the columns that files has beside path, text and those of the result; they are given back with each row.
    """
    spark = files.sparkSession
    others = [c for c in files.columns if c not in ("path", "text", "license", "score", "near", "origin")]
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("carried")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    files = files.select(F.col("path").cast("string").alias("path"), carried, *identity(text), text.alias("text"))
    terms = sorted({w for _, text in templates for w in template_words(text)})
    literal = F.split(F.lit(" ".join(terms)), " ")
    held = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(literal, words_of(F.col("text"))))).alias("word"))
    df = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row a template word
    n = df.pop("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in terms}
    most = math.log(n + 1) + 1e-3
    cues, weights = weights_of(templates, idf, df, threshold)
    cue = F.split(F.lit(" ".join(sorted(cues))), " ")
    rates_of = {f: max(idf[w] for w in f.split()) for _, _, f, _ in weights}
    rates = F.broadcast(_table(spark, sorted(rates_of.items()), "feature, rate"))  # the templates are a fixed list
    table = F.broadcast(_table(spark, weights, "template, license, feature, weight"))

    #: A file's own licence depends on its text only; copies of a text have one key and count once.
    key = ["key_a", "key_b"]
    some = files.where(F.arrays_overlap(words_of(F.col("text")), cue)).select(*key, "text").dropDuplicates(key)
    units = some.select(*key, F.posexplode(units_of(F.col("text"))).alias("unit", "part")).where(F.arrays_overlap(words_of(F.col("part")), cue))
    feats = units.select(*key, "unit", features_of(F.col("part")).alias("features"))
    vocabulary = F.split(F.lit("|".join(sorted(rates_of))), r"\|")
    feats = feats.withColumn("foreign", F.size(F.array_except("features", vocabulary)))
    #: Only features of templates are shuffled; the others of a unit are one number.
    tf = feats.select(*key, "unit", "foreign", F.explode("features").alias("feature")).join(rates, "feature")
    tf = tf.groupBy(*key, "unit", "foreign", "feature").agg((F.count("*") * F.first("rate")).alias("value"))
    norms = tf.groupBy(*key, "unit", "foreign").agg(F.sum(F.col("value") * F.col("value")).alias("mass"))
    norms = norms.select(*key, "unit", F.sqrt(F.col("mass") + F.col("foreign") * (most * most)).alias("norm"))
    dots = tf.join(table, "feature").groupBy(*key, "unit", "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    close = dots.join(norms, [*key, "unit"]).select(*key, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    close = close.groupBy(*key, "license").agg(F.max("score").alias("score"))
    by = close.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "license"))).alias("by"))  # the licences of the templates at most
    top = F.col("by")[0]
    near = F.filter("by", lambda x: (x["less"] <= F.round(top["less"] + NEAR, 6)) & (x["license"] != top["license"]))
    own = written(by.select(*key, top["license"].alias("license"), (-top["less"]).alias("score"), F.array_join(F.sort_array(F.transform(near, lambda x: x["license"])), ",").alias("near")), "own-licences")

    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    names = files.select(*key, "path", "carried", folder.alias("dir"))
    is_file = F.regexp_extract("path", r"[^/]*$", 0).rlike(r"(?i)^(un)?licen[cs]e|^copying|^copyright|^notice")
    given = (
        names.where(is_file).join(own, key).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.license").alias("license"), (-F.col("best.less")).alias("score"))
    )
    given = written(given, "licence-directories")
    dirs = names.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    nearest = (
        dirs.select("dir", F.posexplode(above).alias("depth", "above")).join(given, "above")
        .groupBy("dir").agg(F.max(F.struct("depth", "license", "score")).alias("from")).select("dir", F.col("from.license").alias("from_license"), F.col("from.score").alias("from_score"))
    )
    nearest = written(nearest, "nearest-licences")
    out = names.join(own, key, "left").join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path", F.coalesce("license", "from_license").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("from_score")).alias("score"), F.when(mine, F.col("near")).alias("near"),
        F.when(mine, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("origin"), *[F.col("carried").getField(c).alias(c) for c in others],
    )
