"""URL filtering by association rules mined from labelled URLs, below a list of fixed rules.

Each labelled URL is a transaction of its tokens (labels of the host, words of the path and of query
keys; numbers are no tokens) and, if its label says so, the item of bad pages.  Spark's FP-growth mines
frequent token sets with a bad page as consequent; rules below the confidence or the support asked for,
and rules no better than a shorter rule that they extend, are pruned.  What remains is matched by an
inverted index: each rule stands under its rarest token, an URL looks up its own tokens, and the whole
token set of each rule found is compared.  Up to BROADCAST_RULES rules the index goes to the executors;
beyond, tokens are joined with it.

Tokens that occur in exactly the same labelled URLs count as one, named by the first of them, in mining
and in matching: of their combinations none says more than one of them does, and an URL with dozens
of such tokens would have 2^n frequent sets.  What remains of long patterns is bounded by the support only.

A fixed rule (host and path prefix, allow or block) fits its host and all subdomains where the URL's
path starts with the rule's; the longest decides.  Otherwise an URL is blocked if a mined rule matches.

Defined cases: a null URL, or one without "://", has an empty host and path, no tokens, and is allowed
unless a fixed rule fits.  Without labelled URLs nothing is mined; a null label counts as not bad.
URLs that repeat are labelled each.  Other columns are ignored; a null page_id stays null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

BROADCAST_RULES = 50_000
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words and query keys, each with its kind; digits are no tokens."""
    host = F.transform(F.split(url_host(url), r"\."), lambda x: F.concat(F.lit("host="), x))
    path = F.transform(F.split(F.translate(url_path(url), UPPER, LOWER), r"[^\p{L}\p{M}]+"), lambda x: F.concat(F.lit("path="), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    return F.filter(F.array_distinct(F.concat(host, path, keys)), lambda x: ~x.endswith("="))


def mine(labelled: DataFrame, support: float, confidence: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(antecedent, confidence, support) of the rules for bad URLs in labelled (url, bad boolean), and the (token, name) they use."""
    spark = labelled.sparkSession
    known = written(labelled.select(url_tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    n = known.count()
    if not n:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double"), spark.createDataFrame([], "token string, name string")
    single = known.select("row", F.explode("tokens").alias("token"))
    rows = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"rows_{k}") for k in (0, 1)]
    often = single.groupBy("token").agg(F.count("*").alias("n"), *rows).where(F.col("n") >= least)  # the rest is in no frequent set
    names = written(often.join(often.groupBy("n", "rows_0", "rows_1").agg(F.min("token").alias("name")), ["n", "rows_0", "rows_1"]).select("token", "name"), "url-names")
    named = single.join(names, "token").groupBy("row").agg(F.collect_set("name").alias("names"))  # an URL's own tokens
    items = known.join(named, "row", "left").select(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = written(items.where(F.size("items") > 0), "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double"), names
    asked = (max(support * n, least) - 1e-6) / items.count()  # URLs without a frequent token are left out of the items
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, asked), minConfidence=confidence, numPartitions=32).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = written(rules, "url-rules")
    short, long = rules.alias("s"), rules.alias("l")
    anchor = short.select(F.explode("s.antecedent").alias("token"), F.col("s.antecedent").alias("part"), F.col("s.confidence").alias("other"))
    covered = (
        long.select(F.col("l.antecedent").alias("antecedent"), F.col("l.confidence").alias("own"), F.explode("l.antecedent").alias("token"))
        .join(anchor, "token").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("other") >= F.col("own")))
        .select("antecedent").distinct()
    )
    kept = rules.join(covered, "antecedent", "left_anti")
    return kept.withColumn("support", F.col("support") * items.count() / n), names


def matched(urls: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """urls with the boolean column mined_bad: one of the mined rules (antecedent of names) fits."""
    rules = written(rules, "url-kept")
    n = rules.count()
    if not n:
        return urls.withColumn("mined_bad", F.lit(False))
    uses = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    keyed = rules.select("antecedent", F.explode("antecedent").alias("token")).join(uses, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    used = written(names.join(rules.select(F.explode("antecedent").alias("name")).distinct(), "name"), "url-used")
    if n <= BROADCAST_RULES and used.count() <= 10 * BROADCAST_RULES:
        index: dict[str, list[frozenset]] = {}
        for r in keyed.toLocalIterator():
            index.setdefault(r["token"], []).append(frozenset(r["antecedent"]))
        shared = urls.sparkSession.sparkContext.broadcast((index, {r["token"]: r["name"] for r in used.toLocalIterator()}))

        @F.pandas_udf("boolean")
        def fits(tokens: pd.Series) -> pd.Series:
            index, name = shared.value
            return tokens.map(lambda ts: any(r <= have for have in [{name[t] for t in ts if t in name}] for t in have for r in index.get(t, ())))

        return urls.withColumn("mined_bad", fits(url_tokens(F.col("url"))))
    own = urls.select(F.col("url").alias("_url"), url_tokens(F.col("url")).alias("_tokens")).distinct()
    own = own.select("_url", F.explode("_tokens").alias("token")).join(used, "token").groupBy("_url").agg(F.collect_set("name").alias("_tokens"))
    bad = own.select("_url", "_tokens", F.explode("_tokens").alias("token")).join(keyed, "token").where(F.size(F.array_except("antecedent", "_tokens")) == 0).select("_url").distinct().withColumn("_bad", F.lit(True))
    return urls.join(bad, urls["url"].eqNullSafe(bad["_url"]), "left").withColumn("mined_bad", F.coalesce("_bad", F.lit(False))).drop("_url", "_bad")


def judged(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str, str]], support: float = 0.001, confidence: float = 0.6, least: int = 10) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_bad) of pages (page_id, url); fixed: (allow or block, host, path)."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = matched(urls, *mine(labelled, support, confidence, least)).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("mined_bad"), "block").otherwise("allow")
    for kind, host, path in sorted(fixed, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "mined_bad")
