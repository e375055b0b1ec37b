"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for URLs no rule knows.

The URLs that a rule decides are the labelled ones; trees learn from them what blocked URLs look like. All of it are
DataFrame operations and Spark's own trees; no Python runs on the executors."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: (verdict, host and path) of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are fitted on, about (chosen by a hash of the URL); trees, their depth, weight of the mean in suffix statistics.
TRAIN_URLS, TREES, DEPTH, SMOOTH = 20_000, 12, 4, 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        each = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, each) if found is None else found.when(fits, each)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the whole URL, all numbers."""
    length = F.length(url).cast("double")
    letters = F.split(url, "")
    letters = F.filter(letters, lambda c: c != "")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / F.size(letters))
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, r"[^/]"),
        "labels": _count(host, r"[^.]") + 1,
        "digits": F.coalesce(F.try_divide(_count(url, r"[^0-9]"), length), F.lit(0.0)),
        "hyphens": _count(url, r"[^-]"),
        "parameters": _count(url, r"[^&?]"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "entropy": entropy,
    }


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule, verdict, score (the trees' probability of a block; null with a rule's verdict only).

    A null URL, or one without '://', has an empty host and path and is judged by the trees as any other. Rows that
    repeat are judged alike. If the rules give no URL of one verdict, URLs without a rule get the other (allow, if there is
    none). Only `id_col` and `url_col` are read; an empty table gives an empty result."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    known = rows.where("_rule IS NOT NULL").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    sums = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    out = [F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule")]
    if not sums.n or sums.blocked in (0, sums.n):
        other = F.lit("block" if sums.n and sums.blocked else "allow")
        return rows.select(*out, F.coalesce("_rule.verdict", other).alias("verdict"), F.lit(None).cast("double").alias("score"))
    place = F.pmod(F.xxhash64("_url"), F.lit(1 << 30))
    sample = known.where(place < int((1 << 30) * min(1.0, train_urls / sums.n)))
    suffix = F.regexp_extract("host", r"[^.]*$", 0)
    base, mean = lexical(F.col("_url"), F.col("host"), F.col("path")), float(sums.blocked / sums.n)
    sample = durable(sample.select("_url", "label", suffix.alias("suffix"), *[v.alias(k) for k, v in base.items()]).repartition(4, "_url"))
    rates = durable(sample.groupBy("suffix").agg(((F.sum("label") + SMOOTH * mean) / (F.count("*") + SMOOTH)).alias("rate")))  # no more rows than the sample
    rates = rates.select(F.col("suffix").alias("_suffix"), "rate")

    def features(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(rates), F.col("suffix") == F.col("_suffix"), "left")
        return joined.withColumn("features", array_to_vector(F.array(*[F.col(k) for k in base], F.coalesce("rate", F.lit(mean)))))

    train = features(sample).select("features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=5, seed=7, cacheNodeIds=False, maxMemoryInMB=64).fit(train)
    ready = rows.withColumn("suffix", suffix)
    for k, v in base.items():
        ready = ready.withColumn(k, v)
    scored = model.transform(features(ready))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("_rule.verdict", F.when(F.col("prediction") == 1, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*out, verdict.alias("verdict"), score.alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
