"""URL verdicts: host and path rules, and a logistic regression for the rest.

A rule ``host/path`` fits its host and all subdomains where the URL's path
starts with the rule's; the longest fitting rule decides.  Other URLs are judged by a logistic
regression on hashed character n-grams of host and path, trained on a labelled URL table of
at most ``SAMPLE`` rows (by default the distinct URLs that a rule decides, labelled with its verdict,
in the order of a hash).  A URL is blocked at a probability of one half or more.

Nulls: a null URL, or one without ``://``, has an empty host and path.  Without
labels the model allows; with labels of one kind it gives that kind.  Empty tables
give empty results; every row gives one row.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import first_by_hash, stored
from lexiflow.llm.decontaminate import LOWER, UPPER

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SAMPLE = 20_000
NGRAMS, FEATURES = (3, 4, 5), 1 << 15
ROUNDS, RIDGE = 30, 1e-3


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in rules.items():
        out = F.when(rule == k, F.lit(v)).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart by a prefix; the ends of each are marked."""
    def of(text: Column, mark: str, n: int) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.length(text) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[of(c, m, n) for c, m in ((host, "h"), (path, "p")) for n in NGRAMS])


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """A function from (host, path) rows to their block probability column ``score``.

    ``labelled``: url and ``blocked`` (boolean); at most ``sample`` distinct rows are used.
    """
    host, path = parts(F.col("url"))
    rows = first_by_hash(labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked").distinct(), sample, "url", "blocked")
    rows = stored(rows.select(grams(host, path).alias("_grams"), F.col("blocked").cast("double").alias("label")), "labelled-urls")
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        constant = kinds[0] if kinds else 0.0
        return lambda df: df.withColumn("score", F.lit(constant))
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    model = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw",
                               predictionCol="_pred", maxIter=ROUNDS, regParam=RIDGE).fit(hashing.transform(rows))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(hashing.transform(df.withColumn("_grams", grams(F.col("host"), F.col("path")))))
        return out.withColumn("score", vector_to_array("_p")[1]).drop("_grams", "_features", "_p", "_raw", "_pred")

    return score


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None,
          labelled: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, score for every row."""
    rules = RULES if rules is None else rules
    host, path = parts(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict_of(F.col("rule"), rules))
    if labelled is None:
        labelled = rows.where("rule IS NOT NULL").select("url", (F.col("verdict") == "block").alias("blocked"))
    out = fit(labelled)(rows)
    return out.select("id", "host", "path", "rule",
                      F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def report(pages: DataFrame) -> DataFrame:
    return judge(pages).withColumnRenamed("id", "page_id")
