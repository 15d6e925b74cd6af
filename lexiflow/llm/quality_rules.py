"""Quality rules with thresholds that adapt to each language and source.

``measure``     word, symbol, repeated-line and repeated-word counts of every whole text
``sketches``    mergeable quantile sketches per (language, source) and metric
``thresholds``  fences read from the sketches
``judge``       joins every document with the fences of its own group

A sketch is a table of integer bins: a metric's value keeps its leading six
bits, so a bin's relative width is at most 1/32 and two sketches merge by adding
counts.  It is built by partial aggregation, so a source that holds a third of
all rows is summed up in each task before the shuffle.  Sketches hold the
documents that pass the base rules.

A group's sketch is merged with its language's and the corpus's, weighed as
``LANG_PRIOR`` and ``CORPUS_PRIOR`` documents: a large group's fences are its own, a small one's lean
on its language, with no size at which one rule gives way to another.

A document is rejected when a metric lies beyond the fence of its group.  With
m the merged sketch's median and t its 95th percentile, that is t + 2 (t - m), for word length also
the same below with the 5th percentile; where more than half of a group has a metric at zero it is 2 t.
A fence is at least the metric's small ``FLOOR`` away from the median.

Nulls: a null text has no words, fails the base rules and stays out of the
sketches; a group without a document that passes them has no fences; a null language or source is a group of its own.  Empty tables give
empty results; every input row gives one row.  Texts are read whole, however
long; repeated rows count as often as they occur and get equal verdicts, and a value
on a fence is kept.  The columns of the documents travel in one struct, so they may have any names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import map_batches, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LANG_PRIOR, CORPUS_PRIOR = 1000, 100  # documents that the language's and the corpus's sketch count for in a group's
REACH = 2  # tail distances beyond the tail percentile
#: Metric -> least distance of a fence from the median (per mille; hundredths of a character for word length).
FLOOR = {"symbol_rate": 50, "dup_line_rate": 150, "repeat_rate": 100, "word_length": 150}
TAIL = 20  # one document in TAIL lies beyond the tail percentile
WEIGHT = 1000  # weight of one document, so that shares of a prior stay whole numbers

STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """The six counts of ``STATS`` for one whole text.

    Bytes split at exactly the ASCII blanks 0x20 and 0x09-0x0D; lines hold a
    word if anything is left of them.
    """
    words = text.encode().split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else [text] * (n > 0)
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        if len(count) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def measure(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row in the struct ``row``, and the struct ``_quality`` of its counts."""
    keep = df.columns if keep is None else keep
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField(c, T.LongType()) for c in STATS])
    out = T.StructType([src.schema["row"], T.StructField("_quality", kind)])

    def run(batches):
        item = pa.struct([(c, pa.int64()) for c in STATS])
        for b in batches:
            rows = [dict(zip(STATS, text_stats(x or ""))) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, item)], names=["row", "_quality"])

    return map_batches(src, run, out)


def base_failed(q=None):
    q = F.col("_quality") if q is None else q
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def metrics():
    """Metric name -> whole-number column."""
    rate = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return {"symbol_rate": rate("_quality.n_symbols", "_quality.word_chars", 1000),
            "dup_line_rate": rate("_quality.n_dup_lines", "_quality.n_lines", 1000),
            "repeat_rate": rate("_quality.n_repeat_words", "_quality.n_words", 1000),
            "word_length": rate("_quality.word_chars", "_quality.n_words", 100)}


def bin_of(v):
    """A whole number with all but its six leading bits cleared."""
    step = F.expr("shiftleft(1L, greatest(length(bin(_value)) - 6, 0))")
    return v - F.pmod(v, step)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., metric, bin, n): a quantile sketch for each group and metric over rows that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("_value")) for k, v in metrics().items()])).alias("m")
    return (measured.where(~base_failed()).select(*groups, pairs).select(*groups, "m.*")
            .select(*groups, "metric", bin_of(F.col("_value")).alias("bin"))
            .groupBy(*groups, "metric", "bin").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, metric, bin, weight): each group's sketch with its language's and the corpus's."""
    def shares(cols, name, prior):
        key = [*cols, "metric"]
        sums = sketch.groupBy(*key, "bin").agg(F.sum("n").alias("n"))
        share = F.expr(f"{prior * WEIGHT} * n div sum(n) over (partition by {', '.join(f'`{c}`' for c in key)})")
        return sums.select(*[F.col(c).alias(f"_{name}_{c}") for c in [*key, "bin"]], share.alias(name))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    own = sketch.select(F.col(lang).alias("_o_lang"), F.col(source).alias("_o_source"), F.col("metric").alias("_o_metric"),
                        F.col("bin").alias("_o_bin"), "n")
    # the corpus's sketch has at most 32 bins for each of a metric's bit lengths
    return (sketch.select(lang, source, "metric").distinct()
            .join(F.broadcast(shares([], "c", CORPUS_PRIOR)), same("metric", "_c_metric"))
            .join(shares([lang], "l", LANG_PRIOR), same(lang, f"_l_{lang}") & same("metric", "_l_metric") & same("_c_bin", "_l_bin"), "left")
            .join(own, same(lang, "_o_lang") & same(source, "_o_source") & same("metric", "_o_metric") & same("_c_bin", "_o_bin"), "left")
            .select(lang, source, "metric", F.col("_c_bin").alias("bin"),
                    (F.coalesce("n", F.lit(0)) * WEIGHT + F.coalesce("l", F.lit(0)) + F.col("c")).alias("weight")))


def thresholds(sketch: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each group: ``_lo`` and ``_hi``, maps from metric to fence."""
    lang, source = groups
    w = Window.partitionBy(lang, source, "metric")
    cum = merged(sketch, lang, source).select(
        lang, source, "metric", "bin", F.sum("weight").over(w.orderBy("bin")).alias("upto"), F.sum("weight").over(w).alias("total"))
    at = lambda cond: F.min(F.when(cond, F.col("bin")))
    marks = cum.groupBy(lang, source, "metric").agg(
        at(F.expr(f"upto * {TAIL} >= total")).alias("low"), at(F.expr("upto * 2 >= total")).alias("mid"),
        at(F.expr(f"upto * {TAIL} >= total * {TAIL - 1}")).alias("high"))
    floor = F.create_map(*[F.lit(x) for kv in FLOOR.items() for x in kv])[F.col("metric")]
    far = lambda end: F.col(end) + REACH * (F.col(end) - F.col("mid"))
    hi = F.when(F.col("mid") > 0, far("high")).otherwise(2 * F.col("high"))
    fences = marks.select(F.col(lang).alias("_g_lang"), F.col(source).alias("_g_source"), "metric",
                          F.least(far("low"), F.col("mid") - floor).alias("lo"), F.greatest(hi, F.col("mid") + floor).alias("hi"))
    return fences.groupBy("_g_lang", "_g_source").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "lo"))).alias("_lo"),
        F.map_from_entries(F.collect_list(F.struct("metric", "hi"))).alias("_hi"))


def judge(measured: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(row, _quality, _base_failed, _kept), the last two never null, for the rows of ``measure``."""
    measured = measured.select("row", "_quality", *[F.col(f"row.`{c}`").alias(c) for c in groups])
    fences = thresholds(sketches(measured, list(groups)), groups)
    out = None
    for k, v in metrics().items():
        bad = v > F.col("_hi")[k]
        if k == "word_length":
            bad = bad | (v < F.col("_lo")[k])
        out = bad if out is None else out | bad
    lang, source = groups
    joined = measured.join(fences, F.col(lang).eqNullSafe(F.col("_g_lang")) & F.col(source).eqNullSafe(F.col("_g_source")), "left")
    return (joined.withColumn("_base_failed", base_failed())
            .withColumn("_kept", ~F.col("_base_failed") & ~F.coalesce(out, F.lit(False)))
            .select("row", "_quality", "_base_failed", "_kept"))


def report(docs: DataFrame) -> DataFrame:
    """The counts and the verdict of every document."""
    rows = judge(stored(measure(docs, keep=["doc_id", "lang", "source"]), "quality"))
    return rows.select("row.doc_id", *[F.col(f"_quality.{c}").alias(c) for c in STATS if c != "n_lines"],
                       F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    rows = judge(stored(measure(docs), "quality"))
    return rows.where("_kept").select("row.*")


#: The same counts, sketches, fences and verdicts in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
        FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q
              FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT doc_id, lang, source, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed,
             unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS metric,
             unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
                     1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) AS x FROM m),
b AS (SELECT *, x - x % (CAST(1 AS BIGINT) << greatest(length(bin(x)) - 6, 0)) AS bin FROM v WHERE NOT failed),
c AS (SELECT metric, bin, 100000 * count(*) // sum(count(*)) OVER (PARTITION BY metric) AS n FROM b GROUP BY metric, bin),
l AS (SELECT lang, metric, bin, 1000000 * count(*) // sum(count(*)) OVER (PARTITION BY lang, metric) AS n FROM b GROUP BY lang, metric, bin),
o AS (SELECT lang, source, metric, bin, 1000 * count(*) AS n FROM b GROUP BY lang, source, metric, bin),
w AS (SELECT g.lang, g.source, g.metric, c.bin, c.n + coalesce(l.n, 0) + coalesce(o.n, 0) AS n
      FROM (SELECT DISTINCT lang, source, metric FROM b) g JOIN c ON g.metric = c.metric
      LEFT JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.metric = g.metric AND l.bin = c.bin
      LEFT JOIN o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.metric = g.metric AND o.bin = c.bin),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM w),
q AS (SELECT lang, source, metric, min(bin) FILTER (upto * 20 >= total) AS low, min(bin) FILTER (upto * 2 >= total) AS mid,
             min(bin) FILTER (upto * 20 >= total * 19) AS high,
             CASE metric WHEN 'symbol_rate' THEN 50 WHEN 'dup_line_rate' THEN 150 WHEN 'repeat_rate' THEN 100 ELSE 150 END AS least_gap FROM u GROUP BY lang, source, metric),
best AS (SELECT v.doc_id, v.metric, v.x, least(3 * low - 2 * mid, mid - least_gap) AS lo,
                greatest(CASE WHEN mid > 0 THEN 3 * high - 2 * mid ELSE 2 * high END, mid + least_gap) AS hi
         FROM v JOIN q ON v.metric = q.metric AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source),
bad AS (SELECT doc_id FROM best GROUP BY doc_id HAVING bool_or(x > hi OR metric = 'word_length' AND x < lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM m
"""
