"""Sparse text features as long tables.

A document's features are rows ``(key..., id, term, tf)``; vocabularies are
tables ``(key..., term, term_index, tf, df)``.  ``key`` columns carry the
model / language / feature-set identity, so one job fits every language and
every n-gram range at once.

Scale notes
-----------
* documents are hash-partitioned once by (key, id) before n-grams are
  generated, into partitions of ``TASK_CHARS`` of text: their number grows with the corpus and the
  memory of one task does not; per-document counting reuses that partitioning (no second shuffle of the n-gram rows);
* document frequencies are summed with map-side partial aggregation, so a
  very common term costs one row per map task, not one per occurrence;
* the top-k cut is two-stage (per hash slice of the terms, then over at most
  slices x k survivors), so no task ever holds a language's whole term list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import ngram_structs, word_tokens
from lexiflow.operators.sizes import small_side
from lexiflow.session import materialize

# Fixed values of the reference vectoriser grid.
MIN_DF = 7
MAX_DF = 0.8
TOP_K = 100000
TOPK_SLICES = 64
TASK_CHARS = 4 << 20  # text whose grams one task counts


def doc_terms(docs: DataFrame, key_cols: list[str], max_n: int = 1, id_col: str = "id",
              text_col: str = "text", tokens=None, partition: bool = True, min_n: int = 1,
              task_chars: int = TASK_CHARS) -> DataFrame:
    """TXT-04/05 + AGG-06 (per document): ``(key..., id, n, term, tf)``, n from ``min_n`` to ``max_n``."""
    toks = tokens if tokens is not None else word_tokens(text_col)
    src = docs
    if partition:  # a number, so that no small partitions are put together again
        chars = docs.select(F.sum(F.length(text_col))).first()[0] or 0
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, 1 + chars // task_chars)
        src = docs.repartition(parts, *key_cols, id_col)
    # tokens are materialised once per document; the n-gram lambdas then
    # index into that array instead of re-running the tokenizer per position
    tok = src.select(*key_cols, id_col, toks.alias("_tok"))
    grams = tok.select(*key_cols, id_col, F.explode(ngram_structs(F.col("_tok"), max_n, min_n)).alias("_t"))
    return (grams.groupBy(*key_cols, id_col, F.col("_t.n").alias("n"), F.col("_t.term").alias("term"))
            .agg(F.count(F.lit(1)).alias("tf")))


def term_stats(terms: DataFrame, key_cols: list[str]) -> DataFrame:
    """AGG-06: total term frequency and document frequency per (key, term)."""
    return terms.groupBy(*key_cols, "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def top_k(df: DataFrame, key_cols: list[str], k: int, order_cols: list, slice_col: str = "term",
          slices: int = TOPK_SLICES, rank_col: str = "_r", value_col: str = "tf") -> DataFrame:
    """Exact per-key top-k by ``value_col`` descending, ties by ``order_cols``.

    A histogram of the values per key (as many rows as distinct values) gives
    the value at which the running count reaches k; rows above it are in, and
    only rows at or above it are ranked: first inside each hash slice,
    then over the survivors."""
    hist = df.groupBy(*key_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*key_cols).orderBy(F.desc(value_col)).rowsBetween(Window.unboundedPreceding, -1)
    least = (hist.withColumn("_above", F.coalesce(F.sum("_c").over(w), F.lit(0))).where(F.col("_above") < k)
             .groupBy(*[F.col(c).alias(f"_{c}") for c in key_cols]).agg(F.min(value_col).alias("_least")))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(least[f"_{c}"]) for c in key_cols])
    near = df.join(least, same & (df[value_col] >= least["_least"])).drop("_least", *[f"_{c}" for c in key_cols])
    s1 = Window.partitionBy(*key_cols, F.pmod(F.xxhash64(slice_col), F.lit(slices))).orderBy(*order_cols)
    survivors = near.withColumn(rank_col, F.row_number().over(s1)).where(F.col(rank_col) <= k)
    s2 = Window.partitionBy(*key_cols).orderBy(*order_cols)
    return survivors.withColumn(rank_col, F.row_number().over(s2)).where(F.col(rank_col) <= k)


def fit_vocab(train_terms: DataFrame, train_docs: DataFrame, key_cols: list[str],
              min_df: int = MIN_DF, max_df: float = MAX_DF, k: int = TOP_K) -> DataFrame:
    """FEA-04 / TOP-01: count-vectoriser vocabulary per key.

    Keep ``min_df <= df <= max_df * n_docs`` (``n_docs`` counts every training
    document, also those without terms), then the ``k`` terms of highest total
    frequency (ties by term).  ``term_index`` is the position of the term in
    the sorted vocabulary, as the vectoriser assigns it.
    """
    return _cut_vocab(term_stats(train_terms, key_cols), train_docs, key_cols, key_cols, min_df, max_df, k)


def _cut_vocab(stats: DataFrame, train_docs: DataFrame, doc_keys: list[str], key_cols: list[str], min_df: int, max_df: float, k: int) -> DataFrame:
    n_docs = train_docs.groupBy(*doc_keys).agg(F.count(F.lit(1)).alias("n_docs"))
    stats = stats.join(n_docs, doc_keys)
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("n_docs")))
    top = top_k(kept, key_cols, k, [F.desc("tf"), F.asc("term")])
    w = Window.partitionBy(*key_cols).orderBy("term")
    return top.select(*key_cols, "term", "tf", "df", "n_docs",
                      (F.row_number().over(w) - 1).cast("bigint").alias("term_index"))


def fit_vocabs(terms: DataFrame, train_docs: DataFrame, key_cols: list[str], ranges: list[int], min_df: int = MIN_DF,
               max_df: float = MAX_DF, k: int = TOP_K, times_col: str = "times") -> DataFrame:
    """``fit_vocab`` for every gram range ``ngram_max`` at once; a row of ``terms`` counts ``times_col`` times.

    A term's length is its own, so its counts are summed once and the sums, not the documents' rows, go to each range."""
    t = F.col(times_col)
    stats = terms.where(t > 0).groupBy(*key_cols, "n", "term").agg(F.sum(F.col("tf") * t).alias("tf"), F.sum(t).alias("df"))
    rng = F.explode(F.array(*[F.lit(m) for m in ranges])).alias("ngram_max")
    stats = stats.select("*", rng).where(F.col("n") <= F.col("ngram_max")).drop("n")
    return _cut_vocab(stats, train_docs, key_cols, [*key_cols, "ngram_max"], min_df, max_df, k)


def doc_vectors(terms: DataFrame, vocab: DataFrame, key_cols: list[str], more_cols: list[str], id_col: str = "id",
                tfidf: bool = True) -> DataFrame:
    """JN-03 / FEA-05..07: (key..., ngram_max, id, more..., idx, count, tfidf), the in-vocabulary terms of a document
    as arrays in the order of ``idx``; ``tfidf`` is tf * idf, L2-normalised.

    The vocabularies of all gram ranges are joined at once, one row per term; that
    side is bounded by k rows per key and range, and is broadcast when its measured size is small and shuffled otherwise."""
    at = F.collect_list(F.struct("ngram_max", "term_index", "df", "n_docs")).alias("_at")
    places = small_side(materialize(vocab.groupBy(*key_cols, "term").agg(at)), hashed=True)
    hits = (terms.join(places, [*key_cols, "term"]).select(*key_cols, id_col, *more_cols, "tf", F.explode("_at").alias("_p"))
            .select(*key_cols, "_p.ngram_max", id_col, *more_cols, F.struct("_p.term_index", "tf", "_p.df", "_p.n_docs").alias("_e")))
    docs = hits.groupBy(*key_cols, "ngram_max", id_col, *more_cols).agg(F.array_sort(F.collect_list("_e")).alias("_v"))
    keep = [*key_cols, "ngram_max", id_col, *more_cols, F.transform("_v", lambda e: e["term_index"]).alias("idx"),
            F.transform("_v", lambda e: e["tf"].cast("double")).alias("count")]
    if not tfidf:
        return docs.select(*keep)
    weight = F.transform("_v", lambda e: e["tf"] * (F.log((e["n_docs"] + 1) / (e["df"] + 1)) + 1))
    docs = docs.select(*keep, weight.alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w * w))
    # the norm beside each weight: inside the function it would be summed up anew for each
    scaled = F.transform(F.arrays_zip(F.col("_w").alias("w"), F.array_repeat(norm, F.size("_w")).alias("norm")), lambda z: z["w"] / z["norm"])
    return docs.withColumn("tfidf", scaled).drop("_w")


def idf(vocab: DataFrame, key_cols: list[str]) -> DataFrame:
    """FEA-06: smoothed idf = ln((1+n)/(1+df)) + 1 over the training documents."""
    return vocab.select(*key_cols, "term", "term_index",
                        (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
