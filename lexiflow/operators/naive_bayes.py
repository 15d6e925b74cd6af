"""CLS-01: multinomial naive Bayes as joins and aggregates.

Model (per key and smoothing ``alpha``; V = vocabulary size of the key):

    prior_c      = ln(n_c / n)                        (unsmoothed class prior)
    logp(t | c)  = ln((N_ct + alpha) / (N_c + alpha V))

A document x scores ``prior_c + sum_t x_t logp(t|c)``.  Only terms seen in a
class have rows, so the score is evaluated sparsely as

    prior_c + L(x) * ln(alpha / (N_c + alpha V))  +  sum_{t: N_ct > 0} x_t ln((N_ct + alpha) / alpha)

with ``L(x) = sum_t x_t``.  Work is proportional to non-zero features; the
class table (<= classes x keys x alphas rows) is the only per-key fan-out.
Arg-max ties go to the lowest label id; classes absent from training get no
score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexiflow.functions.text import label_to_id
from lexiflow.operators.sizes import small_side
from lexiflow.session import materialize

ALPHAS = [1e-3, 0.1, 1.0, 10.0, 1e3]  # fixed grid of the reference


def fit(train_x: DataFrame, train_docs: DataFrame, vocab_size: DataFrame, key_cols: list[str],
        alphas: list[float] = (1.0,), label_col: str = "label", id_col: str = "id"):
    """Return (classes, term_counts) — classes per (key, alpha, label) with
    prior and floor; term counts (key, label, term_index, n_ct).

    train_x:    (key..., id, label, term_index, x)   non-zero features of training docs
    train_docs: (key..., id, label)           every training document
    vocab_size: (key..., V)
    """
    alpha_col = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    class_docs = train_docs.groupBy(*key_cols, label_col).agg(F.count(F.lit(1)).alias("n_c"))
    per_key = Window.partitionBy(*key_cols)
    ct = materialize(train_x.groupBy(*key_cols, label_col, "term_index").agg(F.sum("x").alias("n_ct")))
    nc = ct.groupBy(*key_cols, label_col).agg(F.sum("n_ct").alias("n_c_terms"))
    classes = (class_docs.join(nc, [*key_cols, label_col], "left")
               .join(vocab_size, key_cols)
               .select(*key_cols, label_col, alpha_col,
                       F.log(F.col("n_c") / F.sum("n_c").over(per_key)).alias("prior"),
                       F.coalesce(F.col("n_c_terms"), F.lit(0.0)).alias("n_c_terms"), "V"))
    # An empty vocabulary (V = 0) leaves every document with L(x) = 0: the
    # floor is then irrelevant and set to 0 instead of dividing by zero.
    classes = classes.select(*key_cols, "alpha", label_col, "prior",
                             F.when(F.col("V") > 0,
                                    F.log(F.col("alpha") / (F.col("n_c_terms") + F.col("alpha") * F.col("V"))))
                             .otherwise(F.lit(0.0)).alias("floor"))
    # per-class term counts are the weights for every alpha: scoring sums
    # x * ln((N_ct + alpha) / alpha) for all alphas in one aggregate
    return materialize(classes), ct


def scores(eval_x: DataFrame, eval_docs: DataFrame, classes: DataFrame, term_counts: DataFrame,
           key_cols: list[str], alphas: list[float] = (1.0,), label_col: str = "label",
           id_col: str = "id") -> DataFrame:
    """Class scores of every evaluation document:
    (key..., alpha, id, <eval_docs columns>, class, score).

    The sparse part joins features with per-class term counts once (no
    alpha fan-out of the join) and sums one column per alpha; the small
    (doc, class) result is then unpivoted to one row per alpha."""
    length = eval_x.groupBy(*key_cols, id_col).agg(F.sum("x").alias("_len"))
    docs = eval_docs.join(length, [*key_cols, id_col], "left").fillna(0.0, ["_len"])
    # a language, or a term that most documents hold, is one join key: with the fitted
    # tables broadcast (their size is checked) no row of the corpus is shuffled by it
    cls = small_side(classes.withColumnRenamed(label_col, "class"))
    base = docs.join(cls, key_cols).withColumn("_base", F.col("prior") + F.col("_len") * F.col("floor"))
    # one row per term with the counts of all classes: few enough rows to be broadcast, or hashed in the tasks
    each = F.collect_list(F.struct(F.col(label_col).alias("class"), "n_ct")).alias("_w")
    weights = small_side(materialize(term_counts.groupBy(*key_cols, "term_index").agg(each)), hashed=True)
    j = eval_x.join(weights, [*key_cols, "term_index"]).select(*key_cols, id_col, "x", F.explode("_w").alias("_w")) \
        .select(*key_cols, id_col, "x", "_w.class", "_w.n_ct")
    sums = [F.sum(F.col("x") * F.log((F.col("n_ct") + F.lit(float(a))) / F.lit(float(a)))).alias(f"_s{i}")
            for i, a in enumerate(alphas)]
    sp = j.groupBy(*key_cols, id_col, "class").agg(*sums)
    z = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("alpha"),
                     F.array(*[F.col(f"_s{i}") for i in range(len(alphas))]).alias("_sp"))
    sparse = sp.select(*key_cols, id_col, "class", F.explode(z).alias("_z")) \
        .select(*key_cols, id_col, "class", F.col("_z.alpha").alias("alpha"), F.col("_z._sp").alias("_sp"))
    out = base.join(sparse, [*key_cols, "alpha", id_col, "class"], "left")
    return (out.withColumn("score", F.col("_base") + F.coalesce(F.col("_sp"), F.lit(0.0)))
            .drop("_base", "_sp", "_len", "prior", "floor"))


def predict(score_tbl: DataFrame, key_cols: list[str], keep_cols: list[str], id_col: str = "id",
            pred_col: str = "prediction") -> DataFrame:
    """TOP-03 arg-max over class scores; ties to the lowest label id.

    Scores are compared after rounding to 9 decimals so that summation-order
    noise cannot split a true tie."""
    order = F.struct(F.round("score", 9), -label_to_id("class"))
    return (score_tbl.groupBy(*key_cols, "alpha", id_col, *keep_cols)
            .agg(F.max_by("class", order).alias(pred_col)))
