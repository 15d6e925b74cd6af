"""Evaluation as aggregates (EVL-01..05, AGG-08, UDF-04).

``confusion`` is the only pass over prediction rows; every metric is then an
aggregate over the (keys x classes x classes) confusion table.

weighted F1        = sum_c (support_c / n) * 2 tp_c / (support_c + predicted_c)
balanced accuracy  = mean over classes present in the truth of tp_c / support_c
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_COLS = ["n", "accuracy", "weighted_f1", "balanced_accuracy"]


def confusion(pred: DataFrame, key_cols: list[str], label_col: str = "label",
              pred_col: str = "prediction") -> DataFrame:
    """AGG-08: (key..., label, prediction, cnt)."""
    return pred.groupBy(*key_cols, F.col(label_col).alias("label"),
                        F.col(pred_col).alias("prediction")).agg(F.count(F.lit(1)).alias("cnt"))


def from_confusion(conf: DataFrame, key_cols: list[str], digits: int | None = 6) -> DataFrame:
    """EVL-02/03/04 per key from a confusion table."""
    support = conf.groupBy(*key_cols, "label").agg(
        F.sum("cnt").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(*key_cols, F.col("prediction").alias("label")).agg(
        F.sum("cnt").alias("predicted"))
    cls = (support.join(predicted, [*key_cols, "label"], "left").fillna(0, ["predicted"]))
    totals = conf.groupBy(*key_cols).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)).alias("_correct"))
    per = (cls.join(totals, key_cols)
           .groupBy(*key_cols, "n", "_correct")
           .agg(F.sum(F.col("support") / F.col("n") * 2 * F.col("tp") / (F.col("support") + F.col("predicted")))
                .alias("weighted_f1"),
                F.avg(F.col("tp") / F.col("support")).alias("balanced_accuracy")))
    out = per.select(*key_cols, F.col("n").cast("bigint").alias("n"),
                     (F.col("_correct") / F.col("n")).alias("accuracy"),
                     "weighted_f1", "balanced_accuracy")
    if digits is not None:
        out = out.select(*key_cols, "n", *[F.round(c, digits).alias(c) for c in METRIC_COLS[1:]])
    return out


def evaluate(pred: DataFrame, key_cols: list[str], label_col: str = "label",
             pred_col: str = "prediction", overall: str | None = None, digits: int | None = 6) -> DataFrame:
    """Metrics per key; with ``overall`` also one pooled row per remaining key
    where the first key column is set to ``overall`` (grouping-sets style,
    computed from the small confusion table, not from the rows again)."""
    conf = confusion(pred, key_cols, label_col, pred_col)
    if overall is not None:
        first, rest = key_cols[0], key_cols[1:]
        pooled = (conf.groupBy(*rest, "label", "prediction").agg(F.sum("cnt").alias("cnt"))
                  .withColumn(first, F.lit(overall)))
        conf = conf.unionByName(pooled.select(*conf.columns))
    return from_confusion(conf, key_cols, digits)


def constant_baseline(truth: DataFrame, key_cols: list[str], label_col: str = "label",
                      digits: int = 6) -> DataFrame:
    """EVL-01 + AGG-04: for each label present in the truth, the scores of
    always predicting it.  The confusion of a constant predictor is built
    from the class-count table (classes x classes per key), never from rows."""
    counts = truth.groupBy(*key_cols, F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    consts = counts.select(*key_cols, F.col("label").alias("constant"))
    conf = counts.join(consts, key_cols).withColumn("prediction", F.col("constant"))
    m = from_confusion(conf, key_cols + ["constant"], digits)
    share = counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*key_cols)))
    share = share.select(*key_cols, F.col("label").alias("constant"), F.round("share", digits).alias("share"))
    return m.join(share, key_cols + ["constant"]).drop("accuracy")
