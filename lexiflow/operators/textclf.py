"""Feature sets and naive-Bayes runs over *model assignments*.

Documents are tokenised and counted once (``doc_terms`` keyed by id only).
Which documents train or are scored by which model is a separate, narrow
assignment table ``(key..., id, label, ...)`` — a per-language model, a
pooled model, a source -> target transfer model, a leave-one-out model are
all just different assignment tables, so every protocol shares one plan
shape and no text is tokenised twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import LABELS, label_to_id
from lexiflow.operators import features as FE
from lexiflow.operators import metrics as M
from lexiflow.operators import multimodel as MM
from lexiflow.operators import naive_bayes as NB
from lexiflow.operators.sizes import small_side
from lexiflow.session import materialize, stored

FEATURE_SETS = [(w, m) for m in (1, 2, 3) for w in ("count", "tfidf")]  # 6 sets of the grid


def feature_set_name(weighting: str, max_n: int) -> str:
    return f"{weighting}_{max_n}"


def vectors(terms: DataFrame, train_assign: DataFrame, eval_assign: DataFrame, key_cols: list[str],
            feature_sets=(("count", 1),), min_df: int = FE.MIN_DF, max_df: float = FE.MAX_DF,
            k: int = FE.TOP_K, id_col: str = "id"):
    """FEA-04..08 over assignments, a row per document: (vectors, vocab, vocab_size).

    terms:        (id, n, term, tf) per-document term counts (n = gram length, the same in all rows of a term)
    train_assign: (key..., id, ...) documents a model is fitted on
    eval_assign:  (key..., id, ...) documents a model scores
    vectors:      (key..., ngram_max, id, n_train, n_eval, idx, count, tfidf), stored; ``n_train`` and ``n_eval`` say how often
                  the assignments hold the document, ``tfidf`` is there if a feature set needs it
    """
    ranges = sorted({m for _, m in feature_sets})
    tr_ids, ev_ids = train_assign.select(*key_cols, id_col), eval_assign.select(*key_cols, id_col)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = tr_ids.select("*", one.alias("n_train"), none.alias("n_eval")).unionByName(
        ev_ids.select("*", none.alias("n_train"), one.alias("n_eval")))
    both = materialize(both.groupBy(*key_cols, id_col).agg(F.sum("n_train").alias("n_train"), F.sum("n_eval").alias("n_eval")))
    assigned = terms.where(F.col("n") <= ranges[-1]).join(small_side(both, hashed=True), id_col)
    vocab = materialize(FE.fit_vocabs(assigned, tr_ids, key_cols, ranges, min_df, max_df, k, "n_train"))
    # in-vocabulary counts are written once, compressed: every feature set, the fit and the scoring read them
    vecs = stored(FE.doc_vectors(assigned, vocab, key_cols, ["n_train", "n_eval"], id_col, any(w == "tfidf" for w, _ in feature_sets)), "vectors")
    all_keys = (train_assign.select(*key_cols).distinct()
                .select(*key_cols, F.explode(F.array(*[
                    F.struct(F.lit(feature_set_name(w, m)).alias("feature_set"), F.lit(m).alias("ngram_max"))
                    for w, m in feature_sets])).alias("_fs"))
                .select(*key_cols, "_fs.feature_set", "_fs.ngram_max"))
    sizes = vocab.groupBy(*key_cols, "ngram_max").agg(F.count(F.lit(1)).alias("V"))
    vocab_size = materialize(all_keys.join(sizes, [*key_cols, "ngram_max"], "left").fillna(0, ["V"]).drop("ngram_max"))
    return vecs, vocab, vocab_size


def _weighed(vecs: DataFrame, feature_sets, times_col: str) -> DataFrame:
    """The vectors' rows once for each feature set, with its values in ``_x``; a document that is assigned
    several times has all its rows in the norm."""
    def pick(w, m):
        x = F.col("count") if w == "count" else F.when(F.col(times_col) == 1, F.col("tfidf")).otherwise(
            F.transform("tfidf", lambda v: v / F.sqrt(F.col(times_col))))
        return F.when(F.col("ngram_max") == m, F.struct(F.lit(feature_set_name(w, m)).alias("feature_set"), x.alias("x")))

    sets = F.filter(F.array(*[pick(w, m) for w, m in feature_sets]), lambda s: s.isNotNull())
    return (vecs.where(F.col(times_col) > 0).withColumn("_s", F.explode(sets))
            .select(*[c for c in vecs.columns if c not in ("count", "tfidf", "ngram_max")], F.col("_s.feature_set"), F.col("_s.x").alias("_x")))


def _long(weighed: DataFrame, cols: list[str], times_col: str) -> DataFrame:
    """(cols..., term_index, x), each feature as often as the document is assigned."""
    z = F.arrays_zip(F.col("idx").alias("i"), F.col("_x").alias("x"))
    z = F.when(F.col(times_col) == 1, z).otherwise(F.flatten(F.array_repeat(z, F.col(times_col).cast("int"))))
    return weighed.select(*cols, F.explode(z).alias("_z")).select(*cols, F.col("_z.i").alias("term_index"), F.col("_z.x").alias("x"))


def featurize(terms: DataFrame, train_assign: DataFrame, eval_assign: DataFrame, key_cols: list[str],
              feature_sets=(("count", 1),), id_col: str = "id", **vocab_kw):
    """``vectors`` as (train_x, eval_x, vocab, vocab_size), keyed by key + feature_set,
    with feature rows (key..., feature_set, id, term_index, x)."""
    vecs, vocab, vocab_size = vectors(terms, train_assign, eval_assign, key_cols, feature_sets, id_col=id_col, **vocab_kw)
    cols = [*key_cols, "feature_set", id_col]
    train_x, eval_x = (_long(_weighed(vecs, feature_sets, t), cols, t) for t in ("n_train", "n_eval"))
    return train_x, eval_x, vocab, vocab_size


def with_feature_sets(assign: DataFrame, feature_sets) -> DataFrame:
    names = [feature_set_name(w, m) for w, m in feature_sets]
    return assign.withColumn("feature_set", F.explode(F.array(*[F.lit(n) for n in names])))


def naive_bayes_run(terms: DataFrame, train_assign: DataFrame, eval_assign: DataFrame,
                    key_cols: list[str], feature_sets=(("count", 1),), alphas=(1.0,),
                    keep_cols: list[str] = (), id_col: str = "id", label_col: str = "label",
                    return_scores: bool = False, **vocab_kw) -> DataFrame:
    """Fit one multinomial NB per (key, feature_set, alpha) and score the
    evaluation assignments.  Returns (key..., feature_set, alpha, id,
    label, keep_cols..., prediction) or, with ``return_scores``, the class
    score rows."""
    vecs, _, vocab_size = vectors(terms, train_assign, eval_assign, key_cols, feature_sets, id_col=id_col, **vocab_kw)
    kf = key_cols + ["feature_set"]
    eval_x = _long(_weighed(vecs, feature_sets, "n_eval"), [*kf, id_col], "n_eval")
    # the labels are joined to a row per document, before its features are rows
    labelled = vecs.join(train_assign.select(*key_cols, id_col, label_col), [*key_cols, id_col])
    train_x = _long(_weighed(labelled, feature_sets, "n_train"), [*kf, id_col, label_col], "n_train")
    tr_docs = with_feature_sets(train_assign.select(*key_cols, id_col, label_col), feature_sets)
    classes, term_counts = NB.fit(train_x, tr_docs, vocab_size, kf, alphas, label_col, id_col)
    ev_docs = with_feature_sets(eval_assign.select(*key_cols, id_col, label_col, *keep_cols), feature_sets)
    sc = NB.scores(eval_x, ev_docs, classes, term_counts, kf, list(alphas), label_col, id_col)
    if return_scores:
        return sc
    return NB.predict(sc, kf, [label_col, *keep_cols], id_col)


ROWS_PER_SLICE = 4096  # of a grid's stored rows


def grid_rows(terms: DataFrame, train_assign: DataFrame, eval_assign: DataFrame, key: str, feature_sets=FEATURE_SETS, **vocab_kw):
    """The rows of a classifier grid: (rows, problems, widths, class_rows) as ``multimodel.grid`` takes them.

    A problem is a value of ``key`` with a feature set; ``problems`` is the small table (problem, key, feature_set).  Rows without
    a known term have empty features.  The stored rows are ordered by problem and cut into even ranges, so a
    key that holds most rows is spread over tasks and a scan of some problems skips the others' files."""
    spark = terms.sparkSession
    vecs, _, sizes = vectors(terms, train_assign, eval_assign, [key], feature_sets, **vocab_kw)
    found = [(i, r[key], r["feature_set"], r["V"]) for i, r in enumerate(sizes.orderBy(key, "feature_set").collect())]
    key_type = train_assign.schema[key].dataType.simpleString()
    problems = spark.createDataFrame([f[:3] for f in found], f"problem long, `{key}` {key_type}, feature_set string")
    docs = with_feature_sets(eval_assign.select(key, "id", "label", "split"), feature_sets)
    times = F.col("n_eval").cast("int")
    seen = _weighed(vecs, feature_sets, "n_eval").select(key, "feature_set", "id", *[
        F.when(times == 1, F.col(c)).otherwise(F.flatten(F.array_repeat(c, times))).alias(c) for c in ("idx", "_x")])
    rows = docs.join(seen, [key, "feature_set", "id"], "left").join(F.broadcast(problems), [key, "feature_set"])
    rows = rows.select("problem", "id", "split", label_to_id("label").cast("long").alias("y"),
                       F.coalesce(F.col("idx").cast("array<int>"), F.expr("CAST(array() AS array<int>)")).alias("idx"),
                       F.coalesce(F.col("_x"), F.expr("CAST(array() AS array<double>)")).alias("val"))
    slices = max(4, spark.sparkContext.defaultParallelism, eval_assign.count() * len(feature_sets) // ROWS_PER_SLICE)
    rows = stored(rows.repartitionByRange(slices, "problem", F.xxhash64("id")), "grid-rows")
    counts = rows.where("split = 'train' AND y IS NOT NULL").groupBy("problem", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    class_rows = {f[0]: dict.fromkeys(range(len(LABELS)), 0) for f in found}
    for r in counts:
        class_rows[r["problem"]][r["y"]] = r["n"]
    return rows.where("y IS NOT NULL"), problems, {f[0]: f[3] for f in found}, class_rows


def grid_scores(conf: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """(key, feature_set, family, c) with accuracy, weighted F1 and balanced accuracy on train, dev and test."""
    named = conf.select("problem", "family", "c", "split", F.col("y").alias("label"), F.col("predicted").alias("prediction"), "cnt")
    m = M.from_confusion(named, ["problem", "family", "c", "split"], digits=None).join(F.broadcast(problems), "problem")
    return (m.groupBy(key, "feature_set", "family", "c").pivot("split", ["train", "dev", "test"])
            .agg(F.first("accuracy").alias("acc"), F.first("weighted_f1").alias("f1"), F.first("balanced_accuracy").alias("bacc")))
