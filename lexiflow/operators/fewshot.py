"""Few-shot bulk labelling (LAB-01..06, JN-04, JN-05, TOP-02, EVL-09).

* ``context_examples``  N examples per class (hash sample), shuffled by a
  second seed, de-duplicated by text (first position, last label).
* ``build_context``     the prompt prefix per group: example lines in order.
  A context holds at most 3N lines by definition, so collecting one group's
  lines into one row is bounded by the shot count, not by the data.
* ``bigram_scores``     built-in scorer: a class-conditional bigram language
  model with add-alpha smoothing learned from the context examples; the
  score of (row, label) is the mean log-probability of the row's tokens
  under the label's model (noisy-channel direction).  Pure joins and
  aggregates; only seen bigrams / histories have rows.
* ``udf_scores``        pluggable scorer: any Arrow-batched
  ``pandas_udf(prompt, completion) -> double`` applied to row x label.
* ``predict_wide``      arg-max over the label columns (first label wins
  ties) and the wide one-column-per-label layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions.text import LABELS, label_to_id, template, word_tokens
from lexiflow.operators.rank import hash_rank
from lexiflow.operators.splits import class_sample, dedupe_last_label
from lexiflow.operators.sizes import small_side
from lexiflow.session import materialize

START = "<s>"
ALPHA = 1.0


def context_examples(train: DataFrame, shots: int, group_cols: list[str], sample_seed=42,
                     order_seed=42, id_col: str = "id") -> DataFrame:
    """LAB-01 rows: (group..., text, label, order_rank) after SPL-08/10."""
    ex = class_sample(train, shots, group_cols, "label", sample_seed, id_col)
    ex = hash_rank(ex, group_cols, order_seed, id_col, "order_rank", None, extra_keys=("order",))
    return dedupe_last_label(ex, group_cols, "order_rank")


def build_context(examples: DataFrame, group_cols: list[str]) -> DataFrame:
    """LAB-01: (group..., n_examples, context)."""
    line = F.concat(template("text", "label"), F.lit("\n"))
    return examples.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_rank", line.alias("line")))),
                                 lambda s: s["line"]), "").alias("context"))


def prompts(rows: DataFrame, context: DataFrame, group_cols: list[str]) -> DataFrame:
    """LAB-02 + JN-05 + JN-04: every row gets its group's context, the
    prompt with an empty answer, and one completion per candidate label
    (a generator over the fixed label list, not a join)."""
    p = rows.join(context.select(*group_cols, "context"), group_cols)
    p = p.withColumn("prompt", F.concat(F.col("context"), template("text", F.lit(""))))
    return (p.withColumn("candidate", F.explode(F.array(*[F.lit(x) for x in LABELS])))
            .withColumn("completion", F.concat(F.col("prompt"), F.col("candidate"))))


def _events(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Bigram events (prev, w) of each row's tokens with the start symbol."""
    t = df.select(*keys, tokens.alias("_t"))
    prev = F.slice(F.concat(F.array(F.lit(START)), F.col("_t")), 1, F.size("_t"))
    return t.select(*keys, F.explode(F.arrays_zip(prev.alias("prev"), F.col("_t").alias("w"))).alias("_e")) \
        .select(*keys, F.col("_e.prev").alias("prev"), F.col("_e.w").alias("w"))


def bigram_scores(examples: DataFrame, rows: DataFrame, group_cols: list[str], alpha: float = ALPHA,
                  id_col: str = "id", text_col: str = "text", row_cols: list[str] | None = None) -> DataFrame:
    """LAB-03/04: (group..., id, candidate, score) for every row and every
    label present in the group's examples.

    score = mean_i ln((N_c(p_i, w_i) + alpha) / (N_c(p_i) + alpha V)),
    V = distinct example words of the group + 1 (unknown).  Rows without
    tokens score 0.

    ``row_cols`` are those of ``group_cols`` that the rows have (all, if not given); the others (a grid's) tell apart several
    models that score the same rows.  A row's events are taken apart once for all of them: an event meets the
    models' weights as an array, and only a row's sums are shuffled.
    """
    g = group_cols
    rc = g if row_cols is None else row_cols
    # the model (examples and their count tables, bounded by 3N examples per
    # group) is fitted once and written; scoring only reads it
    ex = materialize(examples.select(*g, "label", text_col))
    ex_ev = _events(ex.select(*g, F.col("label").alias("candidate"), text_col),
                    g + ["candidate"], word_tokens(text_col))
    n2 = ex_ev.groupBy(*g, "candidate", "prev", "w").agg(F.count(F.lit(1)).alias("n2"))
    n1 = ex_ev.groupBy(*g, "candidate", "prev").agg(F.count(F.lit(1)).alias("n1"))
    vocab = (ex.select(*g, F.explode(word_tokens(text_col)).alias("w")).distinct()
             .groupBy(*g).agg((F.count(F.lit(1)) + 1).alias("V")))
    classes = materialize(ex.select(*g, F.col("label").alias("candidate")).distinct().join(vocab, g, "left")
                          .fillna(1, ["V"]))
    kinds = [c for c in [*g, "candidate"] if c not in rc]  # a model of a row is one of these
    numbered = classes.select(*kinds).distinct().orderBy(*kinds).collect()
    number = ex.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(numbered)], classes.select(*kinds).schema.add("_no", T.IntegerType()))
    models = max(len(numbered), 1)
    classes = classes.join(F.broadcast(number), kinds)
    a = F.lit(float(alpha))

    def weights(table, keys, value):
        """One row of ``keys``, with the weights of all models."""
        w = table.join(classes, [*g, "candidate"]).groupBy(*rc, *keys).agg(F.collect_list(F.struct("_no", value.alias("x"))).alias("_w"))
        spread = F.aggregate("_w", F.array_repeat(F.lit(0.0), models), lambda acc, e: F.transform(
            acc, lambda x, i: F.when(i == e["_no"], e["x"]).otherwise(x)))
        return small_side(materialize(w.select(*rc, *keys, spread.alias("_w"))))

    n2 = weights(n2, ["prev", "w"], F.log(F.col("n2") + a) - F.log(a))
    n1 = weights(n1, ["prev"], F.log(F.col("n1") + a * F.col("V")) - F.log(a * F.col("V")))
    ev = _events(rows.select(*rc, id_col, text_col), rc + [id_col], word_tokens(text_col))
    n_tok = rows.select(*rc, id_col, F.size(word_tokens(text_col)).alias("n_tok"))

    def sums(part, name):
        each = part.groupBy(*rc, id_col).agg(*[F.sum(F.col("_w")[i]).alias(f"_{i}") for i in range(models)])
        return each.select(*rc, id_col, F.array(*[f"_{i}" for i in range(models)]).alias(name))

    part_a = sums(ev.join(n2, rc + ["prev", "w"]), "_a")
    part_b = sums(ev.drop("w").join(n1, rc + ["prev"]), "_b")
    s = (n_tok.join(part_a, rc + [id_col], "left").join(part_b, rc + [id_col], "left")
         .join(small_side(classes), rc)
         .withColumn("_base", F.col("n_tok") * (F.log(a) - F.log(a * F.col("V")))))
    here = lambda c: F.coalesce(F.get(c, F.col("_no")), F.lit(0.0))
    total = F.col("_base") + here("_a") - here("_b")
    return s.select(*g, id_col, "candidate",
                    F.when(F.col("n_tok") > 0, total / F.col("n_tok")).otherwise(F.lit(0.0)).alias("score"))


def udf_scores(prompt_rows: DataFrame, scorer, keep: list[str]) -> DataFrame:
    """LAB-03 with a pluggable Arrow-batched scorer
    ``pandas_udf(prompt: Series, completion: Series) -> Series[double]``."""
    return prompt_rows.select(*keep, "candidate", scorer(F.col("prompt"), F.col("completion")).alias("score"))


def predict_wide(scores: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """LAB-05 / TOP-02: one column per label and the arg-max label
    (ties to the first label in positive, neutral, negative order)."""
    order = F.struct(F.round("score", 9), -label_to_id("candidate"))
    best = scores.groupBy(*keys).agg(F.max_by("candidate", order).alias("predicted_label"))
    wide = scores.groupBy(*keys).pivot("candidate", LABELS).agg(F.first("score"))
    wide = wide.select(*keys, *[F.round(F.col(x), digits).alias(x) for x in LABELS])
    return wide.join(best, keys)


def answer_span_mean(token_logp: DataFrame, keys: list[str], pos_col: str = "pos", n_col: str = "n_tokens",
                     span_col: str = "ans_len", logp_col: str = "logp") -> DataFrame:
    """EVL-09: mean log-probability of the last ``ans_len`` tokens only."""
    return (token_logp.where(F.col(pos_col) >= F.col(n_col) - F.col(span_col))
            .groupBy(*keys).agg(F.avg(logp_col).alias("answer_ll")))
