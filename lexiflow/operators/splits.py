"""Shuffles, splits, rebalancing, sampling, de-duplication and pairing.

All randomness is the seeded hash order of ``lexiflow.functions.hashing`` and
all positions come from ``exact_rank``; no operator collects rows to the
driver or funnels a group through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash_mod
from lexiflow.operators.rank import hash_rank, natural_rank

DEFAULT_SEED = 42
DRAW_BLOCK = 65536  # draws generated per task in ``oversample``


def shuffle_rank(df: DataFrame, seed=DEFAULT_SEED, group_cols: list[str] | None = None,
                 id_col: str = "id", rank_col: str = "shuffle_rank") -> DataFrame:
    """SPL-01: a full shuffle materialised as a 1-based rank column."""
    return hash_rank(df, group_cols or [], seed, id_col, rank_col, total_col=None)


def split_by_cuts(df: DataFrame, group_cols: list[str], cuts: list[float], names: list[str],
                  seed=DEFAULT_SEED, id_col: str = "id", split_col: str = "split",
                  keep_rank: bool = True) -> DataFrame:
    """SPL-02/03/04: cut the hash order of each group at ``floor(cut * n)``.

    Cuts are IEEE-double products truncated toward zero, exactly like
    ``int(.7 * n)``; ``names`` has one more entry than ``cuts``.
    """
    assert len(names) == len(cuts) + 1
    ranked = hash_rank(df, group_cols, seed, id_col, "rank", "n")
    expr = None
    for cut, name in zip(cuts, names):
        cond = F.col("rank") <= F.floor(F.lit(float(cut)) * F.col("n"))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    out = ranked.withColumn(split_col, expr.otherwise(names[-1]))
    return out if keep_rank else out.drop("rank", "n")


def split_70_10_20(df, group_cols=("lang",), seed=DEFAULT_SEED, **kw):
    return split_by_cuts(df, list(group_cols), [0.7, 0.8], ["train", "dev", "test"], seed, **kw)


def split_70_30(df, group_cols=("lang",), seed=DEFAULT_SEED, **kw):
    return split_by_cuts(df, list(group_cols), [0.7], ["train", "test"], seed, **kw)


def split_80_20(df, group_cols=("lang",), seed=DEFAULT_SEED, **kw):
    return split_by_cuts(df, list(group_cols), [0.8], ["train", "dev"], seed, **kw)


def holdout(df: DataFrame, group_cols=("lang",), test_size: float = 0.3, seed=DEFAULT_SEED,
            id_col: str = "id", split_col: str = "split") -> DataFrame:
    """SPL-05: hold-out with ``ceil(test_size * n)`` test rows (the last ones
    of the hash order)."""
    ranked = hash_rank(df, list(group_cols), seed, id_col, "rank", "n")
    n_train = F.col("n") - F.ceil(F.lit(float(test_size)) * F.col("n"))
    return ranked.withColumn(split_col, F.when(F.col("rank") <= n_train, "train").otherwise("test"))


def head_split(df: DataFrame, group_cols=("lang",), percent: int = 10, id_col: str = "id",
               split_col: str = "split") -> DataFrame:
    """SPL-06: no shuffle — the first ``percent`` % of each group in natural key
    order is validation, the rest train.  The boundary is
    ``round-half-even(percent * n / 100)`` (closest-rounding percent slices)."""
    ranked = natural_rank(df, list(group_cols), id_col, rank_col="rank", total_col="n")
    cut = F.bround(F.col("n") * F.lit(percent) / F.lit(100.0), 0)
    return ranked.withColumn(split_col, F.when(F.col("rank") <= cut, "validation").otherwise("train"))


def oversample(df: DataFrame, group_cols=("lang",), label_col: str = "label", seed=DEFAULT_SEED,
               id_col: str = "id", block: int = DRAW_BLOCK) -> DataFrame:
    """SPL-07 (+ SET-03, AGG-02, AGG-03): every class of a group is topped up
    to the size of the group's largest class by draws *with replacement*.

    Output = all original rows (``copy_no = 0``) and, per class c with
    deficit d_c, draws j = 1..d_c (``copy_no = j``) of the class row at
    0-based hash-rank ``hash_mod(seed, c, j, n_c)``.

    Draw generation is blocked: a deficit row first becomes
    ``ceil(d_c / block)`` block rows, blocks are spread over tasks, and each
    block expands to at most ``block`` draws — so a class that needs a third
    of all rows is generated by many tasks, not one.  Draws find their row
    with an equi-join on (group, class, rank), whose keys are uniform.
    """
    g = list(group_cols)
    ranked = hash_rank(df, g + [label_col], seed, id_col, "_crank", "_ncls")
    sizes = df.groupBy(*g, label_col).agg(F.count(F.lit(1)).alias("_ncls"))
    wg = Window.partitionBy(*g)
    deficits = (sizes.withColumn("_max", F.max("_ncls").over(wg))
                .withColumn("_def", F.col("_max") - F.col("_ncls"))
                .where(F.col("_def") > 0))
    blocks = deficits.select(*g, label_col, "_ncls", "_def",
                             F.explode(F.sequence(F.lit(0), F.floor((F.col("_def") - 1) / block)))
                             .alias("_blk"))
    n_blocks_hint = max(1, df.sparkSession.sparkContext.defaultParallelism)
    draws = (blocks.repartition(n_blocks_hint, *g, label_col, "_blk")
             .select(*g, label_col, "_ncls",
                     F.explode(F.sequence(F.col("_blk") * block + 1,
                                          F.least(F.col("_def"), (F.col("_blk") + 1) * block)))
                     .alias("copy_no")))
    draws = draws.withColumn("_crank", hash_mod(seed, F.col(label_col), F.col("copy_no"),
                                                F.col("_ncls")) + 1).drop("_ncls")
    originals = ranked.drop("_crank", "_ncls").withColumn("copy_no", F.lit(0).cast("bigint"))
    copies = (draws.join(ranked.drop("_ncls"), [*g, label_col, "_crank"])
              .drop("_crank"))
    return originals.unionByName(copies.select(*originals.columns))


def class_sample(df: DataFrame, n: int, group_cols=("lang",), label_col: str = "label",
                 seed=DEFAULT_SEED, id_col: str = "id", on_short: str = "all") -> DataFrame:
    """SPL-08: ``n`` rows per class without replacement (first ``n`` of the
    class's hash order).  ``on_short='all'`` keeps a smaller class whole;
    ``'error'`` raises, as the reference's sampler does, after a check query
    over the (small) class-size table."""
    g = list(group_cols)
    if on_short == "error":
        short = (df.groupBy(*g, label_col).agg(F.count(F.lit(1)).alias("c"))
                 .where(F.col("c") < n).limit(1).collect())
        if short:
            raise ValueError(f"class smaller than the sample size {n}: {short[0].asDict()}")
    ranked = hash_rank(df, g + [label_col], seed, id_col, "sample_rank", None)
    return ranked.where(F.col("sample_rank") <= n)


def dedupe_last_label(df: DataFrame, group_cols: list[str], order_col: str,
                      text_col: str = "text", label_col: str = "label") -> DataFrame:
    """SPL-10: one row per text; its position is the text's first position in
    ``order_col`` order and its label the one at the text's last position
    (insertion-ordered dict semantics)."""
    return (df.groupBy(*group_cols, text_col)
            .agg(F.min(order_col).alias(order_col),
                 F.max_by(label_col, F.col(order_col)).alias(label_col)))


def pair_random(target: DataFrame, source: DataFrame, group_cols: list[str] | None = None,
                seed=DEFAULT_SEED, target_id: str = "id", source_id: str = "id") -> DataFrame:
    """SPL-09 / JN-06: pair each target row with a uniformly drawn source row
    (``hash_mod(seed, target_id, n_source)``), via an equi-join on the
    source's exact rank.  Returns (group..., target_id, source_id)."""
    g = group_cols or []
    src_ids = source.select(*g, F.col(source_id).alias("source_id"))
    src = hash_rank(src_ids, g, seed, "source_id", "_srank", None)
    tgt = target.select(*g, F.col(target_id).alias("target_id"))
    if g:
        n_src = src_ids.groupBy(*g).agg(F.count(F.lit(1)).alias("_nsrc"))
        tgt = tgt.join(n_src, g)
    else:  # one scalar subquery, evaluated once
        tgt = tgt.withColumn("_nsrc", src_ids.select(F.count(F.lit(1))).scalar())
    tgt = tgt.withColumn("_srank", hash_mod(seed, F.col("target_id"), F.col("_nsrc")) + 1)
    return tgt.join(src, [*g, "_srank"]).select(*g, "target_id", "source_id")
