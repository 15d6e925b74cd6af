"""Unlabelled-corpus preparation (COR-01..04, EVL-07, EVL-08, FLT-06).

Token blocks follow batched-map semantics: documents of a group are taken in
natural key order in batches of ``batch_size`` (the batched-map default of
1,000 rows); inside a batch the token lists are concatenated and cut into
blocks of ``block_len``; when the batch holds at least one full block the
tail is dropped, otherwise the single short block is kept.

The cut is computed without per-token rows: a narrow (id, n_tokens) table
gets exact ranks and running offsets (windows over one batch, <= 1,000 rows
each), every document then emits one slice per block it overlaps, and slices
are concatenated per block in offset order.  A block holds at most
``block_len`` tokens, so the per-block collect is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.rank import natural_rank

BLOCK_LEN = 128
BATCH_SIZE = 1000
MLM_PERCENT = 15
IGNORE_INDEX = -100
START = "<s>"


def token_blocks(docs: DataFrame, group_cols: list[str], tokens: Column, id_col: str = "id",
                 block_len: int = BLOCK_LEN, batch_size: int = BATCH_SIZE) -> DataFrame:
    """COR-02: (group..., batch, block, n_tokens, tokens array)."""
    g = group_cols
    tok = docs.select(*g, id_col, tokens.alias("_tok"))
    narrow = tok.select(*g, id_col, F.size("_tok").alias("_n"))
    ranked = natural_rank(narrow, g, id_col, rank_col="_rank", total_col=None)
    ranked = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / batch_size).cast("bigint"))
    wb = Window.partitionBy(*g, "batch")
    run = wb.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    off = ranked.select(*g, id_col, "batch", "_n",
                        F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"),
                        F.sum("_n").over(wb).alias("_total"))
    L = F.lit(block_len)
    usable = F.when(F.col("_total") >= L, F.floor(F.col("_total") / L) * L).otherwise(F.col("_total"))
    off = off.withColumn("_use", usable).where((F.col("_n") > 0) & (F.col("_off") < F.col("_use")))
    last = F.least(F.col("_off") + F.col("_n"), F.col("_use")) - 1
    spans = off.select(*g, id_col, "batch", "_off", "_use",
                       F.explode(F.sequence(F.floor(F.col("_off") / L), F.floor(last / L))).alias("block"))
    # narrow rows, but the texts follow them: a number of their own, as by their bytes they would be put into one task
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    pieces = spans.repartition(parts, *g, "batch", "block").join(tok.select(id_col, "_tok"), id_col)
    start = F.greatest(F.col("block") * L, F.col("_off"))
    end = F.least((F.col("block") + 1) * L, F.col("_use"), F.col("_off") + F.size("_tok"))
    pieces = pieces.select(*g, "batch", F.col("block").cast("bigint").alias("block"), "_off",
                           F.slice("_tok", (start - F.col("_off") + 1).cast("int"), (end - start).cast("int"))
                           .alias("_piece"))
    out = pieces.groupBy(*g, "batch", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_off", "_piece"))), lambda s: s["_piece"]))
        .alias("tokens"))
    return out.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def token_ids(tokens, buckets: int, seed: str = "tok") -> Column:
    """``hashed_ids`` of long token lists, as an Arrow function that hashes each distinct token of a batch once."""

    @F.pandas_udf("array<long>")
    def ids(lists: pd.Series) -> pd.Series:
        known = [x for x in lists if x is not None]
        codes, words = pd.factorize(np.concatenate([*known, np.empty(0, object)]))
        hashed = np.array([int(hashlib.md5(f"{seed}:{w}".encode(), usedforsecurity=False).hexdigest()[:8], 16) % buckets + 1 for w in words], np.int64)
        parts = iter(np.split(hashed[codes] if len(words) else codes, np.cumsum([len(x) for x in known])))
        return pd.Series([None if x is None else next(parts) for x in lists], dtype=object)

    return ids(tokens)


def mlm_mask(blocks: DataFrame, keys: list[str], ids_col: str = "ids", seed=42, vocab: int = 30000,
             mask_id: int | None = None, percent: int = MLM_PERCENT) -> DataFrame:
    """COR-03: choose ``percent`` % of positions by a seeded hash of (keys,
    position); of those 80 % become the mask id, 10 % a hashed random id,
    10 % stay.  Adds ``masked_ids`` and ``targets`` (original id where chosen,
    -100 elsewhere).

    One md5 digest per position drives all three draws (hex digits 1-8: chosen,
    9-16: replacement kind, 17-24: random id).  Both outputs come from one function over the arrays of an
    Arrow batch, so that each digest is made once.
    """
    mask_id = vocab + 1 if mask_id is None else mask_id

    @F.pandas_udf("struct<masked_ids: array<long>, targets: array<long>>")
    def mask(prefixes: pd.Series, lists: pd.Series) -> pd.DataFrame:
        masked, targets = [], []
        for prefix, ids in zip(prefixes, lists):
            x = None if ids is None else np.array(ids, dtype=np.int64)
            if x is None or prefix is None or not len(x):
                masked.append(x)
                targets.append(None if x is None else np.full(len(x), IGNORE_INDEX, np.int64))
                continue
            start = hashlib.md5(prefix.encode(), usedforsecurity=False)
            digests = []
            for i in range(len(x)):
                h = start.copy()
                h.update(b"%d" % i)
                digests.append(h.digest())
            draws = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)
            chosen, kind = draws[:, 0] % 100 < percent, draws[:, 1] % 10
            put = np.where(kind < 8, mask_id, np.where(kind < 9, draws[:, 2] % vocab + 1, x))
            masked.append(np.where(chosen, put, x))
            targets.append(np.where(chosen, x, IGNORE_INDEX))
        return pd.DataFrame({"masked_ids": pd.Series(masked, dtype=object), "targets": pd.Series(targets, dtype=object)})

    prefix = F.concat(*[c for k in (F.lit(seed), *[F.col(k) for k in keys]) for c in (k.cast("string"), F.lit(":"))])
    out = blocks.withColumn("_m", mask(prefix, F.col(ids_col).cast("array<long>")))
    return out.select(*blocks.columns, "_m.masked_ids", "_m.targets")


def masked_accuracy(pred: DataFrame, keys: list[str], targets_col: str = "targets",
                    pred_col: str = "predicted_ids") -> DataFrame:
    """EVL-07 with FLT-06: accuracy over positions whose target is not -100."""
    pairs = pred.select(*keys, F.explode(F.arrays_zip(F.col(targets_col).alias("t"),
                                                      F.col(pred_col).alias("p"))).alias("_z"))
    kept = pairs.where(F.col("_z.t") != IGNORE_INDEX)
    return kept.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("_z.t") == F.col("_z.p")).cast("double")).alias("accuracy"))


def bigram_events(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    t = df.select(*keys, tokens.alias("_t"))
    prev = F.slice(F.concat(F.array(F.lit(START)), F.col("_t")), 1, F.size("_t"))
    return (t.select(*keys, F.explode(F.arrays_zip(prev.alias("prev"), F.col("_t").alias("w"))).alias("_e"))
            .select(*keys, F.col("_e.prev").alias("prev"), F.col("_e.w").alias("w")))


def bigram_perplexity(train: DataFrame, valid: DataFrame, group_cols: list[str], tokens: Column,
                      alpha: float = 1.0, digits: int = 6) -> DataFrame:
    """COR-04 / EVL-08: add-alpha bigram LM on ``train`` (start symbol <s>,
    V = distinct training words + 1 for unknown); per group the validation
    mean negative log-likelihood and perplexity = exp(mean), +inf on
    overflow.  Count tables are aggregated map-side; validation events join
    them on (group, prev, w) and (group, prev)."""
    g = group_cols
    tr = bigram_events(train, g, tokens)
    n2 = tr.groupBy(*g, "prev", "w").agg(F.count(F.lit(1)).alias("n2"))
    n1 = tr.groupBy(*g, "prev").agg(F.count(F.lit(1)).alias("n1"))
    V = (train.select(*g, F.explode(tokens).alias("w")).groupBy(*g)
         .agg((F.countDistinct("w") + 1).alias("V")))
    ev = bigram_events(valid, g, tokens).groupBy(*g, "prev", "w").agg(F.count(F.lit(1)).alias("m"))
    a = F.lit(float(alpha))
    j = (ev.join(n2, g + ["prev", "w"], "left").join(n1, g + ["prev"], "left").join(V, g, "left")
         .fillna(0, ["n2", "n1"]).fillna(1, ["V"]))
    nll = -(F.log(F.col("n2") + a) - F.log(F.col("n1") + a * F.col("V")))
    agg = j.groupBy(*g).agg(F.sum("m").alias("n_events"), (F.sum(F.col("m") * nll) / F.sum("m")).alias("mean_nll"))
    return agg.select(*g, F.col("n_events").cast("bigint").alias("n_events"),
                      F.round("mean_nll", digits).alias("mean_nll"),
                      F.round(F.exp("mean_nll"), digits).alias("perplexity"))
