"""Metrics, few-shot arg-max, token blocks, perplexity, NB against plain Python."""

import math

from pyspark.sql import functions as F

from lexiflow.operators import corpus as CO
from lexiflow.operators import fewshot as FS
from lexiflow.operators import metrics as M


def test_weighted_f1_and_balanced_accuracy_hand_case(spark):
    # truth: a a a b b c ; predictions: a a b b d d  (c never predicted, d never true)
    rows = list(zip(["a", "a", "a", "b", "b", "c"], ["a", "a", "b", "b", "d", "d"]))
    df = spark.createDataFrame(rows, "label string, prediction string").withColumn("k", F.lit(1))
    r = M.evaluate(df, ["k"]).first()
    f1_a, f1_b, f1_c = 2 * 2 / (3 + 2), 2 * 1 / (2 + 2), 0.0
    assert r["n"] == 6
    assert abs(r["accuracy"] - 3 / 6) < 1e-6
    assert abs(r["weighted_f1"] - round(3 / 6 * f1_a + 2 / 6 * f1_b + 1 / 6 * f1_c, 6)) < 1e-6
    assert abs(r["balanced_accuracy"] - round((2 / 3 + 1 / 2 + 0) / 3, 6)) < 1e-6


def test_constant_baseline(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "label string").withColumn("k", F.lit(1))
    got = {r["constant"]: r for r in M.constant_baseline(df, ["k"]).collect()}
    assert abs(got["a"]["share"] - round(2 / 3, 6)) < 1e-9
    assert abs(got["a"]["balanced_accuracy"] - 0.5) < 1e-9
    assert abs(got["a"]["weighted_f1"] - round(2 / 3 * 2 * 2 / (2 + 3), 6)) < 1e-9


def test_score_ties_first_label_wins(spark):
    df = spark.createDataFrame([(1, "positive", 1.0), (1, "neutral", 1.0), (1, "negative", 0.5)],
                               "id long, candidate string, score double")
    assert FS.predict_wide(df, ["id"]).first()["predicted_label"] == "positive"


def _blocks(spark, lens, L):
    rows = [(i, "x", [f"t{i}_{j}" for j in range(n)]) for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "id long, lang string, toks array<string>")
    return CO.token_blocks(df, ["lang"], F.col("toks"), "id", block_len=L).orderBy("block").collect()


def test_block_cutting(spark):
    b = _blocks(spark, [3, 4, 3], 4)          # total 10, L = 4 -> 2 blocks, tail dropped
    assert [r["n_tokens"] for r in b] == [4, 4]
    assert b[0]["tokens"] == ["t0_0", "t0_1", "t0_2", "t1_0"]
    b = _blocks(spark, [2, 1], 4)             # total 3 < L -> one short block
    assert [r["n_tokens"] for r in b] == [3]


def test_block_batches(spark):
    rows = [(i, "x", ["w"] * 3) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, lang string, toks array<string>")
    out = CO.token_blocks(df, ["lang"], F.col("toks"), "id", block_len=4, batch_size=2).collect()
    # batches {0,1}: 6 tokens -> 1 block; {2,3}: 1 block; {4}: 3 < 4 -> short block
    assert sorted((r["batch"], r["n_tokens"]) for r in out) == [(0, 4), (1, 4), (2, 3)]


def test_perplexity_overflow_is_infinity(spark):
    assert spark.range(1).select(F.exp(F.lit(1000.0))).first()[0] == math.inf


def test_bigram_perplexity_matches_python(spark):
    train = [(1, "x", "a b a"), (2, "x", "b a")]
    valid = [(3, "x", "a b c")]
    df_t = spark.createDataFrame(train, "id long, lang string, text string")
    df_v = spark.createDataFrame(valid, "id long, lang string, text string")
    tok = F.split("text", " ")
    got = CO.bigram_perplexity(df_t, df_v, ["lang"], tok).first()
    from collections import Counter
    n2, n1 = Counter(), Counter()
    vocab = set()
    for _, _, t in train:
        w = t.split()
        vocab |= set(w)
        for p, x in zip(["<s>"] + w[:-1], w):
            n2[(p, x)] += 1
            n1[p] += 1
    V = len(vocab) + 1
    w = "a b c".split()
    nll = [-(math.log(n2[(p, x)] + 1) - math.log(n1[p] + V)) for p, x in zip(["<s>"] + w[:-1], w)]
    assert abs(got["mean_nll"] - round(sum(nll) / 3, 6)) < 1e-6


def test_mlm_mask_rate_and_targets(spark):
    df = spark.range(200).select(F.col("id").alias("b"), F.array_repeat(F.lit(5), 100).alias("ids"))
    m = CO.mlm_mask(df, ["b"], "ids", seed=42, vocab=100).select(
        F.explode(F.arrays_zip("ids", "masked_ids", "targets")).alias("z"))
    stats = m.agg(F.avg((F.col("z.targets") != -100).cast("double")).alias("rate")).first()
    assert 0.13 < stats["rate"] < 0.17
    # unmasked positions keep their id and have target -100
    assert m.where("z.targets = -100 AND z.masked_ids <> z.ids").count() == 0
    acc = CO.masked_accuracy(df.select("b", "ids").withColumn("targets", F.col("ids"))
                             .withColumn("predicted_ids", F.col("ids")), ["b"]).first()
    assert acc["accuracy"] == 1.0
    some = spark.createDataFrame([(1, [5, -100, 7, -100], [5, 9, 8, 1]), (2, [-100], [3])], "b int, targets array<int>, predicted_ids array<int>")
    acc = CO.masked_accuracy(some, ["b"]).first()
    assert (acc["n"], acc["accuracy"]) == (2, 0.5)


def test_naive_bayes_matches_plain_python(spark):
    from lexiflow.operators import features as FE
    from lexiflow.operators import textclf as TC
    train = [(1, "good good day", "positive"), (2, "bad day", "negative"), (3, "good", "positive")]
    test = [(4, "good bad bad", "negative")]
    docs = spark.createDataFrame(train + test, "id long, text string, label string")
    terms = FE.doc_terms(docs.select("id", "text"), [], 1)
    ta = spark.createDataFrame([(1, "m", "positive"), (2, "m", "negative"), (3, "m", "positive")][:0] or
                               [(i, "m", l) for i, _, l in train], "id long, model string, label string")
    ea = spark.createDataFrame([(4, "m", "negative")], "id long, model string, label string")
    sc = TC.naive_bayes_run(terms, ta, ea, ["model"], min_df=1, max_df=1.0, return_scores=True)
    got = {r["class"]: r["score"] for r in sc.collect()}
    vocab = ["bad", "day", "good"]
    counts = {"positive": {"good": 3, "day": 1}, "negative": {"bad": 1, "day": 1}}
    prior = {"positive": math.log(2 / 3), "negative": math.log(1 / 3)}
    x = {"good": 1, "bad": 2}
    for c in counts:
        tot = sum(counts[c].values()) + len(vocab)
        s = prior[c] + sum(v * math.log((counts[c].get(t, 0) + 1) / tot) for t, v in x.items())
        assert abs(got[c] - s) < 1e-9


def test_answer_span_mean_uses_last_tokens_only(spark):
    rows = [(1, "positive", i, lp, 5, 2) for i, lp in enumerate([-9.0, -9.0, -9.0, -1.0, -3.0])]
    df = spark.createDataFrame(rows, "id long, candidate string, pos int, logp double, n_tokens int, ans_len int")
    got = FS.answer_span_mean(df, ["id", "candidate"]).first()["answer_ll"]
    assert got == -2.0


def test_bigram_scores_of_several_models_take_rows_apart_once(spark):
    """Rows that have only the language are scored by all models of their language, as if they were repeated for each."""
    ex = spark.createDataFrame([("en", 5, "good day", "positive"), ("en", 5, "bad day", "negative"), ("en", 9, "good good news", "positive"),
                                ("fr", 5, "bon jour", "neutral")], "lang string, shots int, text string, label string")
    rows = spark.createDataFrame([("en", 1, "good day good day"), ("en", 1, "bad news"), ("en", 2, ""), ("fr", 3, "jour jour"), ("de", 4, "tag"), (None, 5, "day")],
                                 "lang string, id long, text string")
    keys = ["lang", "shots"]
    repeated = FS.bigram_scores(ex, rows.join(ex.select(*keys).distinct(), "lang"), keys)
    once = FS.bigram_scores(ex, rows, keys, row_cols=["lang"])
    flat = lambda df: sorted((r["lang"], r["shots"], r["id"], r["candidate"], round(r["score"], 9)) for r in df.collect())
    assert flat(once) == flat(repeated) and len(flat(once)) == 3 * 3 + 1
    # "" scores 0; jour after the start is seen once of V = 3
    assert {r[4] for r in flat(once) if r[2] == 2} == {0.0}


def test_masking_by_plain_python(spark):
    import hashlib

    rows = [("en", 0, [5, 6, 7] * 60), (None, 1, [1, 2]), ("fr", 2, []), ("fr", 3, None)]
    df = spark.createDataFrame(rows, "lang string, block long, ids array<long>")
    got = {r["block"]: r for r in CO.mlm_mask(df, ["lang", "block"], "ids", 42, 30).collect()}
    masked, targets = [], []
    for i, x in enumerate(rows[0][2]):
        h = hashlib.md5(f"42:en:0:{i}".encode()).hexdigest()
        chosen, kind = int(h[:8], 16) % 100 < 15, int(h[8:16], 16) % 10
        masked.append(x if not chosen or kind == 9 else 31 if kind < 8 else int(h[16:24], 16) % 30 + 1)
        targets.append(x if chosen else -100)
    assert got[0]["masked_ids"] == masked and got[0]["targets"] == targets and len(set(masked)) > 4
    assert got[1]["masked_ids"] == [1, 2] and got[1]["targets"] == [-100, -100]  # a null key chooses nothing
    assert got[2]["masked_ids"] == got[2]["targets"] == [] and got[3]["masked_ids"] is got[3]["targets"] is None


def test_token_ids_equal_the_array_expression(spark):
    from lexiflow.functions.text import hashed_ids

    df = spark.createDataFrame([(["a", "b", "a", "caf\u00e9", ""],), ([],), (None,), (["b"],)], "t array<string>")
    for r in df.select(CO.token_ids(F.col("t"), 100).alias("x"), hashed_ids(F.col("t"), 100).alias("y")).collect():
        assert r["x"] == r["y"]


def test_blocks_of_few_bytes_are_made_by_many_tasks(spark):
    """The spans of blocks are narrow; the texts that follow them must not end in one task."""
    df = spark.createDataFrame([(i, "en", "w " * 300) for i in range(2000)], "id long, lang string, text string")
    b = CO.token_blocks(df, ["lang"], F.split(F.trim("text"), " "))
    assert b.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and b.agg(F.sum("n_tokens")).first()[0] == 2 * (300_000 // 128) * 128
