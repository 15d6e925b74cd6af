"""Steps whose tasks must not grow with the corpus."""

from collections import Counter

from pyspark.sql import functions as F

from lexiflow.operators import features as FE


def _docs(spark, n=60):
    return spark.createDataFrame([(i % (n - 2) if i else None, f"aa bb cc w{i % 7} aa bb Dd{i}") for i in range(n)], "id long, text string")


def _expected(docs, max_n):
    out = Counter()
    for r in docs.collect():
        w = r["text"].lower().split()
        out.update((r["id"], n, " ".join(w[i:i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    return out


def test_doc_terms_partitions_follow_the_text(spark):
    docs = _docs(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    terms = FE.doc_terms(docs, [], 3, task_chars=100)
    assert terms.rdd.getNumPartitions() == 1 + chars // 100
    assert {(r["id"], r["n"], r["term"]): r["tf"] for r in terms.collect()} == _expected(docs, 3)


def test_doc_terms_of_one_length(spark):
    docs = _docs(spark)
    got = {(r["id"], r["n"], r["term"]): r["tf"] for r in FE.doc_terms(docs, [], 2, min_n=2).collect()}
    assert got == {k: v for k, v in _expected(docs, 2).items() if k[1] == 2}


def test_chunks_try_few_sizes(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from lexiflow.operators import multimodel as MM
    rng = np.random.default_rng(1)
    n, each = 2000, 30
    idx = np.concatenate([rng.choice(5000, each, replace=False) for _ in range(n)]).astype(np.int32)
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * each)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, int)), pa.ListArray.from_arrays(ends, pa.array(idx)),
                                        pa.ListArray.from_arrays(ends, pa.array(np.ones(n * each)))], names=["problem", "idx", "val"])
    monkeypatch.setattr(MM, "CELLS", 20000)
    sorted_numbers, unique = [], np.unique
    monkeypatch.setattr(MM.np, "unique", lambda a, **kw: (sorted_numbers.append(len(a)), unique(a, **kw))[1])
    got = [(len(part), used, x) for _, part, used, x in MM.chunks(batch)]
    # the rows that are left, halved until they fit
    first, sizes = 0, []
    while first < n:
        k = n - first
        while k > 1 and k * len(unique(idx[first * each:(first + k) * each])) > 20000:
            k //= 2
        sizes.append(k)
        first += k
    assert [g[0] for g in got] == sizes
    assert sum(sorted_numbers) < 10 * n * each
    assert all((x.sum(axis=1) == each).all() and len(used) == x.shape[1] for _, used, x in got)


def test_features_are_never_sorted_by_term(spark, monkeypatch):
    """Tables too large for a broadcast: the features, far more rows than the tables, stream past them."""
    from lexiflow.operators import naive_bayes as NB
    from lexiflow.operators import sizes
    from lexiflow.operators import textclf as TC
    docs = _docs(spark).where("id IS NOT NULL").dropDuplicates(["id"]).selectExpr(
        "id", "text", "IF(id % 3 = 0, 'en', 'fr') AS lang", "IF(id % 4 = 1, 'positive', 'negative') AS label")
    terms, rows = FE.doc_terms(docs, [], 2), docs.select("lang", "id", "label")
    seen, scores = [], NB.scores
    monkeypatch.setattr(NB, "scores", lambda x, *a: (seen.append((x, scores(x, *a))), seen[-1][1])[1])

    def run():
        p = TC.naive_bayes_run(terms, rows, rows, ["lang"], [("count", 2), ("tfidf", 1)], (0.1, 1.0), min_df=2)
        return {(r["lang"], r["feature_set"], r["alpha"], r["id"]): r["prediction"] for r in p.collect()}

    small = run()
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small and len(small) == rows.count() * 4
        plan = seen[-1][1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan
    assert "term_index" not in "".join(x for x in plan.splitlines() if " Sort [" in x)
