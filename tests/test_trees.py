"""Trees on sparse rows against pyspark.ml's and plain Python."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexiflow.operators import classifiers as CL
from lexiflow.operators import trees as TR

N, V = 240, 30


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.5, (N, V)) * (rng.random((N, V)) < 0.5)
    x[:, 0] = rng.poisson(60, N)  # more values than bins
    y = (x[:, 1:9] @ rng.normal(size=(8, 3)) + 0.1 * (x[:, :1] - 60) @ rng.normal(size=(1, 3)) + rng.normal(size=(N, 3))).argmax(1)
    rows = [(i, "train" if i % 4 else "test", float(b), Vectors.sparse(V, {int(j): float(a[j]) for j in np.flatnonzero(a)}) if i % 3 else Vectors.dense(a.astype(float)))
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", "split", "y", "features"]).repartition(3)
    rows, bins = TR.binned(df, F.col("split") == "train")
    return x, y, df, rows, rows.where("split = 'train'"), bins


def _found(df):
    return {r["id"]: r["prediction"] for r in df.collect()}


@pytest.mark.parametrize("impurity,depth", [("gini", 5), ("entropy", 3)])
def test_a_tree_is_that_of_pyspark(table, impurity, depth):
    _, _, df, rows, train, bins = table
    want = DecisionTreeClassifier(labelCol="y", impurity=impurity, maxDepth=depth).fit(df.where("split = 'train'")).transform(df)
    assert _found(TR.boost(rows, train, bins, impurity, depth, 1.0, 1, 3)) == _found(want)


def test_only_held_cells_are_stored(table):
    x, _, _, rows, _, bins = table
    held = {r["id"]: sorted(r["idx"]) for r in rows.collect()}
    assert all(set(held[i]) <= {0, *np.flatnonzero(x[i]).tolist()} for i in range(N)) and bins.features == V


def test_sums_and_blocks_in_many_parts(table, monkeypatch):
    _, _, _, rows, train, bins = table
    want = _found(TR.boost(rows, train, bins, "gini", 4, 0.5, 3, 3))
    for name, value in (("HELD", 20), ("CELLS", 300), ("BLOCK", 4)):
        monkeypatch.setattr(TR, name, value)
    assert _found(TR.boost(rows, train, bins, "gini", 4, 0.5, 3, 3)) == want


def test_cells_dealt_out_in_many_parts(table, monkeypatch):
    _, _, _, rows, train, bins = table
    settings = [("gini", 4, 0.5, 6), ("entropy", 2, 1.0, 9)]
    want = TR.boosted(train, bins, settings, 3)
    monkeypatch.setattr(TR, "HELD_CELLS", 150)
    got = TR.boosted(train.repartition(2), bins, settings, 3)
    assert [len(t) for t, _ in want] == [6, 9] and np.allclose(np.concatenate([a for _, a in got]), np.concatenate([a for _, a in want]))
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() for (x, _), (y, _) in zip(got, want) for a, b in zip(x, y))
    alone = _found(TR.boost(rows, train, bins, *settings[1], 3))
    assert alone == _found(TR.voted(rows, bins, want[1], 2, 3))


def test_a_cell_block_of_few_numbers(table, monkeypatch):
    x, _, _, rows, train, bins = table
    blocks, cells = [], []
    for i, r in enumerate(train.collect()):
        blocks.append((0, 0, i, np.int8(r["y"]).tobytes(), np.zeros(len(r["idx"]), np.int32).tobytes(), np.array(r["idx"], np.int32).tobytes(), np.array(r["bin"], np.int16).tobytes()))
        cells.append(dict(zip(r["idx"], r["bin"])))
    cols = TR.Columns.of(blocks[::-1], bins)
    at, w = np.arange(len(cells)) % 3, np.ones(len(cells))
    n, s = cols.sums(at, w, 2, 3)
    monkeypatch.setattr(TR, "CELLS", 7)
    assert all((a == b).all() for a, b in zip(cols.sums(at, w, 2, 3), (n, s)))
    p = int(np.flatnonzero(cols.feature == 0)[0])
    for b in range(bins.first[1] - bins.first[0]):
        assert n[:, cols.first[b] + p].tolist() == [sum(c.get(0, bins.zero[0]) == b != bins.zero[0] for c in cells[k::3]) for k in (0, 1)]
    for cut in (0, 3, int(bins.zero[0]), bins.first[1] - 2):
        want = [c.get(0, bins.zero[0]) > cut and k % 3 == 1 for k, c in enumerate(cells)]
        assert cols.right(at, {1: (0.1, 0, cut)}).tolist() == want


def test_forest_in_many_parts(table, monkeypatch):
    _, _, _, rows, train, bins = table
    want = _found(TR.forest(rows, train, bins, 4, 8, 3))
    for name, value in (("HELD", 20), ("CELLS", 300), ("BLOCK", 4)):
        monkeypatch.setattr(TR, name, value)
    assert _found(TR.forest(rows, train, bins, 4, 8, 3)) == want


def test_registered_boosting_has_the_rounds_of_the_reference(monkeypatch):
    from lexiflow.plans import catalog as C
    monkeypatch.setattr(C, "_clf_data", lambda *a: None)
    monkeypatch.setattr(CL, "run_grid", lambda spark, jobs, **kw: [config for _, config, _ in jobs])
    assert C.adaboost(None, "") == ["gini,depth=5,rate=0.1,rounds=500", "entropy,depth=3,rate=1.0,rounds=500", "entropy,depth=2,rate=1.0,rounds=1000"]


def test_boosting_weighs_as_in_plain_python(table):
    _, y, df, rows, train, bins = table
    w, votes = np.where(np.arange(N) % 4, 1.0, 0.0), np.zeros((N, 3))
    for _ in range(3):
        w /= w.sum()
        now = df.join(df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "id long, w double"), "id")
        tree = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=2).fit(now.where("w > 0"))
        p = np.array([k for _, k in sorted(_found(tree.transform(df)).items())], int)
        err = w[p != y].sum()
        alpha = 0.5 * (np.log((1 - err) / err) + np.log(2))
        votes[np.arange(N), p] += alpha
        w[p != y] *= np.exp(alpha)
    got = _found(TR.boost(rows, train, bins, "gini", 2, 0.5, 3, 3))
    assert [got[i] for i in range(N)] == votes.argmax(1).tolist()


def test_forest_without_draws_is_that_of_pyspark(table, monkeypatch):
    _, _, df, rows, train, bins = table
    monkeypatch.setattr(TR, "draws", lambda key, trees, seed: np.ones((len(key), trees)))
    choose = lambda tree, node: np.arange(V)
    stats, count = TR.root_sums(train, lambda p: np.ones((len(p), 2)), 2, 3)
    grown = TR.grow(train, bins, stats, count, 5, "gini", lambda p: np.ones((len(p), 2)), choose)
    model = RandomForestClassifier(labelCol="y", maxDepth=5, numTrees=2, bootstrap=False, featureSubsetStrategy="all").fit(df.where("split = 'train'"))
    assert [t.numNodes for t in model.trees] == [2 * int((f >= 0).sum()) + 1 for f in grown.feature]
    assert _found(TR.predict(rows, grown.router(bins), TR.shares(grown.stats))) == _found(model.transform(df))


def test_forest_does_not_depend_on_partitions(table):
    _, y, _, rows, train, bins = table
    out = [_found(TR.forest(rows.repartition(k), train.repartition(k), bins, 3, 40, 3)) for k in (1, 5)]
    assert out[0] == out[1] and np.mean([out[0][i] == y[i] for i in range(N)]) > 0.5


def test_draws_are_poisson():
    d = TR.draws(np.arange(2000) * 7919, 50, 42)
    assert abs(d.mean() - 1) < 0.02 and abs(d.var() - 1) < 0.03 and abs((d == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(d[:, 0], d[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(d[:-1, 0], d[1:, 0])[0, 1]) < 0.1


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(i, s, y, Vectors.sparse(50000, {int(y): 1.0})) for i in (1, 1, None) for s, y in (("train", 0.0), ("train", 2.0), ("test", 2.0))],
                               ["id", "split", "y", "features"])
    rows, bins = TR.binned(df, F.col("split") == "train")
    assert rows.count() == 9 and rows.select("key").distinct().count() == 9
    got = CL.adaboost_fit_predict(df, "gini", 2, 1.0, 3).collect()
    assert all(r["prediction"] == r["y"] for r in got)
    assert TR.forest(rows, rows.where("split = 'train'"), bins, 2, 5, 3).count() == 9
