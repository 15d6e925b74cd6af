"""Decision trees on sparse rows, many at once (CLS-05, CLS-06).

A row holds the features outside their zero bin as two arrays ``(idx, bin)``; bins are cut as in ``pyspark.ml``: between all distinct values
of a feature in the training rows, or at ``MAX_BINS`` - 1 even shares of the rows where there are more.  Boosted trees, which come one after
another, grow on cells that are dealt out by feature (``boosted``).  A level of all trees of a forest is one Spark job:
each task brings its rows to their nodes and adds up class weights by (node, feature, bin) of the held cells, a shuffle by (node, block of
features) sums the tasks' parts and finds the best split, its zero bins being the node's sums less the held ones, and the driver
takes one row for each node and block.  Work and memory grow with the held cells, not with rows x features.

Splits need rows on both sides and a gain above zero; gains are rounded, so that the order of a sum doesn't part a tie: the
lowest feature, then the lowest bin, wins.  Sibling leaves of one class become one leaf, as in ``pyspark.ml``.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.session import stored

MAX_BINS = 32
BLOCK = 8192       # features of a node that meet in one task
CELLS = 1 << 22    # numbers of a chunk of rows
HELD = 1 << 20     # sums that a task holds before it hands them on
HELD_CELLS = 1 << 25  # held cells of the features of one task of a boosting
DIGITS = 12
ROWS_PER_SLICE = 20000
#: Cumulated shares of a Poisson draw of mean 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))


@dataclass
class Bins:
    """Where each feature's bins begin in the row of all bins, and the bin of its zero."""

    first: np.ndarray
    zero: np.ndarray

    @property
    def features(self) -> int:
        return len(self.zero)

    @property
    def cells(self) -> int:
        return int(self.first[-1])


@dataclass
class Trees:
    """Trees of one depth, their nodes numbered as in a heap: ``feature`` is -1 at leaves, bins up to ``bin`` go to the first child."""

    feature: np.ndarray
    bin: np.ndarray
    stats: np.ndarray = field(repr=False)  # class weights
    count: np.ndarray = field(repr=False)  # rows

    @classmethod
    def roots(cls, depth: int, stats: np.ndarray, count: np.ndarray) -> Trees:
        shape = (len(stats), 2 ** (depth + 1) - 1)
        t = cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int16), np.zeros((*shape, stats.shape[1])), np.zeros(shape, np.int64))
        t.stats[:, 0], t.count[:, 0] = stats, count
        return t

    @property
    def used(self) -> np.ndarray:
        return np.unique(self.feature[self.feature >= 0])

    def router(self, bins: Bins) -> Router:
        used = self.used
        return Router(used, np.searchsorted(used, self.feature) * (self.feature >= 0), self.feature >= 0, self.bin, bins.zero[used])

    def classes(self) -> np.ndarray:
        """Class of most weight at each node, the lowest of equals."""
        return np.round(shares(self.stats), DIGITS).argmax(axis=-1)

    def leaves(self) -> np.ndarray:
        """Whether a node is a leaf that rows reach."""
        reached = self.count > 0
        return reached & (self.feature < 0)

    def ends(self) -> np.ndarray:
        """The leaf of the first tree that a row at each node ends in: the node itself, or the pruned one above it."""
        out = np.arange(self.feature.shape[1])
        for v in range(1, len(out)):
            above = out[(v - 1) // 2]
            out[v] = v if self.feature[0, above] >= 0 else above
        return out

    def pruned(self) -> None:
        best = self.classes()
        for node in range(self.feature.shape[1] // 2 - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            merge = (self.feature[:, node] >= 0) & (self.feature[:, a] < 0) & (self.feature[:, b] < 0) & (best[:, a] == best[:, b])
            self.feature[merge, node] = -1
            self.count[np.ix_(merge, [a, b])] = 0


@dataclass
class Router:
    """What a task needs to bring rows to their leaves: of the trees' features only those ``used`` in a split."""

    used: np.ndarray
    place: np.ndarray
    inner: np.ndarray
    bin: np.ndarray
    zero: np.ndarray

    @property
    def width(self) -> int:
        return len(self.used) + len(self.place)

    def leaf(self, rows: Rows) -> np.ndarray:
        """Rows x trees: the node where each row ends."""
        node = np.zeros((len(rows), len(self.place)), np.int32)
        if not len(self.used):
            return node
        held = np.searchsorted(self.used, rows.idx)
        known = self.used[np.minimum(held, len(self.used) - 1)] == rows.idx
        x = np.tile(self.zero.astype(np.int16), (len(rows), 1))
        x[rows.row[known], held[known]] = rows.bin[known]
        tree, row = np.arange(len(self.place)), np.arange(len(rows))[:, None]
        for _ in range((self.place.shape[1] + 1).bit_length() - 2):
            inner = self.inner[tree, node]
            right = x[row, self.place[tree, node]] > self.bin[tree, node]
            node = np.where(inner, 2 * node + 1 + right, node).astype(np.int32)
        return node


@dataclass
class Rows:
    """A chunk of rows: their keys and classes, and their held cells' rows, features and bins."""

    key: np.ndarray
    y: np.ndarray
    row: np.ndarray
    idx: np.ndarray
    bin: np.ndarray
    start: int

    def __len__(self) -> int:
        return len(self.key)


def chunks(batch, width: int, cost: np.ndarray | None = None):
    """An Arrow batch in chunks of about ``CELLS`` numbers: ``width`` for each row and ``cost`` (or 1) for each held cell."""
    ends = batch.column("idx").offsets.to_numpy()
    idx, bins = batch.column("idx").values.to_numpy(), batch.column("bin").values.to_numpy()
    key, y = batch.column("key").to_numpy(), batch.column("y").fill_null(-1).to_numpy().astype(int)
    each = np.concatenate([[0], np.cumsum(np.ones(len(idx), int) if cost is None else cost[idx])])
    spent = (each[ends[1:]] - each[ends[0]]) + width * np.arange(1, len(ends))
    cuts = [0, *(np.flatnonzero(np.diff(spent // CELLS)) + 1), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            row = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
            yield Rows(key[a:b], y[a:b], row, idx[ends[a]:ends[b]], bins[ends[a]:ends[b]], a)


# --- rows ----------------------------------------------------------------------------------

def binned(data: DataFrame, train_filter) -> tuple[DataFrame, Bins]:
    """The rows of ``data`` (id, y, features, ...) with (key, idx, bin) instead of the vector, stored, and the features' bins.

    ``key`` is made from the id, and for a repeated id from the row's number; ``y`` becomes a whole number."""
    v = F.unwrap_udt("features")
    n_features = data.select(F.max(F.coalesce(v["size"], F.size(v["values"])))).first()[0] or 0
    dense = F.expr("CASE WHEN size(_v.values) > 0 THEN sequence(0, size(_v.values) - 1) ELSE CAST(array() AS array<int>) END")
    twin = F.row_number().over(Window.partitionBy("id").orderBy("y"))
    rows = data.withColumn("_v", v).withColumn("idx", F.coalesce(F.col("_v.indices"), dense)).withColumn("val", F.col("_v.values"))
    rows = rows.withColumn("key", F.xxhash64("id", twin)).withColumn("y", F.col("y").cast("int")).drop("features", "_v")
    slices = max(data.sparkSession.sparkContext.defaultParallelism, data.count() // ROWS_PER_SLICE + 1)
    rows = stored(rows.repartition(slices, "key"), "tree-rows")
    cuts = thresholds(rows.where(train_filter))
    lengths = np.zeros(n_features, int)
    for f, c in cuts:
        lengths[f] = len(c)
    flat, starts = np.zeros(lengths.sum()), np.concatenate([[0], np.cumsum(lengths)])
    for f, c in cuts:
        flat[starts[f]:starts[f + 1]] = c
    zero = _bin_of(np.zeros(n_features), np.arange(n_features), flat, starts)
    bins = Bins(np.concatenate([[0], np.cumsum(lengths + 1)]), zero)
    shared = rows.sparkSession.sparkContext.broadcast((flat, starts, zero))
    others = [c for c in rows.columns if c not in ("idx", "val")]

    def run(batches):
        flat, starts, zero = shared.value
        for b in batches:
            ends = b.column("idx").offsets.to_numpy()
            ends = ends - ends[0]
            idx, val = b.column("idx").flatten().to_numpy(), b.column("val").flatten().to_numpy(zero_copy_only=False)
            bin_ = _bin_of(val, idx, flat, starts)
            kept = bin_ != zero[idx]
            ends = pa.array(np.concatenate([[0], np.cumsum(kept)])[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.ListArray.from_arrays(ends, pa.array(idx[kept])),
                                              pa.ListArray.from_arrays(ends, pa.array(bin_[kept].astype(np.int16)))], names=[*others, "idx", "bin"])

    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("bin", T.ArrayType(T.ShortType()))])
    return stored(rows.mapInArrow(run, schema), "tree-bins"), bins


def _bin_of(val: np.ndarray, idx: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of its feature's thresholds are below each value."""
    out, n, at = np.zeros(len(val), int), np.diff(starts)[idx], starts[idx]
    left, k = np.flatnonzero(n), 0
    while len(left):
        left = left[flat[at[left] + k] < val[left]]
        out[left] += 1
        k += 1
        left = left[n[left] > k]
    return out


def thresholds(train: DataFrame) -> list[tuple[int, list[float]]]:
    """(feature, thresholds) of every feature with more than one value in the training rows; at most ``MAX_BINS`` - 1 each."""
    n = train.count()
    cells = train.select(F.explode(F.arrays_zip("idx", "val")).alias("c")).where("c.val != 0")
    counts = cells.groupBy(F.col("c.idx").alias("f"), F.col("c.val").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("l"))
    most = min(MAX_BINS, n) - 1

    def run(batches):
        for b in batches:
            found = [(f, cut_points([(x["v"], x["n"]) for x in l], n, most)) for f, l in zip(b.column("f").to_pylist(), b.column("l").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int32()), pa.array([c for _, c in found], pa.list_(pa.float64()))], names=["f", "cuts"])

    return [(r["f"], r["cuts"]) for r in lists.mapInArrow(run, "f int, cuts array<double>").where("size(cuts) > 0").collect()]


def cut_points(values: list[tuple[float, int]], n: int, most: int) -> list[float]:
    """Thresholds between the values (value, rows) of one feature of ``n`` rows, the rest of which hold zero."""
    rest = n - sum(c for _, c in values)
    values = sorted([*values, (0.0, rest)]) if rest > 0 else values
    middles = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:])]
    if len(middles) <= most:
        return middles
    out, stride = [], n / (most + 1)
    seen, target = values[0][1], stride
    for k, (_, c) in enumerate(values[1:]):
        before, seen = seen, seen + c
        if abs(before - target) < abs(seen - target):
            out.append(middles[k])
            target += stride
    return out


# --- growing -------------------------------------------------------------------------------

def shares(stats: np.ndarray, axis: int = -1) -> np.ndarray:
    return stats / np.maximum(stats.sum(axis=axis, keepdims=True), 1e-300)


def impurity_of(kind: str, stats: np.ndarray, axis: int = -1) -> np.ndarray:
    p = shares(stats, axis)
    if kind == "gini":
        return 1.0 - (p * p).sum(axis=axis)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=axis)


def draws(key: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Rows x trees: how often each tree draws each row, made from key, tree and seed alone."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64)[:, None] + (np.arange(trees, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        x += np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)).astype(float) / 2**53, side="right")


def _compact(parts: list[tuple]) -> tuple:
    """(key, count, sums) by key."""
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    add = lambda x: np.bincount(where, x, len(keys))
    sums = np.concatenate([p[2] for p in parts])
    return keys, add(np.concatenate([p[1] for p in parts])).astype(np.int64), np.column_stack([add(s) for s in sums.T])


def root_sums(train: DataFrame, weigh, trees: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class weights and rows of every tree's root."""
    def run(batches):
        stats, count = np.zeros((trees, n_classes)), np.zeros(trees, np.int64)
        for b in batches:
            for rows in chunks(b, trees):
                w = weigh(rows)
                count += (w > 0).sum(axis=0)
                for k in range(n_classes):
                    stats[:, k] += w[rows.y == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary()), pa.array([stats.tobytes()], pa.binary())], names=["count", "stats"])

    stats, count = np.zeros((trees, n_classes)), np.zeros(trees, np.int64)
    for r in train.mapInArrow(run, "count binary, stats binary").collect():  # trees x classes for each task
        stats += np.frombuffer(r["stats"]).reshape(trees, n_classes)
        count += np.frombuffer(r["count"], np.int64)
    return stats, count


def grow(train: DataFrame, bins: Bins, stats: np.ndarray, count: np.ndarray, depth: int, impurity: str, weigh, choose=None) -> Trees:
    """Trees grown level by level from their roots' class weights and rows; ``weigh`` gives a chunk's rows x trees weights, ``choose(tree, node)``
    the features that a node may split (none: all)."""
    trees = Trees.roots(depth, stats, count)
    open_ = [(t, 0) for t in range(len(stats))]
    for level in range(depth):
        open_ = [(t, v) for t, v in open_ if impurity_of(impurity, trees.stats[t, v]) > 10.0 ** -DIGITS]
        if not open_:
            break
        tree, node = np.array(open_).T
        sub = None if choose is None else [choose(t, v) for t, v in open_]
        open_ = []
        for k, f, b, n, left in _best_splits(train, bins, trees, tree, node, sub, weigh, impurity):
            t, v = tree[k], node[k]
            trees.feature[t, v], trees.bin[t, v] = f, b
            trees.count[t, 2 * v + 1], trees.count[t, 2 * v + 2] = n, trees.count[t, v] - n
            trees.stats[t, 2 * v + 1], trees.stats[t, 2 * v + 2] = left, np.maximum(trees.stats[t, v] - left, 0.0)
            open_ += [(t, 2 * v + 1), (t, 2 * v + 2)]
    trees.pruned()
    return trees


def _best_splits(train, bins: Bins, trees: Trees, tree: np.ndarray, node: np.ndarray, sub, weigh, impurity: str) -> list[tuple]:
    """(number of the open node, feature, bin, rows and class weights of the first child) of all open nodes that gain by a split; one job."""
    n_classes, cells = trees.stats.shape[2], bins.cells
    slot = np.full(trees.feature.shape, -1, np.int32)
    slot[tree, node] = np.arange(len(tree))
    if sub is not None:  # the open nodes of each feature
        flat = np.concatenate(sub)
        owner = np.repeat(np.arange(len(sub), dtype=np.int32), [len(s) for s in sub])[np.argsort(flat, kind="stable")]
        per = np.bincount(flat, minlength=bins.features)
        begin = np.concatenate([[0], np.cumsum(per)])
    else:
        owner = per = begin = None
    router = trees.router(bins)
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast((bins.first, slot, tree, owner, per, begin, router))
    totals = sc.broadcast((bins, trees.count[tree, node], trees.stats[tree, node]))
    names = ["slot", "block", "cell", "n", *[f"s{k}" for k in range(n_classes)]]
    schema = "slot int, block int, cell int, n long, " + ", ".join(f"s{k} double" for k in range(n_classes))

    def handed_on(first, key, n, sums):
        s, cell = key // cells, key % cells
        block = np.zeros(len(key), int) if sub_given else (np.searchsorted(first, cell, side="right") - 1) // BLOCK
        return pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n),
                                           *[pa.array(np.ascontiguousarray(x)) for x in sums.T]], names=names)

    sub_given = sub is not None

    def add_up(batches):
        first, slot, tree, owner, per, begin, router = shared.value
        parts, held = [], 0
        for b in batches:
            for rows in chunks(b, router.width + slot.shape[0], per):
                w = weigh(rows)
                at = np.where(w > 0, slot[np.arange(len(slot)), router.leaf(rows)], -1)
                cell = first[rows.idx] + rows.bin
                if owner is None:
                    found = [(c := np.flatnonzero(at[rows.row, t] >= 0), at[rows.row[c], t], np.full(len(c), t)) for t in range(len(slot))]
                    c, s, t = (np.concatenate(x) for x in zip(*found))
                else:
                    many = per[rows.idx]
                    c = np.repeat(np.arange(len(many)), many)
                    s = owner[np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[rows.idx], many)]
                    t = tree[s]
                    mine = np.flatnonzero(at[rows.row[c], t] == s)
                    c, s, t = c[mine], s[mine], t[mine]
                if not len(c):
                    continue
                r = rows.row[c]
                weight = w[r, t]
                sums = np.column_stack([weight * (rows.y[r] == k) for k in range(n_classes)])
                parts.append(_compact([(s.astype(np.int64) * cells + cell[c], np.ones(len(c)), sums)]))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_compact(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield handed_on(first, *parts[0])
                        parts, held = [], 0
        if parts:
            yield handed_on(first, *_compact(parts))

    def best(batches):
        parts, held = [], 0
        for b in batches:
            col = [c.to_numpy() for c in b.columns]
            parts.append((col[0].astype(np.int64) * cells + col[2], col[3], np.column_stack(col[4:])))
            held += len(b)
            if held > 2 * HELD:
                parts = [_compact(parts)]
                held = len(parts[0][0])
        if not parts:
            return
        bins, n_all, s_all = totals.value
        found = splits_of(bins, n_all, s_all, impurity, *_compact(parts))
        if len(found[0]):
            k, gain, f, cut, n, left = found
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(gain), pa.array(f.astype(np.int32)), pa.array(cut.astype(np.int32)), pa.array(n),
                                              *[pa.array(np.ascontiguousarray(x)) for x in left.T]], names=["slot", "gain", "f", "cut", "n", *names[4:]])

    summed = train.mapInArrow(add_up, schema).repartition("slot", "block")
    rows = summed.mapInArrow(best, "slot int, gain double, f int, cut int, n long, " + ", ".join(f"{c} double" for c in names[4:])).collect()
    shared.destroy()
    totals.destroy()
    winner: dict = {}
    for k, gain, f, cut, n, *left in rows:
        if k not in winner or (-gain, f) < winner[k][0]:
            winner[k] = ((-gain, f), f, cut, n, np.array(left))
    return [(k, *v[1:]) for k, v in sorted(winner.items())]


def splits_of(bins: Bins, n_all: np.ndarray, s_all: np.ndarray, impurity: str, key: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple:
    """(node, gain, feature, bin, rows, class weights of the first child) of each node's best split, from the sums of its
    held cells; the zero bins' are the rest of the node's."""
    cells = bins.cells
    s, cell = key // cells, key % cells
    f = np.searchsorted(bins.first, cell, side="right") - 1
    new = np.concatenate([[True], (np.diff(s) != 0) | (np.diff(f) != 0)])
    group = np.cumsum(new) - 1
    gs, gf = s[new], f[new]
    add = lambda x: np.bincount(group, x, len(gs))
    zero_n = n_all[gs] - add(n).astype(np.int64)
    zero_s = np.where(zero_n[:, None] > 0, np.maximum(s_all[gs] - np.column_stack([add(x) for x in sums.T]), 0.0), 0.0)
    group = np.concatenate([group, np.arange(len(gs))])
    bin_ = np.concatenate([cell - bins.first[f], bins.zero[gf]])
    order = np.lexsort((bin_, group))
    group, bin_ = group[order], bin_[order]
    left_n, left = np.concatenate([n, zero_n])[order], np.vstack([sums, zero_s])[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    rank = np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)]))
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(1, rank.max() + 2))
    for a, b in zip(edges, edges[1:]):  # running sums, a bin of all features at a time
        i = by_rank[a:b]
        left_n[i] += left_n[i - 1]
        left[i] += left[i - 1]
    s = gs[group]
    right_n, right = n_all[s] - left_n, np.maximum(s_all[s] - left, 0.0)
    total, wl, wr = s_all[s].sum(axis=1), left.sum(axis=1), right.sum(axis=1)
    gain = impurity_of(impurity, s_all)[s] - wl / total * impurity_of(impurity, left) - wr / total * impurity_of(impurity, right)
    gain = np.round(gain, DIGITS)
    ok = np.flatnonzero((left_n > 0) & (right_n > 0) & (gain > 0))
    ok = ok[np.lexsort((bin_[ok], gf[group[ok]], -gain[ok], s[ok]))]
    ok = ok[np.concatenate([[True], np.diff(s[ok]) != 0])] if len(ok) else ok
    return s[ok], gain[ok], gf[group[ok]], bin_[ok], left_n[ok], left[ok]


def predict(rows: DataFrame, router: Router, weights: np.ndarray) -> DataFrame:
    """The rows with ``prediction``: the class of the largest sum of the reached leaves' trees x nodes x classes ``weights``, the lowest of equals."""
    shared = rows.sparkSession.sparkContext.broadcast((router, weights))
    kept = [c for c in rows.columns if c not in ("key", "idx", "bin")]

    def run(batches):
        router, weights = shared.value
        for b in batches:
            out = np.zeros(len(b))
            for part in chunks(b, router.width + weights.shape[0] * weights.shape[2]):
                votes = weights[np.arange(len(weights)), router.leaf(part)].sum(axis=1)
                out[part.start:part.start + len(part)] = np.round(votes, 9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out)], names=[*kept, "prediction"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("prediction", T.DoubleType())]))


# --- ensembles -----------------------------------------------------------------------------

def forest(rows: DataFrame, train: DataFrame, bins: Bins, depth: int, trees: int, n_classes: int, impurity: str = "gini", seed: int = 42) -> DataFrame:
    """A random forest: each tree draws the rows with replacement, each node may split the rounded-up square root of all features;
    the leaves' class shares are summed.  Rows come back with ``prediction``."""
    def weigh(part):
        return draws(part.key, trees, seed)

    few = min(int(np.ceil(np.sqrt(bins.features))), bins.features)

    def choose(tree, node):
        return np.random.default_rng([seed, int(tree), int(node)]).choice(bins.features, few, replace=False)

    stats, count = root_sums(train, weigh, trees, n_classes)
    grown = grow(train, bins, stats, count, depth, impurity, weigh, choose if few else lambda *_: np.zeros(0, int))
    return predict(rows, grown.router(bins), shares(grown.stats))


def boost(rows: DataFrame, train: DataFrame, bins: Bins, impurity: str, depth: int, rate: float, rounds: int, n_classes: int) -> DataFrame:
    """SAMME boosting (Zhu et al. 2009) of weighted trees: alpha = rate (ln((1-err)/err) + ln(K-1)), misclassified training rows
    weigh exp(alpha) times more in the next round, and all weights sum to one.  A tree's error and the next round's class
    weights are made from the tree's leaves.  Rows come back with ``prediction``, the class of most alpha-weighted votes."""
    return voted(rows, bins, boosted(train, bins, [(impurity, depth, rate, rounds)], n_classes)[0], depth, n_classes)


def voted(rows: DataFrame, bins: Bins, found: tuple[list[Trees], list[float]], depth: int, n_classes: int) -> DataFrame:
    """The rows with the ``prediction`` of boosted trees."""
    trees, alphas = found
    past = _joined(trees) or Trees.roots(depth, np.zeros((1, n_classes)), np.zeros(1, int))
    votes = (past.classes()[..., None] == np.arange(n_classes)) * np.array(alphas or [0.0])[:, None, None]
    return predict(rows, past.router(bins), votes)


def boosted(train: DataFrame, bins: Bins, settings: list[tuple], n_classes: int) -> list[tuple[list[Trees], list[float]]]:
    """The trees and alphas of each setting (impurity, depth, rate, rounds), all boosted side by side.

    The cells are dealt out by feature once and held by the executors.  A level of all settings' trees is one small job: each task gets weight and node of all
    rows and says its features' best split of every open node and, a bit for each row, the side to which these splits
    bring it.  So no sums are shuffled, and neither weights nor nodes made anew from the trees so far.  The driver and a task hold some twenty bytes for each
    training row and setting, a task ``HELD_CELLS`` cells at most."""
    sc = train.sparkSession.sparkContext
    known = train.where(F.col("y").between(0, n_classes - 1))
    cells = known.select(F.sum(F.size("idx").cast("long"))).first()[0]
    if cells is None:
        return [([], []) for _ in settings]
    tasks = max(sc.defaultParallelism, 1 + cells // HELD_CELLS)
    shared = sc.broadcast(bins)

    def dealt(batches):
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            for rows in chunks(b, 1):
                to = rows.idx % tasks
                own = [np.flatnonzero(to == t) for t in range(tasks)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(tasks), pa.int32()), pa.array([part] * tasks, pa.int32()), pa.array([start] * tasks, pa.int64()), pa.array([rows.y.astype(np.int8).tobytes()] * tasks, pa.binary()),
                    *[pa.array([x[i].astype(kind).tobytes() for i in own], pa.binary()) for x, kind in ((rows.row, np.int32), (rows.idx, np.int32), (rows.bin, np.int16))]],
                    names=["to", "part", "start", "y", "row", "idx", "bin"])
                start += len(rows)

    def put_together(batches):
        if blocks := [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Columns.of(blocks, shared.value))], pa.binary())], names=["columns"])

    blocks = known.select("key", "y", "idx", "bin").mapInArrow(dealt, "to int, part int, start long, y binary, row binary, idx binary, bin binary")
    held = blocks.repartitionById(tasks, F.col("to")).mapInArrow(put_together, "columns binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    y = held.map(lambda x: pickle.loads(x).y).first()

    def ask(asked: dict) -> list[dict]:
        what = sc.broadcast(asked)
        out = held.map(lambda x: pickle.loads(x).answers(what.value)).collect()  # a split for each node, a bit for each row
        what.destroy()
        return out

    found = in_step([boosting(y, *s, n_classes) for s in settings], ask)
    held.unpersist()
    shared.destroy()
    return found


def in_step(runs: list, ask) -> list:
    """What the generators ``runs`` return; each yields a question and is sent its answers, ``ask`` being called once for all that still run."""
    out, asked = [None] * len(runs), {}

    def go(k, heard):
        try:
            asked[k] = runs[k].send(heard)
        except StopIteration as end:
            out[k] = end.value
            asked.pop(k, None)

    for k in range(len(runs)):
        go(k, None)
    while asked:
        heard = ask(asked)
        for k in list(asked):
            go(k, [h[k] for h in heard])
    return out


@dataclass
class Columns:
    """The held cells of some features and the classes of all rows.  The cells are numbered bin by bin, in each bin the
    features with most bins first, so that a bin's cells and those of the bin before are two even ranges."""

    feature: np.ndarray               # by place
    zero: np.ndarray                  # the number of each feature's zero cell
    first: np.ndarray                 # where each bin's cells begin
    width: np.ndarray                 # how many features have each bin
    y: np.ndarray = field(repr=False)
    row: np.ndarray = field(repr=False)   # of the held cells, in order of ``cell``
    cell: np.ndarray = field(repr=False)
    begin: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, blocks: list[tuple], bins: Bins) -> Columns:
        """From blocks (to, part, start, y, row, idx, bin) of rows, which are numbered in the order of part and start."""
        blocks = sorted(blocks, key=lambda b: b[1:3])
        y = [np.frombuffer(b[3], np.int8) for b in blocks]
        base = np.concatenate([[0], np.cumsum([len(x) for x in y])])
        row = np.concatenate([np.frombuffer(b[4], np.int32) + np.int32(i) for b, i in zip(blocks, base)])
        idx = np.concatenate([np.frombuffer(b[5], np.int32) for b in blocks])
        bin_ = np.concatenate([np.frombuffer(b[6], np.int16) for b in blocks])
        blocks.clear()
        feature = np.unique(idx)
        many = np.diff(bins.first)[feature]
        feature = feature[np.argsort(-many, kind="stable")]
        many = np.sort(many)[::-1]
        width = np.array([(many > b).sum() for b in range(many.max(initial=0))], int)
        first = np.concatenate([[0], np.cumsum(width)])
        place = np.zeros(bins.features, np.int32)
        place[feature] = np.arange(len(feature))
        cell = (first[bin_] + place[idx]).astype(np.int32)
        del idx, bin_
        order = np.argsort(cell, kind="stable")
        cell, row = cell[order], row[order]
        return cls(feature, first[bins.zero[feature]] + np.arange(len(feature)), first, width, np.concatenate(y), row, cell, np.searchsorted(cell, np.arange(first[-1] + 1)))

    def answers(self, asked: dict[int, tuple]) -> dict[int, tuple[dict, np.ndarray]]:
        """Best splits and the sides, packed, for each question (node of each row, weights, rows and class weights of the nodes, impurity)."""
        out = {}
        for k, (at, w, n_all, s_all, impurity) in asked.items():
            found = self.best(np.where(w > 0, at, len(n_all)), w, n_all, s_all, impurity)
            out[k] = found, np.packbits(self.right(at, found))
        return out

    def sums(self, at: np.ndarray, w: np.ndarray, nodes: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (nodes x cells) and class weights (classes x nodes x cells) of the held cells, ``at`` being each row's node (``nodes``: none)."""
        cells = self.first[-1]
        of_row = (self.y.astype(np.int64) * (nodes + 1) + at) * cells
        size = n_classes * (nodes + 1) * cells
        n, s = np.zeros(size, np.int64), np.zeros(size)
        for a in range(0, len(self.cell), CELLS):
            row = self.row[a:a + CELLS]
            key = of_row[row] + self.cell[a:a + CELLS]
            n += np.bincount(key, minlength=size)
            s += np.bincount(key, w[row], minlength=size)
        shape = (n_classes, nodes + 1, cells)
        return n.reshape(shape)[:, :nodes].sum(axis=0), s.reshape(shape)[:, :nodes]

    def best(self, at: np.ndarray, w: np.ndarray, n_all: np.ndarray, s_all: np.ndarray, impurity: str) -> dict[int, tuple]:
        """node -> (gain, feature, bin, rows and class weights of the first child), each node's best split by one of these features."""
        nodes, n_classes = s_all.shape
        n, s = self.sums(at, w, nodes, n_classes)
        if not len(self.feature):
            return {}
        held_n, held_s = n[:, :len(self.feature)].copy(), s[..., :len(self.feature)].copy()
        for a, m in zip(self.first[1:], self.width[1:]):
            held_n[:, :m] += n[:, a:a + m]
            held_s[..., :m] += s[..., a:a + m]
        n[:, self.zero] = n_all[:, None] - held_n  # the zero bins' sums are the rest of the node's
        s[..., self.zero] = np.where(n[:, self.zero] > 0, np.maximum(s_all.T[..., None] - held_s, 0.0), 0.0)
        there = n > 0
        for before, a, m in zip(self.first, self.first[1:], self.width[1:]):  # running sums, a bin of all features at a time
            n[:, a:a + m] += n[:, before:before + m]
            s[..., a:a + m] += s[..., before:before + m]
        node, cell = np.nonzero(there & (n < n_all[:, None]))
        left, total = s[:, node, cell], s_all.sum(axis=1)[node]
        right = np.maximum(s_all.T[:, node] - left, 0.0)
        gain = impurity_of(impurity, s_all)[node] - left.sum(axis=0) / total * impurity_of(impurity, left, 0) - right.sum(axis=0) / total * impurity_of(impurity, right, 0)
        gain = np.round(gain, DIGITS)
        out, ends = {}, np.searchsorted(node, np.arange(nodes + 1))
        for k in range(nodes):
            mine = slice(ends[k], ends[k + 1])
            most = gain[mine].max(initial=0.0)
            if most > 0:
                i = np.flatnonzero(gain[mine] == most) + ends[k]
                bin_ = np.searchsorted(self.first, cell[i], side="right") - 1
                f, b, i = min(zip(self.feature[cell[i] - self.first[bin_]].tolist(), bin_.tolist(), i.tolist()))
                out[k] = float(most), f, b, int(n[k, cell[i]]), left[:, i]
        return out

    def right(self, at: np.ndarray, found: dict[int, tuple]) -> np.ndarray:
        """Whether each row goes to the second child by its node's split in ``found``."""
        out = np.zeros(len(self.y), bool)
        for k, (_, f, cut, *_) in found.items():
            p = int(np.flatnonzero(self.feature == f)[0])
            far = self.zero[p] >= self.first[cut + 1]
            if far:
                out[at == k] = True
            bins = range(cut + 1) if far else range(cut + 1, int(np.searchsorted(-self.width, -p, side="left")))
            for b in bins:
                c = self.first[b] + p
                rows = self.row[self.begin[c]:self.begin[c + 1]]
                out[rows[at[rows] == k]] = not far
        return out


def boosting(y: np.ndarray, impurity: str, depth: int, rate: float, rounds: int, n_classes: int):
    """One setting of ``boosted``, on rows of classes ``y``: yields what it asks of each level, is sent all tasks' best splits and sides; returns (trees, alphas)."""
    n = len(y)
    count, stats = np.array([n]), np.bincount(y, minlength=n_classes)[None] / n
    kept, alphas, spent, scale = [], [], np.zeros(n), -np.log(n)
    for _ in range(rounds):
        w = np.exp(spent + scale)
        t, node, open_ = Trees.roots(depth, stats, count), np.zeros(n, np.int32), [0]
        for _ in range(depth):
            open_ = [v for v in open_ if impurity_of(impurity, t.stats[0, v]) > 10.0 ** -DIGITS]
            if not open_:
                break
            slot = np.full(t.feature.shape[1], len(open_), np.int8 if depth < 7 else np.int32)
            slot[open_] = np.arange(len(open_))
            at = slot[node]
            heard = yield at, w, t.count[0, open_], t.stats[0, open_], impurity
            sides, opened = {}, []
            for k, v in enumerate(open_):
                best = min(((-h[k][0], h[k][1], i) for i, (h, _) in enumerate(heard) if k in h), default=None)
                if best is None:
                    continue
                i = best[2]
                _, f, b, rows, left = heard[i][0][k]
                t.feature[0, v], t.bin[0, v] = f, b
                t.count[0, 2 * v + 1], t.count[0, 2 * v + 2] = rows, t.count[0, v] - rows
                t.stats[0, 2 * v + 1], t.stats[0, 2 * v + 2] = left, np.maximum(t.stats[0, v] - left, 0.0)
                if i not in sides:
                    sides[i] = np.unpackbits(heard[i][1], count=n)
                mine = np.flatnonzero(at == k)
                node[mine] = 2 * v + 1 + sides[i][mine]
                opened += [2 * v + 1, 2 * v + 2]
            open_ = opened
        t.pruned()
        leaves, best = t.leaves()[0], t.classes()[0]
        at = t.stats[0][leaves]
        missed = np.arange(n_classes) != best[leaves][:, None]
        err = float((at * missed).sum() / at.sum())
        if err <= 10.0 ** -DIGITS:
            kept.append(t)
            alphas.append(1.0)
            break
        if err >= 1.0 - 1.0 / n_classes:
            break
        alpha = float(rate * (np.log((1.0 - err) / err) + np.log(n_classes - 1.0)))
        kept.append(t)
        alphas.append(alpha)
        at = np.where(missed, at * np.exp(alpha), at)
        scale -= np.log(at.sum())
        stats = (at.sum(axis=0) / at.sum())[None]
        spent += alpha * (best[t.ends()[node]] != y)
    return kept, alphas


def _joined(trees: list[Trees]) -> Trees | None:
    return Trees(*[np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "bin", "stats", "count")]) if trees else None
