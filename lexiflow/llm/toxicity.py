"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

``gram_ids``     hashed character n-grams that a text holds
``log_ratios``   how much commoner a gram is in the texts of label 1 than in those of label 0, as a logarithm
``fit``          weights of a logistic regression whose features are the ratios of the grams present
``report``       score and prediction for every document

Ratios come from counts of all labelled training texts, summed by Spark per hashed gram.  A gram
whose ratio is within ``LEAST_Z`` standard errors of 0 has the feature 0.  The weights are learned
from about ``SAMPLE`` training texts: those whose id's hash lies in the share of hashes that holds so many (all, where there
are fewer), so the bound is by expectation.  Each step of the descent is a Spark job over the sample's stored
features, and only gradients, of at most ``2 ** BITS`` numbers, reach the driver.

Only the text is an input of a score.  Labels of rows whose crc32 of the id as text is divisible by ``FOLDS`` are
never read into counts or weights.  Nulls: a null text is read as empty and gets the score of no grams; a null id counts
as the empty text in that fold rule; rows without a label or with a null one teach nothing.  Every row of the documents gives one row; a document
with several rows or labels teaches once for each pair of them.  Without both labels all scores are
0 or 1 up to rounding: that of the only label, 0 without labels.  Texts are read whole, in pieces of ``CHUNK`` characters.  Only the named
columns are read, so other columns may have any names.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import fits, map_batches, stored
from lexiflow.operators.optimise import Lbfgs

FOLDS = 5
NGRAMS, BITS = (3, 4, 5), 20
SMOOTH, LEAST_Z = 1.0, 2.0
SAMPLE = 20_000
PENALTY, ROUNDS = 10.0, 40
CHUNK = 1 << 20
SLICES = 16  # of the sample's stored features
HASHES = 1 << 40
SURE = 40.0  # logits end here
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def _distinct(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each value once; ``place`` is scratch space."""
    at = np.arange(len(ids), dtype=np.int32)
    place[ids] = at
    return ids[place[ids] == at]


def gram_ids(text: str, place: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The hashed n-grams of a text in lower case, white space runs as one space, a space at either end; each once."""
    words = " ".join(text.lower().split())
    if not words:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, longest = [], max(NGRAMS)
    for start in range(0, len(points), CHUNK):
        part = points[start:start + CHUNK + longest - 1]
        h, ids = part, []
        for n in range(2, longest + 1):
            h = h[:-1] * STEP + part[n - 1:]
            if n in NGRAMS:
                ids.append((((h + np.uint64(n)) ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - bits)).astype(np.int64))
        found.append(_distinct(np.concatenate(ids), place))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found), place)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) for each document row and label of the training folds."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known) if fits(labels) else known, "id")


def gram_counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(gram, ones, zeros): training texts of each label that hold the gram, summed in each task first; gram -1 counts all texts."""
    def run(batches):
        place, counts, texts = np.empty(1 << bits, np.int32), np.zeros((2, 1 << bits), np.int64), [0, 0]
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                counts[label][gram_ids(text, place, bits)] += 1
                texts[label] += 1
        grams = np.nonzero(counts.any(0))[0]
        for i in range(0, len(grams), 1 << 16):
            part = grams[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, counts[1][part], counts[0][part])], names=["gram", "ones", "zeros"])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, texts[1], texts[0])], names=["gram", "ones", "zeros"])

    each = map_batches(rows.select("text", "label"), run, "gram long, ones long, zeros long")
    return each.groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def log_ratios(counts: DataFrame, ones: int, zeros: int) -> DataFrame:
    """(gram, ratio) of the grams that tell the labels apart; smoothing is dealt out by the labels' shares, so an unseen gram's ratio is 0."""
    n = ones + zeros
    a, b = F.col("ones") + SMOOTH * ones / n, F.col("zeros") + SMOOTH * zeros / n
    ratio = F.log(a / ones) - F.log(b / zeros)
    error = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    return counts.where("gram >= 0").withColumn("ratio", ratio).where(F.abs("ratio") >= LEAST_Z * error).select("gram", "ratio")


def _features(rows: DataFrame, place_of: np.ndarray, bits: int) -> DataFrame:
    """(label, used): which of the used grams each text holds, by their number in ``place_of`` (-1: not used); stored."""
    shared = rows.sparkSession.sparkContext.broadcast(place_of)

    def run(batches):
        place = np.empty(1 << bits, np.int32)
        for b in batches:
            ids = [shared.value[gram_ids(x, place, bits)] for x in b.column("text").to_pylist()]
            ids = [x[x >= 0] for x in ids]
            ends, flat = np.cumsum([0, *map(len, ids)]), np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))],
                                             names=["label", "used"])

    return stored(map_batches(rows.select("text", "label"), run, "label int, used array<int>").repartition(SLICES), "toxic-features")


def _loss_and_slope(features: DataFrame, scale: np.ndarray, point: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed log loss of the sample and its gradient at ``point``, whose last number is the constant; one row from each task."""
    shared = features.sparkSession.sparkContext.broadcast((scale, point))

    def run(batches):
        scale_, w = shared.value
        v, loss, slope = scale_ * w[:-1], 0.0, np.zeros(len(w))
        for b in batches:
            used, y = b.column("used"), b.column("label").to_numpy().astype(float)
            ends = used.offsets.to_numpy()
            flat = used.values.to_numpy()[ends[0]:ends[-1]]
            row = np.repeat(np.arange(len(y)), np.diff(ends))
            z = np.bincount(row, weights=v[flat], minlength=len(y)) + w[-1]
            loss += float(np.sum(np.logaddexp(0.0, z) - y * z))
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            slope[:-1] += np.bincount(flat, weights=off[row], minlength=len(v))
            slope[-1] += off.sum()
        slope[:-1] *= scale_
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    rows = map_batches(features, run, "loss double, slope binary").collect()
    shared.destroy()
    return sum(r["loss"] for r in rows), np.sum([np.frombuffer(r["slope"]) for r in rows], axis=0)


def fit(rows: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weight of each hashed gram, constant) of the logit of label 1."""
    counts = stored(gram_counts(rows, bits), "gram-counts")
    total = counts.where("gram = -1").select("ones", "zeros").first()
    ones, zeros = total or (0, 0)
    weights = np.zeros(1 << bits)
    if not ones or not zeros:
        return weights, SURE if ones else -SURE
    known = log_ratios(counts, ones, zeros).toPandas()  # at most 2 ** bits rows
    used, scale = known["gram"].to_numpy(), known["ratio"].to_numpy()
    place_of = np.full(1 << bits, -1, np.int32)
    place_of[used] = np.arange(len(used))
    share = min(1.0, sample / (ones + zeros))
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < int(share * HASHES))
    features = _features(few, place_of, bits)
    n = max(features.count(), 1)
    descent = Lbfgs(np.zeros(len(used) + 1), tolerance=1e-5, rounds=ROUNDS)
    while not descent.done:
        w = descent.trial
        loss, slope = _loss_and_slope(features, scale, w)
        held = np.append(w[:-1], 0.0) * PENALTY
        descent.tell((loss + held @ w / 2) / n, (slope + held) / n)
    weights[used] = scale * descent.point[:-1]
    return weights, float(descent.point[-1])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 of every row's text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, constant = shared.value
        bits = len(weights).bit_length() - 1
        place = np.empty(1 << bits, np.int32)
        for b in batches:
            z = [float(weights[gram_ids(x or "", place, bits)].sum()) + constant for x in b.column("text").to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -SURE, SURE)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p)], names=["id", "score"])

    return map_batches(src, run, T.StructType([src.schema["id"], T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, fit(training_rows(docs, labels)))
    return rows.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
