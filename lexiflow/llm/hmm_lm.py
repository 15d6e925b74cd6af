"""Language-model scores by a hidden Markov model over word classes.

The model: a hidden state emits a word's class; the class gives the word.  The
``OWN`` most frequent words (and the end of a text) are classes of their own;
other words share a class by the hash of their last three bytes, in which a word has the
share (c + 1) / (T + D + 1) of its class (T tokens, D distinct words; the
remaining 1 is for all unseen words together).  So the probabilities of all texts of a length add up to one.

Word counts come from every training text, summed up in each task before the shuffle.  ``HEAD``
words (by a count threshold, so at most that many) travel to the tasks; counts
of all rarer words are joined by a shuffle.  Baum-Welch runs over every training
text: tasks work on many short texts, or on pieces of ``PIECE`` tokens of long ones, at once and emit expected counts per
class, which Spark sums over all tasks; the new parameters, whose size
is fixed, are set on the driver.  A long text's pieces get their forward and backward
messages from products of transition and emission matrices over the pieces between, so the counts, edges
included, are those of whole texts and don't depend on ``PIECE``.  Scoring runs the scaled forward recursion over
each whole text, exactly.

Nulls: a null text is empty, its only token the end; a null id counts as the
empty text in the split.  With no training text the model is uniform over its
classes.  Empty tables give empty results; every row gives one row.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import batch, map_batches, stored

END = b""  # no word is empty
STATES, ROUNDS, SEED = 8, 5, 11
#: Texts up to ``WHOLE`` tokens are worked on in one piece, longer ones in pieces of ``PIECE`` tokens.
WHOLE, PIECE = 1024, 128
OWN, BUCKETS, HEAD = 4096, 1024, 100_000
FOLDS, HELD_OUT = 7, 2
#: Distinct words that a task counts before it hands the counts on.
MOST_COUNTED = 200_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS, F.lit(0)) == HELD_OUT


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c): word counts of the only column of ``texts``."""
    def run(batches):
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        count: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                count.update(tokens(x))
            if len(count) >= MOST_COUNTED:
                yield batch(schema, list(count), list(count.values()))
                count.clear()
        yield batch(schema, list(count), list(count.values()))

    return map_batches(texts, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Counts and classes of the words that every task knows."""

    def __init__(self, words: list[tuple[bytes, int]], bucket_tokens: np.ndarray, total: int, distinct: int, own: int = OWN):
        words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.own = {END: 0} | {w: k + 1 for k, w in enumerate([w for w, _ in words if w][:own - 1])}
        self.count = dict(words)
        self.total, self.distinct = total, distinct
        self.classes = len(self.own) + BUCKETS
        self.bucket_tokens = bucket_tokens  # T + D + 1 by bucket
        unigram = np.ones(self.classes)
        for w, k in self.own.items():
            unigram[k] += self.count.get(w, 0)
        unigram[len(self.own):] += bucket_tokens
        self.unigram = unigram / unigram.sum()

    def table(self) -> dict[bytes, tuple[int, float, float]]:
        """Word -> class, log10(c + 1), log10 of its share of the class."""
        out = {}
        for w in {**self.count, END: 0}:
            c = self.count.get(w, 0)
            k = self.own.get(w)
            b = bucket(w)
            out[w] = (k, np.log10(c + 1), 0.0) if k is not None else (
                len(self.own) + b, np.log10(c + 1), np.log10(c + 1) - np.log10(self.bucket_tokens[b]))
        return out


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def lexicon(counts: DataFrame, own: int = OWN, head: int = HEAD) -> tuple[Lexicon, int]:
    """The lexicon of the counts, and the least count of a word in it."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    upto, least = 0, 1
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head + 1).collect():
        upto += r["n"]
        if upto > head:
            least = r["c"] + 1
            break
    words = [(bytes(r["word"]), r["c"]) for r in counts.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).collect()]
    top = {w for w, _ in sorted(((w, c) for w, c in words if w), key=lambda x: (-x[1], x[0]))[:own - 1]} | {END}
    b = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(BUCKETS))
    sums = np.ones(BUCKETS)
    for r in counts.groupBy(b.alias("b")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        sums[r["b"]] += r["n"]
    for w, c in words:  # words with a class of their own
        if w in top:
            sums[bucket(w)] -= c + 1
    return Lexicon(words, sums, total, distinct, own), least


def encode(docs: DataFrame, lex, id_col: str, text_col: str) -> DataFrame:
    """One stored row per text: row, id, held_out, n_tokens, n_head (words of the lexicon), log_c and log_share
    (sums over those, and of all class sizes), classes (16-bit numbers), rare (words outside the lexicon)."""
    src = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        known = lex.value.table()
        base, size = len(lex.value.own), np.log10(lex.value.bucket_tokens).tolist()
        row = TaskContext.get().partitionId() << 33
        names = ["row", "id", "held_out", "n_tokens", "n_head", "log_c", "log_share", "classes", "rare"]
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                words = tokens(x)
                log_c = log_share = 0.0
                classes, rare = [], []
                for w in words:
                    hit = known.get(w)
                    if hit is None:
                        k = bucket(w)
                        rare.append(w)
                        log_share -= size[k]
                        classes.append(base + k)
                    else:
                        classes.append(hit[0])
                        log_c += hit[1]
                        log_share += hit[2]
                row += 1
                out.append((row, len(words), len(words) - len(rare), log_c, log_share, np.array(classes, "<u2").tobytes(), rare))
            r, n, k, c, s, cls, rare = map(list, zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(c, pa.float64()),
                 pa.array(s, pa.float64()), pa.array(cls, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=names)

    kind = src.schema["id"].dataType.simpleString()
    return stored(map_batches(src, run, f"row long, id {kind}, held_out boolean, n_tokens long, n_head long, log_c double, "
                                        "log_share double, classes binary, rare array<binary>"), "encoded")


# --- the hidden Markov model --------------------------------------------------

class Model:
    """start (S), step (S, S), emit (classes + 1, S); the last class is padding, which every state emits surely."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
        step = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(step, 0.95)
        return cls(np.full(states, 1 / states), step / step.sum(1, keepdims=True), np.vstack([emit / emit.sum(0), np.ones(states)]))

    @classmethod
    def from_counts(cls, start, step, emit, unigram: np.ndarray, prior: float = 20.0) -> Model:
        emit = emit + prior * unigram[:, None]
        return cls((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(1, keepdims=True), np.vstack([emit / emit.sum(0), np.ones(len(start))]))

    def expected(self, obs: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Expected counts (start, step, emit) of pieces ``obs`` (time, piece), padded at the end.

        ``before`` (piece, S) is the forward message of the token in front of a piece, zero where a text starts there;
        ``after`` (piece, S) the backward message at a piece's last token, of ones where a text ends there.  The step into a
        piece is counted with it."""
        n, pieces = obs.shape
        states, pad = len(self.start), len(self.emit) - 1
        before = np.zeros((pieces, states)) if before is None else before
        opens = ~before.any(1)
        alpha = np.empty((n, pieces, states))
        scale = np.empty((n, pieces, 1))
        a = before @ self.step
        a[opens] = self.start
        for t in range(n):
            a = (a if t == 0 else a @ self.step) * self.emit[obs[t]]
            s = a.sum(1, keepdims=True)
            a = a / s
            alpha[t], scale[t] = a, s
        beta = np.ones((pieces, states)) if after is None else after / (a * after).sum(1, keepdims=True)
        step = np.zeros((states, states))
        for t in range(n - 1, -1, -1):
            e = self.emit[obs[t]] * beta / scale[t]
            step += (alpha[t - 1] if t else before).T @ (e * (obs[t] != pad)[:, None])
            alpha[t] *= beta
            beta = e @ self.step.T
        flat = obs.ravel()
        emit = np.stack([np.bincount(flat, alpha[:, :, s].ravel(), pad + 1)[:pad] for s in range(states)], 1)
        return alpha[0][opens & (obs[0] != pad)].sum(0), step * self.step, emit

    def messages(self, obs: np.ndarray, opens: np.ndarray):
        """Forward and backward messages (piece, S) of pieces ``obs`` (time, piece), as ``expected`` takes them; a text's
        pieces follow one another, the first is marked in ``opens``."""
        n, pieces = obs.shape
        states = len(self.start)
        # over[k]: the product of (step x emission) over all tokens of piece k, up to a factor
        over = np.repeat(np.eye(states)[None], pieces, 0)
        first = np.repeat(self.start[None], opens.sum(), 0)
        for t in range(n):
            e = self.emit[obs[t]]
            over = (over.reshape(-1, states) @ self.step).reshape(pieces, states, states) * e[:, None, :]
            first = (first @ self.step if t else first) * e[opens]
            if t % 8 == 7:
                over /= over.sum((1, 2), keepdims=True)
                first /= first.sum(1, keepdims=True)
        before, after = np.zeros((pieces, states)), np.ones((pieces, states))
        ends = iter(first)
        for k in range(pieces):
            if opens[k]:
                a = next(ends)
            else:
                before[k] = a
                a = a @ over[k]
            a = a / a.sum()
        for k in range(pieces - 2, -1, -1):
            if not opens[k + 1]:
                b = over[k + 1] @ after[k + 1]
                after[k] = b / b.sum()
        return before, after

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over whole texts, all at once: longest first, a text leaves when it ends."""
        n = np.array([len(x) for x in texts])
        order = np.argsort(-n, kind="stable")
        out, m = np.zeros(len(texts)), n[order]
        if not len(texts) or not m[0]:
            return out
        flat = np.concatenate([texts[i] for i in order])
        first = np.cumsum(m) - m
        live = np.searchsorted(-m, -np.arange(m[0]), side="left")  # texts longer than t
        total, prod = np.zeros(len(texts)), np.ones(len(texts))
        a = np.repeat(self.start[None, :], len(texts), 0)
        for t, k in enumerate(live.tolist()):
            a = a[:k] if t == 0 else a[:k] @ self.step
            a = a * self.emit[flat[first[:k] + t]]
            s = a.sum(1)
            a /= s[:, None]
            prod[:k] *= s
            if t % 16 == 15:
                total[:k] += np.log10(prod[:k])
                prod[:k] = 1
        out[order] = total + np.log10(prod)
        return out


def grid(rows: list[np.ndarray], pad: int) -> np.ndarray:
    """(time, piece) array of the rows, padded at the end."""
    obs = np.full((max(map(len, rows)), len(rows)), pad, np.int64)
    for k, x in enumerate(rows):
        obs[:len(x), k] = x
    return obs


def expected_counts(model: Model, texts, whole: int = WHOLE, piece: int = PIECE, wide: int = 512):
    """Expected counts (start, step, emit) of texts.  Those up to ``whole`` tokens run side by side, of like
    lengths together; pieces of ``piece`` tokens of the longer ones side by side, between messages."""
    pad = len(model.emit) - 1
    short: list[np.ndarray] = []
    cut: list[np.ndarray] = []
    opens: list[bool] = []

    def run_short():
        short.sort(key=len, reverse=True)
        for i in range(0, len(short), wide):
            yield model.expected(grid(short[i:i + wide], pad))
        short.clear()

    def run_cut():
        if cut:
            before, after = model.messages(grid(cut, pad), np.array(opens))
            for i in range(0, len(cut), wide):
                yield model.expected(grid(cut[i:i + wide], pad), before[i:i + wide], after[i:i + wide])
        cut.clear()
        opens.clear()

    for x in texts:
        if len(x) > whole:
            cut += [x[i:i + piece] for i in range(0, len(x), piece)]
            opens += [i == 0 for i in range(0, len(x), piece)]
        elif len(x):
            short.append(x)
        if len(short) >= 4 * wide:
            yield from run_short()
        if len(cut) >= 2 * wide:
            yield from run_cut()
    yield from run_short()
    yield from run_cut()


def baum_welch(classes: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Fit to the column ``classes``; counts of all texts are added up by Spark."""
    spark, size = classes.sparkSession, lex.classes
    model = Model.first(lex.unigram, states, seed)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            m, emit = sent.value, np.zeros((size, states))
            start, step = np.zeros(states), np.zeros((states, states))
            texts = (np.frombuffer(x, "<u2") for b in batches for x in b.column(0).to_pylist())
            for a, b, c in expected_counts(m, texts):
                start += a
                step += b
                emit += c
            # rows: classes, then start, then steps
            rows = np.vstack([emit, start[None, :], step])
            used = np.flatnonzero(rows.any(1))
            flat = pa.array(rows[used].ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.ListArray.from_arrays(
                pa.array(np.arange(len(used) + 1) * states, pa.int32()), flat)], names=["k", "v"])

        sums = map_batches(classes, run, "k long, v array<double>").groupBy("k").agg(*[F.sum(F.col("v")[s]).alias(f"s{s}") for s in range(states)])
        rows = np.zeros((size + 1 + states, states))
        for r in sums.collect():
            rows[r["k"]] = r[1:]
        model = Model.from_counts(rows[size], rows[size + 1:], rows[:size], lex.unigram)
        sent.unpersist()
    return model


def likelihoods(encoded: DataFrame, model: Model, most: int = 4 << 20) -> DataFrame:
    """The input's columns but ``classes``, and ``log_p`` of the class sequence; groups of up to ``most`` tokens."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    names = [c for c in encoded.columns if c != "classes"]
    src = encoded.select(*names, "classes")

    def run(batches):
        held, n = [], 0

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = [np.frombuffer(x, "<u2") for x in rows.column("classes").to_pylist()]
            out = rows.drop_columns(["classes"]).append_column("log_p", pa.array(sent.value.log10_likelihood(texts)))
            return out.to_batches()

        for b in batches:
            held.append(b)
            n += b.column(b.num_columns - 1).nbytes // 2
            if n >= most:
                yield from done()
                held, n = [], 0
        if held:
            yield from done()

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return map_batches(src, run, f"{kind}, log_p double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Fit on the training rows, score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark: SparkSession = docs.sparkSession
    counts = stored(count_words(docs.where(~is_held_out(id_col)).select(F.col(text_col).cast("string"))), "word-counts")
    lex, least = lexicon(counts)
    sent = spark.sparkContext.broadcast(lex)
    rows = encode(docs, sent, id_col, text_col)
    model = baum_welch(rows.where("NOT held_out").select("classes"), lex, states, rounds)
    rare = (rows.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("c") < least), "word")
            .groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1.0)).alias("log_rare")))
    scored = likelihoods(rows.drop("rare"), model).join(rare, F.col("row") == F.col("_row"), "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    head_known = F.col("n_head") if lex.count.get(END) else F.col("n_head") - 1
    return scored.select(
        "id", "held_out", "n_tokens", (head_known + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + log_rare - F.col("n_tokens") * F.lit(float(np.log10(lex.total + lex.distinct + 1)))).alias("base_score"),
        (F.col("log_p") + F.col("log_share") + log_rare).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs).withColumnRenamed("id", "doc_id")
