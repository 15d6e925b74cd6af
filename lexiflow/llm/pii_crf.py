"""Personal data: fixed patterns, and a skip-chain conditional random field.

``pattern_spans`` finds e-mail addresses, IP addresses, card and phone numbers by rule.  The field adds
spans that the rules miss or drop (a card number that runs into the next
number, a number repeated without its prefix).  Its nodes are a document's tokens that hold a digit or ``@``;
its labels ``O`` and the four kinds.

* node potentials: a softmax model of a token's shape and neighbours (a leading ``+`` only counts as part of the
  shape: it is what the rule asks for, so a feature of its own would outweigh everything else)
* chain potentials: between consecutive nodes, apart for touching and distant ones
* skip potentials: between a token and the next one in the document, not beside it, with the same letters and digits, or
  the same last digits; a chain of such links keeps all repeats of an entity consistent at linear cost

Loopy belief propagation runs on each text as a graph of its own
(documents share no edges), until no message changes by more than ``SETTLED``, so that evidence
crosses any number of links; where loops keep it from settling, it ends after ``SPARE`` rounds more than there are nodes.  A label is used where its marginal reaches ``SURE``
on each token of a run; the span must not overlap a span of the rules.

Training is piecewise, on labels that the rules give: ``fit`` takes whole documents, at most
``SAMPLE_DOCS``, in the order of a hash of their ids.  Tokens that the rules leave alone but that resemble an entity of their
document are not taken as negatives.  Spark counts equal nodes (features and label) and the label pairs of edges;
at most ``SAMPLE_NODES`` distinct nodes, in the order of a hash, reach the driver.  Node weights come from gradient
descent on these counts, edge potentials from the smoothed counts of label pairs.

Nulls: a null text is read as empty and has no spans; rows with a null id are
judged like others.  Without labelled nodes (also an empty table) the field adds
nothing.  Every input row gives one row, also repeated ones.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import batch, first_by_hash, map_batches, scan_spans, span_digest, stored

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *KINDS]
SAMPLE_DOCS, SAMPLE_NODES = 20_000, 100_000
SURE = 0.9
SETTLED, SPARE = 1e-4, 64
#: Bounds of the log potentials of touching, distant and skip edges.
LIMITS = (1.5, 1.5, 6.0)
#: Before any edge is counted: the share of similar tokens with equal labels.
ALIKE = 0.99
#: Distinct nodes and edges that a task counts before it hands the counts on.
MOST_COUNTED = 100_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NODE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str):
    """Leftmost matches of local@domain; each ``@`` looks back over its own local part once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def pattern_spans(text: str) -> list[tuple[str, int, int, bool]]:
    out = [("email", a, b, True) for a, b in emails(text)]
    if not NODE.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end(), True))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end(), True))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end(), True))
    return out


def doubtful_spans(text: str) -> list[tuple[int, int]]:
    """Matches that the rules drop: what they hold is neither a sure entity nor surely none."""
    out = [m.span() for m in IP.finditer(text)]
    out += [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 12]
    return out + [m.span() for m in PHONE.finditer(text)]


# --- nodes ------------------------------------------------------------------

def shape(word: str) -> str:
    """Letters and digits as classes with run lengths up to 19."""
    out, i = [], 0
    while i < len(word) and len(out) < 16:
        c = word[i]
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        j = i
        while j < len(word) and ("9" if "0" <= word[j] <= "9" else "a" if word[j].isalpha() else word[j]) == kind:
            j += 1
        out.append(kind if kind == "a" else f"{kind}{min(j - i, 19)}")
        i = j
    return "".join(out)


def nodes_of(text: str, base: list[tuple[str, int, int, bool]], doubtful: list[tuple[int, int]] = ()):
    """(start, end, label, key, features, token number, last digits) of each
    node, in order; the label is -1 within a doubtful span without a sure one, and where only a similar token is in a sure one."""
    if not NODE.search(text):
        return []
    words = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    spans = sorted((a, b, k) for k, a, b, _ in base)
    out, s = [], 0
    for i, (a, b) in enumerate(words):
        word = text[a:b]
        if not NODE.search(word):
            continue
        core = word.strip("\"'.,;:!?()[]{}<>=")
        if not core:
            core = word
        start = a + word.find(core)
        end = start + len(core)
        while s < len(spans) and spans[s][1] <= start:
            s += 1
        label = 0
        for x, y, k in spans[s:s + 4]:
            if x < end and y > start:
                label = LABELS.index(k)
                break
        if not label and any(x < end and y > start for x, y in doubtful):
            label = -1
        digits = "".join(c for c in core if "0" <= c <= "9")
        letters = sum(c.isalpha() for c in core)
        before = text[words[i - 1][0]:words[i - 1][1]] if i else "^"
        after = text[words[i + 1][0]:words[i + 1][1]] if i + 1 < len(words) else "$"
        dots = core.count(".")
        octets = core.split(".") if dots == 3 else []
        feats = ["bias", f"shape={shape(core)}", f"digits={min(len(digits), 20)}", f"letters={min(letters, 12)}",
                 f"at={min(core.count('@'), 2)}", f"dots={min(dots, 4)}",
                 f"quad={len(octets) == 4 and all(x.isdigit() and len(x) <= 3 for x in octets)}",
                 f"luhn={len(digits) >= 14 and not letters and luhn(digits)}",
                 f"before={shape(before)}" if NODE.search(before) else "before=word",
                 f"after={shape(after)}" if NODE.search(after) else "after=word"]
        key = "".join(c for c in core.lower() if c.isalnum())
        out.append((start, end, label, key if len(key) >= 5 else "", feats, i, digits[-7:] if len(digits) >= 7 and not letters else ""))
    alike = {key for n in out if n[2] > 0 for key in keys_of(n)}
    return [(*n[:2], -1, *n[3:]) if not n[2] and not alike.isdisjoint(keys_of(n)) else n for n in out]


def keys_of(node) -> set[tuple[str, str]]:
    """What a node shares with its repeats and similar tokens."""
    return {(kind, x) for kind, x in (("t", node[3]), ("d", node[6])) if x}


def edges_of(nodes, at: int):
    """(i, j, type) with node numbers from ``at``: 0 touching tokens, 1 distant tokens, 2 a repeat or similar token."""
    out, last = [], {}
    for k, n in enumerate(nodes):
        if k:
            out.append((at + k - 1, at + k, 0 if n[5] - nodes[k - 1][5] == 1 else 1))
        keys = keys_of(n)
        for j in sorted({last[key] for key in keys if key in last}):
            if n[5] - nodes[j][5] > 1:
                out.append((at + j, at + k, 2))
        last.update(dict.fromkeys(keys, k))
    return out


# --- inference --------------------------------------------------------------

def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """Label marginals by loopy sum-product: ``unary`` (n, L) and ``pair``
    (types, L, L) in logs, ``edges`` (m, 3).  A message is damped by half; the
    result is exact on trees."""
    soft = lambda x: np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)
    if not len(edges):
        return soft(unary)
    i, j, kind = edges.T
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    table = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(len(unary) + SPARE):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + table
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - msg).max()
        msg = 0.5 * msg + 0.5 * new
        if change < settled:
            break
    total = unary.copy()
    np.add.at(total, dst, msg)
    return soft(total)


class Field:
    """Fitted weights: feature -> row of ``weights``; ``pair`` by edge type."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.index, self.weights, self.pair = index, weights, pair

    def unary(self, feats: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.weights
        return np.array([w[[k for f in x if (k := get(f)) is not None]].sum(0) for x in feats])

    def extra_spans(self, texts: list[str], base: list[list]) -> list[list]:
        """Spans that the field adds to the ``base`` ones of each text."""
        out = [[] for _ in texts]
        all_nodes, edges, where = [], [], []
        for t, (text, spans) in enumerate(zip(texts, base)):
            nodes = nodes_of(text, spans)
            edges += edges_of(nodes, len(all_nodes))
            all_nodes += nodes
            where += [t] * len(nodes)
        if not all_nodes or not len(self.index):
            return out
        p = marginals(self.unary([n[4] for n in all_nodes]), np.array(edges, int).reshape(-1, 3), self.pair)
        best = p.argmax(1)
        best[p.max(1) < SURE] = 0
        k = 0
        while k < len(all_nodes):
            e = k + 1
            if best[k]:
                while (e < len(all_nodes) and LABELS[best[k]] == "phone" and best[e] == best[k] and where[e] == where[k]
                       and all_nodes[e][5] == all_nodes[e - 1][5] + 1):
                    e += 1
                t, a, b = where[k], all_nodes[k][0], all_nodes[e - 1][1]
                if plausible(LABELS[best[k]], texts[t][a:b]) and not any(x < b and y > a for _, x, y, _ in base[t]):
                    out[t].append((LABELS[best[k]], a, b, False))
            k = e
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_nodes: int = SAMPLE_NODES) -> Field:
    """Fit the field on at most ``sample_docs`` documents, chosen by the hash of their ids, and ``sample_nodes`` distinct nodes."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = first_by_hash(src.select("id").where("id IS NOT NULL").distinct(), sample_docs, "id")
    sample = src.join(F.broadcast(chosen), "id", "left_semi").select("text")

    def run(batches):  # (kind of edge or -1 for a node, features, label, label of the edge's other end, count)
        import pyarrow as pa
        schema = pa.schema([("kind", pa.int32()), ("feats", pa.list_(pa.string())), ("y", pa.int32()), ("z", pa.int32()), ("n", pa.int64())])
        count: Counter = Counter()

        def rows():
            out = batch(schema, *map(list, zip(*[(*k, n) for k, n in count.items()]))) if count else batch(schema, [], [], [], [], [])
            count.clear()
            return out

        for b in batches:
            for x in b.column(0).to_pylist():
                nodes = nodes_of(x, pattern_spans(x), doubtful_spans(x)) if x else []
                count.update((-1, tuple(n[4]), n[2], 0) for n in nodes if n[2] >= 0)
                count.update((kind, (), nodes[i][2], nodes[j][2]) for i, j, kind in edges_of(nodes, 0) if min(nodes[i][2], nodes[j][2]) >= 0)
                if len(count) >= MOST_COUNTED:
                    yield rows()
        yield rows()

    counts = stored(map_batches(sample, run, "kind int, feats array<string>, y int, z int, n long")
                    .groupBy("kind", "feats", "y", "z").agg(F.sum("n").alias("n")), "field-counts")
    nodes = first_by_hash(counts.where("kind < 0"), sample_nodes, "feats", "y").select("feats", "y", "n").collect()
    edges = np.zeros((3, len(LABELS), len(LABELS)))
    for r in counts.where("kind >= 0").collect():
        edges[r["kind"], r["y"], r["z"]] = r["n"]
    return _train([(r["feats"], r["y"], r["n"]) for r in nodes], edges)


def _train(nodes, edges: np.ndarray, least: int = 3, steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """The field of (features, label, count) ``nodes`` and edge counts (kind, label, label)."""
    size = len(LABELS)
    if not any(y for _, y, _ in nodes):
        return Field({}, np.zeros((0, size)), np.zeros((3, size, size)))
    seen: Counter = Counter()
    for feats, _, n in nodes:
        for f in feats:
            seen[f] += n
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    lines = [[index[f] for f in feats if f in index] for feats, _, _ in nodes]
    node = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    feat = np.array([k for x in lines for k in x], int)
    labels, share = np.array([y for _, y, _ in nodes]), np.array([n for *_, n in nodes], float)
    total = share.sum()
    w, speed = np.zeros((len(index), size)), np.full((len(index), size), 1e-8)
    truth = np.eye(size)[labels]
    for _ in range(steps):  # AdaGrad on the whole sample
        score = np.stack([np.bincount(node, w[feat, c], len(lines)) for c in range(size)], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - truth) * (share / total)[:, None]
        grad = np.stack([np.bincount(feat, off[node, c], len(index)) for c in range(size)], 1) + ridge * w
        speed += grad * grad
        w -= rate * grad / np.sqrt(speed)
    return Field(index, w, _edge_potentials(edges, np.bincount(labels, share, size)))


def _edge_potentials(edges: np.ndarray, labels: np.ndarray, prior: float = 50.0) -> np.ndarray:
    """Log ratios of an edge's label pairs to independent labels, smoothed by ``prior`` pairs:
    independent ones for chain edges; for skip edges a share of ``ALIKE`` has equal labels for sure."""
    p = (labels + 1.0) / (labels + 1.0).sum()
    free = np.outer(p, p)
    count = prior * np.array([free, free, ALIKE * np.diag(p) + (1 - ALIKE) * free]) + edges
    limit = np.array(LIMITS)[:, None, None]
    return np.clip(np.log(count / count.sum((1, 2), keepdims=True) / free), -limit, limit)


def plausible(kind: str, text: str) -> bool:
    """Whether a span has what any entity of its kind has."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "ip":
        return bool(IP.fullmatch(text)) and all(int(p) <= 255 for p in text.split(".") if len(p) <= 9)
    return {"email": "@" in text, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}.get(kind, False)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: the rules' spans and the field's."""
    def make():
        def spans_of(text: str):
            base = pattern_spans(text)
            return base + (field.extra_spans([text], [base])[0] if NODE.search(text) else [])
        return spans_of

    return scan_spans(docs, id_col, text_col, make)


def report(docs: DataFrame) -> DataFrame:
    return span_digest(find(docs, fit(docs)), KINDS)


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; other
    columns stay, but ``n_chars``, where there is one, counts the new text."""
    field = fit(docs) if field is None else field
    src = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = src.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = []
            for x in b.column(at).to_pylist():
                if x:
                    base = pattern_spans(x)
                    spans = base + (field.extra_spans([x], [base])[0] if NODE.search(x) else [])
                    out, last = [], 0
                    for kind, s, e, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if s >= last:
                            out += [x[last:s], f"<{kind.upper()}>"]
                        last = max(last, e)
                    x = "".join([*out, x[last:]]) if spans else x
                texts.append(x)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    done = map_batches(src, run, src.schema)
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
