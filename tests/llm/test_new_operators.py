"""Operators 11 to 13 by brute force and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SF001
from tools.check_oracle import _rows, duck

from lexiflow.llm import lexical_search, token_alignment, toxicity

from .cases import ROWS, docs


def tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- 12: alignment ------------------------------------------------------------------------

def test_pieces_of_any_size_give_the_common_ends():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in "ab")
        want = [(a.index(x) + 1, b.index(x) + 1) for x in sorted({*a} & {*b})]
        for piece in (1, 2, 3, 7, 100):
            x, y = token_alignment.align(np.array(a), np.array(b), piece)
            assert list(zip(x.tolist(), y.tolist())) == want


def test_merge_path_deals_out_equal_work():
    a, b = np.arange(1, 1001), np.arange(100, 1001, 100)
    d = np.arange(0, 1011, 101)
    ia = token_alignment.merge_path(a, b, d)
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    assert ia.tolist() == [sum(side == 0 for _, side in merged[:k]) for k in d]


def test_ids_are_those_of_the_vocabulary_file():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers()[0])
    t.encode_special_tokens = True
    both, rng = token_alignment.Pair(*tokenizers()), random.Random(4)
    letters = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0xFFFF, 7), *range(0x1F300, 0x1F700)]] + list(" 'stmdlrve019\t\n") * 3000
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)] + ["x" * 50_000, " " * 9000 + "y", "<|endoftext|>", "I'LL i'll"]
    assert [both.a.encode_ordinary(" " + x) for x in texts] == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]


def plain_report(rows):
    both = token_alignment.Pair(*tokenizers())
    parts = []
    for i, text in rows:
        a, b = both.tokens([text])[0]
        ends = [np.cumsum([len(t[k]) for k in ids]).tolist() for t, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        groups, last = [], 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            groups.append([[k for k, e in zip(ids, es) if last < e <= cut] for ids, es in zip((a, b), ends)])
            last = cut
        parts.append((i, len(a), len(b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    held = Counter(p for *_, links in parts for p in links)
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for i, n_a, n_b, groups, links in parts:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if n_a else "")


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_alignment_by_brute_force(spark, head):
    odd = [(900, "<|endoftext|> <s> <0x41> 你好"), (901, "a  b\tc\n"), (902, "ab" * 3000), (903, "▁x"), (904, None), (905, ""), (905, " lead")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()] + odd
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.report(df, *tokenizers(), head=head, piece=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain_report(rows))


def test_groups_hold_the_text(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").limit(20)
    both = token_alignment.Pair(*tokenizers())
    texts = {r["doc_id"]: "" for r in rows.collect()}
    found = token_alignment.aligned_groups(rows, *tokenizers()).orderBy("id", "group").collect()
    for r in found:
        a, b = (b"".join(t[k] for k in ids) for t, ids in ((both.a_bytes, r["a_ids"]), (both.b_bytes, r["b_ids"])))
        assert a == b and len(a) == r["end"] - r["start"]
    for i in {r["id"] for r in found}:
        texts[i] = b"".join(both.a_bytes[k] for r in found if r["id"] == i for k in r["a_ids"]).decode()
    assert all(texts[r["doc_id"]] in ("", " " + (r["text"] or "")) for r in rows.collect())


# --- 13: search ---------------------------------------------------------------------------

def plain_search(texts, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w)) for i, t in texts if (w := words(t))]
    n, size, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    for item, t in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // size
            s = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[w] + 1)))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(t) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        yield from ((item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k]))


def test_search_by_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(60)], k=n))
    texts = [(i, text(rng.randint(0, 40))) for i in range(500)] + [(7, "w3 W3 ÉW3"), (None, "w0 w1"), (None, None)] + [(600 + i, "w59 w1 w0") for i in range(30)]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(25, "w59"), (None, "w0 w0 W1"), (26, None), (27, "nowhere")]
    d, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 5, 20):
        got = sorted(map(tuple, lexical_search.ranked(d, q, k).collect()), key=str)
        assert got == sorted(plain_search(texts, items, k), key=str)


def test_shut_items_keep_the_result(spark):
    """A rare term decides the result of this item, so its accumulators are no longer created when the common term's turn comes."""
    texts = [(i, "rare rare common") for i in range(3)] + [(i, f"common filler{i}") for i in range(3, 2000)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(1, "rare rare rare common")], "item_id long, text string")
    items = lexical_search.document_terms(q, "item_id", "text")
    from lexiflow.llm.common import stored
    from pyspark.sql import functions as F
    items = stored(items, "items")
    terms = stored(items.select(F.explode("terms").alias("term")).select(F.monotonically_increasing_id().alias("tid"), "term"), "terms")
    index = lexical_search.postings(d, terms)
    n = (2000, sum(len(t.split()) for _, t in texts))
    acc = lexical_search.scored(index, lexical_search.weights(items, terms, index, *n), *n, 2)
    assert acc.count() == 3  # of 2,000 documents with the common term
    assert sorted(map(tuple, lexical_search.ranked(d, q, 2).collect())) == sorted(plain_search(texts, [(1, "rare rare rare common")], 2))


def test_search_rows(spark):
    q = spark.createDataFrame([(1, "alpha1 tail"), (2, ""), (None, "short")], "item_id long, text string")
    got = lexical_search.ranked(docs(spark), q).collect()
    assert [(r["item_id"], r["doc_id"]) for r in got if r["rank"] == 1] in ([(1, 6), (None, None)], [(None, None), (1, 6)])
    assert sorted(r["doc_id"] for r in got if r["item_id"] == 1) == [1, 2, 2, 6]
    assert lexical_search.ranked(docs(spark, []), q).collect() == [] and lexical_search.ranked(docs(spark), q.limit(0)).collect() == []


# --- 11: toxicity -------------------------------------------------------------------------

def plain_grams(text):
    t = f" {' '.join(text.lower().split())} " if text.strip() else ""
    return {t[i:i + n] for n in toxicity.NGRAMS for i in range(len(t) - n + 1)}


def test_grams_and_counts_by_brute_force(spark):
    rows = [("You FOOL  now", 1), ("you are kind", 0), ("a fool", 1), ("", 0), ("é" * 5000 + " x", 0), ("aaaa aaaa", 1)]
    place = np.empty(1 << 20, np.int32)
    assert [len(toxicity.gram_ids(t, place)) for t, _ in rows] == [len(plain_grams(t)) for t, _ in rows]  # no clash among these
    counts = {r["gram"]: (r["ones"], r["zeros"]) for r in toxicity.gram_counts(spark.createDataFrame(rows, "text string, label int")).collect()}
    assert counts.pop(-1) == (3, 3)
    want = Counter((g, y) for t, y in rows for g in plain_grams(t))
    assert Counter(counts.values()) == Counter((want[g, 1], want[g, 0]) for g in {g for g, _ in want})


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i * 7919 % 997}" for i in range(900))
    place = np.empty(1 << 20, np.int32)
    whole = set(toxicity.gram_ids(text, place).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    parts = toxicity.gram_ids(text, place).tolist()
    assert set(parts) == whole and len(parts) == len(whole)


def test_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    bad = ["zounds", "knave"]
    rows = [(i, " ".join([word() for _ in range(12)] + ([rng.choice(bad)] * 2 if i % 4 == 0 else []))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(600)]
    make = lambda x: toxicity.report(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()
    out = make(labels)
    test = [r for r in out if r["held_out"]]
    assert len(test) > 80 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in test]) > 0.95
    held = {r["doc_id"] for r in test}
    other = make([(i, 1 - y if i in held else y) for i, y in labels])
    assert {r["doc_id"]: round(r["score"], 6) for r in out} == {r["doc_id"]: round(r["score"], 6) for r in other}


def test_toxicity_of_one_label_or_none(spark):
    for y, want in ((1, 1), (0, 0), (None, 0)):
        labels = spark.createDataFrame([(i, y) for i in range(8)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.report(docs(spark), labels).collect()} == {want}


# --- awkward rows -------------------------------------------------------------------------

PER_ROW = {"toxicity": lambda s, d: toxicity.report(d, s.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (9, None), (6, 0)], "doc_id long, toxic int")),
           "alignment": lambda s, d: token_alignment.report(d, *tokenizers())}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, name):
    rows = PER_ROW[name](spark, docs(spark)).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in rows if r["doc_id"] == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert PER_ROW[name](spark, docs(spark, [])).collect() == []


def test_search_matches_sql_on_repeated_rows(spark):
    d = docs(spark)
    q = spark.createDataFrame([(1, "alpha1 tail beta1 gamma"), (1, "alpha1 tail beta1 gamma"), (2, "word1 word2 x")], "item_id long, text string")
    con = duck(SF001)
    import pandas as pd
    con.register("dd", pd.DataFrame([(r[0], r[1]) for r in ROWS], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("bb", q.toPandas())
    sql = lexical_search.SQL.replace("FROM documents", "FROM dd").replace("FROM benchmark", "FROM bb")
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    df = lexical_search.ranked(d, q)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())
