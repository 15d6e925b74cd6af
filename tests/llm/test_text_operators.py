import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import decontaminate, hmm_lm, pii_crf, quality_rules, secret_scan, simhash, suffix_dedup, url_filter

from .cases import docs


# --- quality ------------------------------------------------------------------

def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit))


def test_text_stats():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é#|\n \t\x1c\u00a0") for _ in range(rng.randrange(60)))
        assert quality_rules.text_stats(text) == plain_stats(text)


def test_adaptive_fence_follows_the_group(spark):
    def rows(lang, extra, n):
        return [(i, " ".join(f"w{i}x{j}{extra if j % 4 == 0 else ''}" for j in range(80)), lang, "s", 0) for i in range(n)]
    junk = (10_000, " ".join(f"q{j}###" for j in range(80)), "en", "s", 0)
    table = docs(spark, rows("en", "", 220) + [junk] + [(20_000 + r[0], *r[1:]) for r in rows("md", "|||||||||", 220)], clashes=False)
    kept = {r["doc_id"] for r in quality_rules.report(table).where("kept").collect()}
    assert 10_000 not in kept and len(kept) == 440  # symbols are usual in one group, junk in the other


def test_fences_with_quartiles_at_zero(spark):
    """Junk with few symbols goes where symbols are rare and stays where one document in ten has as many."""
    def row(i, lang, n_symbols):
        return (i, " ".join(f"w{j}x{i % 90 + 10}{'|' if j < n_symbols else ''}" for j in range(80)), lang, "s", 0)
    rows = [row(i, "en", 0) for i in range(400)] + [row(1000 + i, "md", 50 if i % 10 == 0 else 0) for i in range(400)]
    rows += [row(9000 + i, lang, 60) for i, lang in enumerate(["en", "en", "md", "md"])]
    kept = {r["doc_id"] for r in quality_rules.report(docs(spark, rows, clashes=False)).where("kept").collect()}
    assert {r[0] for r in rows} - kept == {9000, 9001}


def test_fences_merge_the_sketches_of_language_and_corpus(spark):
    sketch = spark.createDataFrame([(g, s, "symbol_rate", b, n) for g, s, b, n in
                                    [("a", "x", 0, 2), ("a", "y", 0, 90), ("a", "y", 100, 10), (None, "z", 0, 5000), (None, "z", 40, 5)]],
                                   "lang string, source string, metric string, bin long, n long")
    got = {(r["lang"], r["source"], r["bin"]): r["weight"] for r in quality_rules.merged(sketch, "lang", "source").collect()}
    assert got["a", "x", 100] == 1000000 * 10 // 102 + 100000 * 10 // 5107
    assert got["a", "y", 0] == 90000 + 1000000 * 92 // 102 + 100000 * 5092 // 5107
    assert got[None, "z", 40] == 5000 + 1000000 * 5 // 5005 + 100000 * 5 // 5107 and len(got) == 9
    hi = {(r["_g_lang"], r["_g_source"]): r["_hi"]["symbol_rate"] for r in quality_rules.thresholds(sketch).collect()}
    assert hi == {("a", "x"): 200, ("a", "y"): 200, (None, "z"): 50}


# --- language model -----------------------------------------------------------

def test_forward_recursion_is_exact():
    rng = np.random.default_rng(2)
    m = hmm_lm.Model.first(np.full(5, 0.2), 3, 4)
    texts = [rng.integers(0, 5, n) for n in (1, 7, 3, 0, 40)]
    want = []
    for x in texts:
        a = m.start * m.emit[x[0]] if len(x) else m.start
        for k in x[1:]:
            a = (a @ m.step) * m.emit[k]
        want.append(math.log10(a.sum()))
    assert np.allclose(m.log10_likelihood(texts), want)


def test_expected_counts_match_enumeration():
    m = hmm_lm.Model.first(np.array([0.5, 0.3, 0.2]), 2, 4)
    x = [0, 2, 1, 0]
    start, step, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = m.start[path[0]] * m.emit[x[0], path[0]]
        for t in range(1, 4):
            p *= m.step[path[t - 1], path[t]] * m.emit[x[t], path[t]]
        total += p
        start[path[0]] += p
        for t in range(4):
            emit[x[t], path[t]] += p
            if t:
                step[path[t - 1], path[t]] += p
    obs = np.array([[k, 3] if t else [k, 1] for t, k in enumerate(x)])[:, :1]
    got = m.expected(np.hstack([obs, np.array([[1], [3], [3], [3]])]))
    one = m.expected(np.array([[1]]))
    for a, b, c in zip(got, one, (start, step, emit)):
        assert np.allclose(a - b, c / total)


def test_expected_counts_do_not_depend_on_pieces():
    rng = np.random.default_rng(3)
    m = hmm_lm.Model.first(rng.random(20), 3, 5)
    m.step = rng.dirichlet([1, 1, 1], 3)
    texts = [rng.integers(0, 20, n) for n in (0, 1, 5, 16, 17, 3, 64, 1, 200, 33)]
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
    for x in texts:  # forward and backward over each whole text, one token after another
        if not len(x):
            continue
        a = [m.start * m.emit[x[0]]]
        for k in x[1:]:
            a.append(a[-1] @ m.step * m.emit[k])
        b = [np.ones(3)]
        for k in x[:0:-1]:
            b.append(m.step @ (m.emit[k] * b[-1]))
        b.reverse()
        total = a[-1].sum()
        start += a[0] * b[0] / total
        for t, k in enumerate(x):
            emit[k] += a[t] * b[t] / total
            if t:
                step += np.outer(a[t - 1], m.emit[k] * b[t]) * m.step / total
    for whole, piece, wide in ((1000, 7, 512), (10, 4, 3), (1, 1, 2), (16, 16, 1), (2, 13, 512)):
        got = [sum(x) for x in zip(*hmm_lm.expected_counts(m, texts, whole, piece, wide))]
        for g, want in zip(got, (start, step, emit)):
            assert np.allclose(g, want)


def test_scores_with_rare_words_by_join(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "HEAD", 20)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(int(rng.expovariate(0.1))) for _ in range(60)), "en", "s", 0) for i in range(120)]
    df = docs(spark, rows, clashes=False)
    counts = hmm_lm.count_words(df.where(~hmm_lm.is_held_out("doc_id")).select("text"))
    lex, least = hmm_lm.lexicon(counts, own=10, head=20)
    assert least > 1 and len(lex.count) <= 20
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    total, distinct = sum(c.values()), len(c)
    per_bucket = Counter()
    for w, n in c.items():
        if w not in lex.own:
            per_bucket[hmm_lm.bucket(w)] += n + 1
    assert all(lex.bucket_tokens[b] == 1 + per_bucket[b] for b in range(hmm_lm.BUCKETS))
    whole = {r["id"]: r for r in hmm_lm.score(df, states=2, rounds=1).collect()}
    for i, text, *_ in rows:
        words = hmm_lm.tokens(text)
        assert whole[i]["n_known"] == sum(c.get(w, 0) > 0 for w in words) and whole[i]["train_tokens"] == total
        assert math.isclose(whole[i]["base_score"], sum(math.log10((c.get(w, 0) + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)
        assert -1e6 < whole[i]["score"] < 0


def test_end_token_is_counted_when_many_words_are_commoner(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "HEAD", 5)
    rows = [(i, " ".join(f"w{k}" for k in range(12) for _ in range(20 - k)), "en", "s", 0) for i in range(20)]
    df = docs(spark, rows, clashes=False)
    counts = hmm_lm.count_words(df.where(~hmm_lm.is_held_out("doc_id")).select("text"))
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    lex, least = hmm_lm.lexicon(counts, own=4, head=5)
    assert least > c[hmm_lm.END] == lex.count[hmm_lm.END]
    total, distinct = sum(c.values()), len(c)
    for r, (_, text, *_) in zip(sorted(hmm_lm.score(df, states=2, rounds=1).collect(), key=lambda r: r["id"]), rows):
        words = hmm_lm.tokens(text)
        assert r["n_known"] == sum(c.get(w, 0) > 0 for w in words)
        assert math.isclose(r["base_score"], sum(math.log10((c.get(w, 0) + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)


def test_model_beats_counts_on_held_out_text(spark):
    from lexiflow.llm.queries import op3_hmm_lm
    from tests.conftest import SF01

    r = op3_hmm_lm(spark, SF01).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.95 * r[0] > r[0]


# --- near copies --------------------------------------------------------------

def test_links_and_components_by_brute_force(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    want = {(a, b) for a in map(simhash.signed, fps) for b in map(simhash.signed, fps)
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = simhash.links(df)
    assert {tuple(r) for r in got.collect()} == want
    root = {simhash.signed(x): simhash.signed(x) for x in fps}
    for _ in range(50):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {tuple(r) for r in simhash.components(got).collect()} == {(k, v) for k, v in root.items() if any(k in p for p in want)}


@pytest.mark.parametrize("n", [300, 10**6, 10**8])
def test_every_plan_finds_all_links(n):
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 200).astype(np.uint64)
    parts = simhash.plan(sample, n)
    for _ in range(2000):
        flips = {int(b) for b in rng.integers(0, 64, 4)}
        assert any(len(flips & set(bits)) <= t for bits, t in parts)


def test_fingerprint_uses_whole_sequences():
    import xxhash

    assert simhash.fingerprint("A  b\tC") == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash.fingerprint(" \n") == 0


def test_repeated_ids_with_different_texts(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (5, text(2)), (3, text(3)), (3, text(4)), (4, text(5)), (4, text(5)), (None, text(6)), (None, text(6))]
    got = simhash.distinct_documents(docs(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    # (2, text 1) is a copy of 1; (2, text 2) is the first of its own group, as both texts of 3 are
    want = [(1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (4, text(5)), (None, text(6)), (None, text(6))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in got.collect())


# --- repeated passages --------------------------------------------------------

def test_repeats_by_brute_force(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [words(rng.randrange(30, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = words(rng.randrange(20, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text))
            text[at:at] = rng.choice(shared)
        rows.append((i, " ".join(text), "en", "s", 0))
    rows.append((60, " ".join(["tick"] * 300), "en", "s", 0))
    size, seen, want = 50, Counter(), set()
    for _, text, *_ in rows:
        w = text.split()
        seen.update(tuple(w[p:p + size]) for p in range(len(w) - size + 1))
    for i, text, *_ in rows:
        w = text.split()
        want |= {(i, q) for p in range(len(w) - size + 1) if seen[tuple(w[p:p + size])] > 1 for q in range(p, p + size)}
    got = suffix_dedup.report(docs(spark, rows)).collect()
    assert {(r["doc_id"], q) for r in got for q in range(r["start_word"], r["end_word"])} == want


def test_repeats_among_many_holders_of_a_gram(spark):
    rng = random.Random(18)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        passage = words(rng.randrange(50, 61))
        for k in range(22):  # two whole copies, and twenty that hold fewer than fifty of its last words
            cut = rng.randrange(len(passage) - 49, len(passage) - 24) if k > 1 else 0
            rows.append((len(rows), " ".join(words(60) + passage[cut:] + words(60)), "en", "s", 0))
    size, seen, want = 50, {}, {}
    for i, text, *_ in rows:
        w = text.split()
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(w[p:p + size]), []).append((i, p))
    for at in seen.values():
        for i, p in at:
            for q in range(p, p + size) if len(at) > 1 else ():
                want.setdefault((i, q), set()).update(j for j, _ in at if j != i)
    got = {(r["doc_id"], q): r["other_doc_id"] for r in suffix_dedup.report(docs(spark, rows)).collect() for q in range(r["start_word"], r["end_word"])}
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)


# --- benchmark passages -------------------------------------------------------

def test_phrase_and_proximity_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, f"start {item.upper()} end", "en", "s", 0), (2, "thirteen one seven nine", "en", "s", 0),
            (3, " ".join(item.split()[:13]), "en", "s", 0), (4, " ".join(item.split()[:12]), "en", "s", 0), (5, "solo x", "en", "s", 0)]
    bench = spark.createDataFrame([(7, item), (8, "Solo!")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs(spark, rows, clashes=False), bench).collect()}
    assert [got[i]["n_hit"] for i in range(1, 6)] == [14, 0, 13, 0, 1]
    assert got[1]["items_sha256"] == hashlib.sha256(b"7").hexdigest() and got[5]["contaminated"]
    near = {i: r["near_items"] for i, r in got.items()}
    assert near[1] == "7" and near[5] == "8" and near[2] == ""


def test_lists_of_all_terms_are_intersected(spark):
    """Texts that hold a window's rarest terms in their places, but not one of its common terms."""
    item = [f"c{i}" for i in range(10)] + ["r1", "r2", "r3"]
    rows = [(0, " ".join(item), "en", "s", 0), (100, " ".join(f"c{i}" for i in range(10)) + " r3 r2 r1", "en", "s", 0)]
    rows += [(1 + i, " ".join(w if j != i else "other" for j, w in enumerate(item)), "en", "s", 0) for i in range(13)]
    rows += [(50 + i, " ".join(["pad"] * i + item[:9] + item), "en", "s", 0) for i in range(3)] + [(0, " ".join(item), "en", "s", 0)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, "r1 r2"), (10, "r2 absent")], "item_id long, text string")
    got = [(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.report(docs(spark, rows, clashes=False), bench).collect()]
    both = {10: 0, 11: 0, 12: 2}  # the texts without c9 and on: r1, r2, r3
    want = [(0, 13, 3)] * 2 + [(100, 0, 0)] + [(50 + i, 13, 3) for i in range(3)]
    want += [(1 + i, n, int(n > 0)) for i in range(13) for n in [both.get(i, 2)]]
    assert sorted(got) == sorted(want)


def test_near_terms_by_brute_force(spark, monkeypatch):
    from lexiflow.llm import queries

    rng = random.Random(19)
    vocabulary = [f"t{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20)))) for i in range(12)]
    rows = [(None if i == 3 else i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))), "en", "s", 0) for i in range(40)]
    count = Counter(w for _, text, *_ in rows for w in text.split())
    want = {}
    for i, text, *_ in rows:
        w, at, items = text.split(), set(), set()
        for item, t in bench:
            t = t.split()
            for s in range(max(1, len(t) - 12)):
                terms = sorted(set(t[s:s + 13]), key=lambda x: (count[x], x))
                if not all(count[x] for x in terms):
                    continue
                places = [p for p in range(len(w)) if w[p] == terms[0] and set(terms[:3]) <= set(w[max(0, p - 12):p + 13])]
                at |= set(places)
                items |= {str(item)} if places else set()
        want[i] = (len(at), ",".join(sorted(items)))
    tables = {"documents": docs(spark, rows, clashes=False), "benchmark": spark.createDataFrame(bench, "item_id long, text string")}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name, *cols: tables[name].select(*cols))
    got = {r["doc_id"]: (r["n_near"], r["near_items"]) for r in queries.QUERIES["near_terms"](spark, "").collect()}
    assert got == want and any(n for n, _ in want.values())


def test_overlapping_windows_count_words_once(spark):
    text = " ".join(["a b"] * 40)
    bench = spark.createDataFrame([(1, " ".join(["a b"] * 7)), (2, "b a")], "item_id long, text string")
    r = decontaminate.report(docs(spark, [(1, text, "en", "s", 0)], clashes=False), bench).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (80, 80, 2)


# --- personal data ------------------------------------------------------------

def test_patterns_by_plain_regex():
    rng = random.Random(9)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice("ab1290.@_-+ ") for _ in range(rng.randrange(50)))
        spans = pii_crf.pattern_spans(text)
        assert [(a, b) for k, a, b, _ in spans if k == "email"] == [m.span() for m in email.finditer(text)]
        assert [(a, b) for k, a, b, _ in spans if k == "ip"] == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]


def test_card_and_phone_by_plain_regex():
    rng = random.Random(10)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def passes(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return 14 <= len(digits) <= 19 and total % 10 == 0

    found = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice("00123456789- +().a") if rng.random() < 0.25 else rng.choice("0123456789") for _ in range(rng.randrange(60)))
        spans = pii_crf.pattern_spans(text)
        cards = [m.span() for m in card.finditer(text) if passes(re.sub("[^0-9]", "", m.group()))]
        phones = [m.span() for m in phone.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [(a, b) for k, a, b, _ in spans if k == "card"] == cards and [(a, b) for k, a, b, _ in spans if k == "phone"] == phones
        found.update(card=len(cards), phone=len(phones))
    assert min(found["card"], found["phone"]) > 100


def test_skip_links_decide(spark):
    """A number is a telephone number where the same digits stand with a prefix elsewhere in the text, else a part number."""
    rng, rows = random.Random(6), []
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    part = lambda: number() if rng.random() < 0.2 else f"{rng.randrange(20, 99)}-{rng.randrange(1000, 9999)}"
    for i in range(300):
        text = f"call +1-{number()} today or write to us about part {part()} now" if i % 2 else f"part {part()} costs 12 and part {part()} 15"
        rows.append((i, text, "en", "s", 0))
    df = docs(spark, rows, clashes=False)
    field = pii_crf.fit(df)
    again = "call +1-415-555-0123 in the morning, order 7 at night, and 415-555-0123 later"
    base = pii_crf.pattern_spans(again)
    at = again.rindex("415-555-0123")
    assert field.extra_spans([again], [base]) == [[("phone", at, at + 12, False)]]
    other = again[:at] + "415-555-9999" + again[at + 12:]
    assert field.extra_spans([other], [pii_crf.pattern_spans(other)]) == [[]]
    without = pii_crf.Field(field.index, field.weights, field.pair * np.array([1, 1, 0])[:, None, None])
    assert without.extra_spans([again], [base]) == [[]]


def test_messages_cross_many_links():
    unary, pair = np.zeros((60, 5)), np.zeros((3, 5, 5))
    unary[0, 3], pair[2] = 30.0, 12 * np.eye(5)
    edges = np.array([(k, k + 1, 2) for k in range(59)])
    assert pii_crf.marginals(unary, edges, pair)[:, 3].min() > 0.99


def test_field_counts_by_plain_python(spark, monkeypatch):
    monkeypatch.setattr(pii_crf, "MOST_COUNTED", 20)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["+14155550123", "14155550123", "a@b.cd", "x1", "word", "1.2.3.4", "4539148803436467"]) for _ in range(20)), "en", "s", 0)
            for i in range(60)]
    seen = []
    monkeypatch.setattr(pii_crf, "_train", lambda nodes, edges: seen.append((nodes, edges)))
    pii_crf.fit(docs(spark, rows, clashes=False))
    nodes, edges = Counter(), np.zeros((3, 5, 5))
    for _, text, *_ in rows:
        found = pii_crf.nodes_of(text, pii_crf.pattern_spans(text), pii_crf.doubtful_spans(text))
        nodes.update((tuple(n[4]), n[2]) for n in found if n[2] >= 0)
        for i, j, kind in pii_crf.edges_of(found, 0):
            if found[i][2] >= 0 and found[j][2] >= 0:
                edges[kind, found[i][2], found[j][2]] += 1
    assert {(tuple(f), y): n for f, y, n in seen[0][0]} == dict(nodes) and (seen[0][1] == edges).all() and edges[2].any()


def test_first_by_hash(spark):
    from lexiflow.llm.common import first_by_hash

    df = spark.range(30_000).withColumn("x", F.col("id").cast("string"))
    want = df.orderBy(F.xxhash64("x"), "x").limit(100).collect()
    out = first_by_hash(df, 100, "x")
    assert out.collect() == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1
    assert first_by_hash(df.limit(5), 100, "x").count() == 5


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii_crf.pattern_spans(text)


def test_field_restores_what_the_rules_drop(spark):
    good = ["4539148803436467", "4716059478258834", "4485275742308327", "4024007136512380"]
    rng, rows = random.Random(2), []
    for i in range(400):
        extra = [rng.choice(good), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", f"{rng.randrange(1, 99)}.{rng.randrange(255)}.3.4", "in 1999", "v2.0"]
        rows.append((i, f"lorem ipsum {rng.choice(extra)} dolor sit {rng.choice(extra)} amet", "en", "s", 0))
    clean = (900, "the year 1999 and part v2.0 cost 12345", "en", "s", 0)
    text = f"paid with {good[0]} 27.65.93.188 today"
    table = docs(spark, [*rows, (901, text, "en", "s", 0), clean], clashes=False)
    out = {r["doc_id"]: r for r in pii_crf.report(table).where("doc_id >= 900").collect()}
    assert out[901]["n_card"] == 0 and f"card:10:{10 + 16}" in out[901]["spans"].split(",")
    assert out[900]["spans"] == ""
    red = {r["doc_id"]: r["text"] for r in pii_crf.redact(table).where("doc_id >= 900").collect()}
    assert good[0] not in red[901] and "<CARD>" in red[901] and red[900] == clean[1]


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(1, 3, 3))
    p = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = math.exp(sum(unary[i, y] for i, y in enumerate(path)) + sum(pair[0, path[i], path[i + 1]] for i in range(3)))
        for i, y in enumerate(path):
            p[i, y] += w
    got = pii_crf.marginals(unary, np.array([(0, 1, 0), (1, 2, 0), (2, 3, 0)]), pair, settled=1e-9)
    assert np.allclose(got, p / p.sum(1, keepdims=True), atol=1e-6)


def test_skip_links_make_repeats_agree():
    pair = np.zeros((3, 5, 5)) - 1.5
    pair[2] += 3 * np.eye(5)
    pair[:2] = 0
    unary = np.zeros((3, 5))
    unary[0, 3], unary[1, 0], unary[2, 0] = 6, 0.3, 0.3
    nodes = [(0, 1, 0, "k" * 6, [], i * 5, "") for i in range(3)]
    edges = pii_crf.edges_of(nodes, 0)
    assert pii_crf.marginals(unary, np.array(edges), pair).argmax(1).tolist() == [3, 3, 3] or (0, 2, 2) not in edges


# --- secrets ------------------------------------------------------------------

def test_secret_patterns():
    text = 'Password: "abcdefghijkl" x AKIA0123456789ABCD api_key=short 0123456789abcdef token : v.a_l-u/e+123='
    got = [(k, text[a:b]) for k, a, b, base in secret_scan.secret_spans(text) if base]
    assert got == [("assign", 'Password: "abcdefghijkl'), ("assign", "token : v.a_l-u/e+123="), ("access", "AKIA0123456789ABCD"), ("hex", "0123456789abcdef")]
    assert secret_scan.secret_spans("pa\u017f\u017fword=abcdefghijklmnop") == []  # only ASCII letters fold


def test_sliding_entropy_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        run = "".join(rng.choice("abAB0123xyzXYZ") for _ in range(rng.randrange(5, 60)))
        need = secret_scan.CLASSES["base64"][2]
        hot = []
        for i in range(len(run) - secret_scan.WINDOW + 1):
            w = run[i:i + secret_scan.WINDOW]
            h = -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
            if h >= 3.0 - 1e-9 and all(sum(c in s for c in w) >= 2 for s in need):
                if hot and i <= hot[-1][1]:
                    hot[-1] = (hot[-1][0], i + len(w))
                else:
                    hot.append((i, i + len(w)))
        assert secret_scan.hot_windows(run, 3.0 - 1e-9, need) == hot


def test_allow_list():
    key = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9"
    assert [s[0] for s in secret_scan.secret_spans(f"key {key} end")] == ["entropy"]
    for harmless in (f"sha256: {key}", f"https://example.org/{key}", "123e4567-E89B-12d3-a456-426614174000", "internationalisationalism", "2024-01-01-2025-02-02-2026"):
        assert secret_scan.entropy_spans(harmless, []) == []


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "+/"])
def test_random_keys_are_found_whole(alphabet):
    rng = random.Random(20)
    if alphabet == "+/":
        alphabet += "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for size, least in ((20, 0.94), (24, 0.96), (40, 0.99), (64, 0.99)):
        keys = ["".join(rng.choices(alphabet, k=size)) for _ in range(500)]
        found = [secret_scan.entropy_spans(f"id {x} end", []) == [("entropy", 3, 3 + size, False)] for x in keys]
        assert sum(found) >= least * len(keys)


def test_a_pattern_inside_a_run_leaves_the_rest():
    key = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9"
    assert secret_scan.secret_spans(f"AKIA0123456789ABCD/{key}") == [("access", 0, 18, True), ("entropy", 18, 19 + len(key), False)]


# --- urls ---------------------------------------------------------------------

def test_rules_and_parts(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net", "http://notexample.net/", "x://fr.example.com/de/1", "http://b.org/fr/", "no scheme", None,
            "http://borg/fr/", "http://net/", "http://x.org?u=/fr/", "a://b://c/d"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.report(table).orderBy("page_id").collect()]
    assert [g[:3] for g in got] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "", None), ("notexample.net", "/", "net/"), ("fr.example.com", "/de/1", "example.com/de/"),
        ("b.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("borg", "/fr/", None), ("net", "/", "net/"), ("x.org", "", None), ("b:", "//c/d", None)]
    assert all(g[3] in ("allow", "block") for g in got) and got[0][3] == "allow" and got[2][3] == "block"


def test_model_learns_from_labels(spark):
    rows = [(f"http://{'cheap-pills' if i % 2 else 'garden'}{i}.example.info/{'buy' if i % 2 else 'read'}/{i}", bool(i % 2)) for i in range(400)]
    labelled = spark.createDataFrame(rows[:300], "url string, blocked boolean")
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = {r["id"]: r["verdict"] for r in url_filter.judge(test, labelled=labelled).collect()}
    assert all((got[i] == "block") == y for i, (_, y) in enumerate(rows[300:]))


