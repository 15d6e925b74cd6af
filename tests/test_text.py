"""Inline fixtures for text functions (FIXTURES §3) and TXT-* expressions."""

from pyspark.sql import functions as F

from lexiflow.functions import text as TX
from lexiflow.operators.lexicon import keep_lexicon_words


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "text string").select(expr.alias("x")).first()["x"]


def test_strip_mentions(spark):
    assert one(spark, TX.strip_mentions("text"), "@user good  day @x e@f") == "good day e@f"
    assert one(spark, TX.strip_mentions("text"), "@a @b") == ""


def test_unicode_spaces_match_python_split(spark):
    s = "a b　c d\x1ce\x0bf \tg\n"
    assert one(spark, TX.ws_tokens("text"), s) == s.split()
    assert len(one(spark, TX.ws_tokens("text"), "a b　c")) == 3


def test_word_tokens_rules(spark):
    # combining marks are not word characters: precomposed o-dot-below + combining grave
    assert one(spark, TX.word_tokens("text"), "\u1ecd\u0300r\u1ecd\u0300") == ["r\u1ecd"]
    # fully decomposed: o + dot below + grave
    assert one(spark, TX.word_tokens("text"), "o\u0323\u0300ro\u0323\u0300") == ["ro"]
    assert one(spark, TX.word_tokens("text"), "ሰላም ነው") == ["ሰላም", "ነው"]
    assert one(spark, TX.word_tokens("text"), "a bc") == ["bc"]
    assert one(spark, TX.word_tokens("text"), "Hello, WORLD_1!") == ["hello", "world_1"]


def test_ngrams_order(spark):
    got = one(spark, F.transform(TX.ngram_structs(TX.word_tokens("text"), 3), lambda s: s["term"]), "aa bb cc")
    assert got == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert one(spark, TX.ngrams(TX.word_tokens("text"), 3), "aa bb") == []


def test_pad_truncate_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "ids array<int>")
    r = df.select(TX.pad_to("ids", 7).alias("p"), TX.truncate_pad("ids", 3).alias("t"),
                  TX.truncate_keep_last("ids", 3).alias("k"), TX.attention_mask(F.lit(2), 4).alias("m")).first()
    assert r["p"] == [1, 2, 3, 4, 5, 0, 0]
    assert r["t"] == [1, 2, 3]
    assert r["k"] == [1, 2, 5]
    assert r["m"] == [1, 1, 0, 0]


def test_label_maps(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("other",)], "label string")
    got = [(r[0], r[1]) for r in df.select(TX.label_to_id("label"), TX.id_to_label(TX.label_to_id("label"))).collect()]
    assert got == [(0, "positive"), (2, "negative"), (None, None)]
    assert spark.range(1).select(TX.id_to_label(F.lit(-1))).first()[0] is None


def test_template(spark):
    assert one(spark, TX.template("text", F.lit("")), "hi") == \
        "Tweet: hi\nIs the above tweet positive, neutral, or negative?: "


def test_lexicon_keeps_order_duplicates_case(spark):
    docs = spark.createDataFrame([(1, "bad Good good bad"), (2, "so so")], "id long, text string")
    lex = spark.createDataFrame([("good",), ("bad",)], "word string")
    got = {r["id"]: r["text"] for r in keep_lexicon_words(docs, lex).collect()}
    assert got == {1: "bad good bad"}
    kept = {r["id"]: r["text"] for r in keep_lexicon_words(docs, lex, keep_empty=True).collect()}
    assert kept == {1: "bad good bad", 2: ""}
