"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(20_000))
PROSE = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(40))
ROWS = [
    (1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (3, None, "en", "a", None), (4, "", None, None, 0),
    (None, "short text", "de", None, 3), (5, LONG, "en", "b", 5), (6, PROSE + " tail", None, "a", 7), (7, " \t\n\x0b\x0c\r ", "fr", "c", 7),
    (8, "é\u00a0ü\u2003x 你好 \U0001f600 \x00 end", "fr", "c", 9), (9, "x" * 100_000, "en", "a", 1), (None, None, None, None, None),
]
#: Names that operators use themselves.
CLASHES = ["id", "row", "fp", "spans", "ids", "decoded", "words", "_quality", "term", "n_words", "pos", "label", "score", "component", "_id", "_th",
           "_hi", "_lo", "_g_lang", "_g_source", "_quality_text", "_kept", "_base_failed", "_text_hash", "text_hash", "row", "q", "tid", "th", "fp"]
CLASHES = list(dict.fromkeys(CLASHES))


def docs(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame(rows, DOCS)
    if clashes:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    return df
