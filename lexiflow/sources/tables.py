"""The supplied parquet tables and the views derived from them.

``labelled``   documents JOIN labels -> (id, lang, source, text, label)
``lexicon``    sentiment-lexicon stand-in derived from ``benchmark``
``translated`` (id, text_en) translation stand-in from ``benchmark``
``domains``    embeddings with a 0/1 domain tag
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.text import word_tokens

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def label_expr(toxic="toxic", quality="quality"):
    return (F.when(F.col(toxic) == 1, "negative")
            .when(F.col(quality) == 1, "positive")
            .otherwise("neutral"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tweets stand-in.  The join is 1:1 on doc_id; Spark plans it
    from sizes (sort-merge at scale, broadcast only when AQE measures a
    small side)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    labs = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (docs.join(labs, "doc_id")
            .select(F.col("doc_id").alias("id"), "lang", "source", "text",
                    label_expr().alias("label")))


def lexicon(spark: SparkSession, sf_dir: str, min_len: int = 5, min_items: int = 2) -> DataFrame:
    """Words (lower-cased TXT-04 tokens, length >= 5) occurring in >= 2
    benchmark items.  One row per word."""
    bench = read_table(spark, sf_dir, "benchmark")
    words = (bench.select("item_id", F.explode(word_tokens("text")).alias("word"))
             .where(F.length("word") >= min_len)
             .distinct())
    return (words.groupBy("word").agg(F.count("*").alias("n_items"))
            .where(F.col("n_items") >= min_items).select("word"))


def translated(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """(id, text_en): benchmark text of item ``id % count(benchmark)``.

    The benchmark size is a scalar subquery, evaluated once; the lookup is an
    equi-join on the computed item id.
    """
    bench = read_table(spark, sf_dir, "benchmark")
    n_items = bench.select(F.count("*")).scalar()
    keyed = ids.withColumn("_item", F.pmod(F.col("id"), n_items))
    return (keyed.join(bench.select(F.col("item_id").alias("_item"), F.col("text").alias("text_en")),
                       "_item")
            .drop("_item"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.withColumn("domain", F.when(F.col("label") < 5, 0).otherwise(1))


# --- SQL (DuckDB) spellings --------------------------------------------------
SQL_LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.lang, d.source, d.text,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_LEXICON = r"""lexicon AS (
  SELECT word FROM (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
    FROM benchmark) w
  WHERE length(word) >= 5
  GROUP BY word HAVING count(*) >= 2)"""

SQL_TRANSLATED = """translated AS (
  SELECT lb.id, b.text AS text_en
  FROM labelled lb JOIN benchmark b ON b.item_id = lb.id % (SELECT count(*) FROM benchmark))"""
