"""File sources (SRC-01..07) and option checks (FLT-07).

Every reader uses an explicit schema (never inference), reads quoted,
multi-line TSV/CSV fields, and optionally maps pandas' default missing-value
tokens to null (they would vanish at the reference's ``dropna``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default missing-value tokens (read_csv na_values).
PANDAS_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                      "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Language codes of the reference corpora and the languages its
# English corpus carries translations for.
LANGUAGES = ["am", "dz", "ha", "ig", "ma", "pcm", "pt", "sw", "yo"]
TRANSLATABLE = ["am", "ig", "ha", "sw", "yo"]
DA_METHODS = ["none", "coral"]  # those that are built

RAW_SCHEMA = T.StructType([T.StructField("ID", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("label", T.StringType())])
SPLIT_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


def _csv(spark: SparkSession, schema: T.StructType | None, sep: str, multi_line: bool = True):
    """Reader options shared by all text files.  Without a schema the columns
    are the header's names, all strings.  ``multi_line`` lets quoted fields
    hold line breaks, which makes a file one task: give large inputs as many
    files or Parquet, or switch it off where no field holds a break."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return (r.option("sep", sep).option("header", True).option("inferSchema", False)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            .option("mode", "PERMISSIVE"))


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, whatever their order and whatever else the header holds."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"the file's header lacks {missing}")
    return df.select(*[F.col(f"`{c}`") for c in names])


def null_tokens(df: DataFrame, cols: list[str], tokens=PANDAS_NULL_TOKENS) -> DataFrame:
    """Map pandas' missing-value tokens to null in ``cols`` (Q8)."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c)))
    return out


def read_raw_tsv(spark: SparkSession, path: str, pandas_nulls: bool = True) -> DataFrame:
    """SRC-01: raw labelled TSV; the header row is discarded and the fixed
    names ``ID, text, label`` apply by position."""
    df = _csv(spark, RAW_SCHEMA, "\t").csv(path)
    return null_tokens(df, ["ID", "text", "label"]) if pandas_nulls else df


def discover_raw(spark: SparkSession, root: str, suffix: str = ".tsv", pandas_nulls: bool = True) -> DataFrame:
    """SRC-03: every ``*<suffix>`` file under ``root``; the language is the
    file name before its first '_'."""
    df = (_csv(spark, RAW_SCHEMA, "\t").option("pathGlobFilter", f"*{suffix}")
          .option("recursiveFileLookup", True).csv(root))
    df = df.withColumn("lang", F.substring_index(F.col("_metadata.file_name"), "_", 1))
    return null_tokens(df, ["ID", "text", "label"]) if pandas_nulls else df


def read_split_tsv(spark: SparkSession, path: str, pandas_nulls: bool = True) -> DataFrame:
    """SRC-02 (one file): ``text, label`` TSV with header."""
    df = _csv(spark, SPLIT_SCHEMA, "\t").csv(path)
    return null_tokens(df, ["text", "label"]) if pandas_nulls else df


def read_splits(spark: SparkSession, root: str, fmt: str = "parquet", lang: str | None = None,
                split: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """SRC-02: the ``lang=*/split=*`` layout written by ``write_splits``;
    language / split predicates prune partitions instead of building paths."""
    if fmt == "parquet":
        df = spark.read.parquet(root)
    else:
        df = (_csv(spark, SPLIT_SCHEMA, "\t").option("basePath", root).csv(f"{root}/lang=*/split=*"))
    if lang is not None and allowed is not None:
        validate_langs([lang], [*allowed, "all"])
    if lang is not None and lang != "all":
        df = df.where(F.col("lang") == lang)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def read_combined_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-04: combined multilingual CSV -> (text, label, lang, text_en)
    (PRJ-01/02: ``labels`` renamed to ``label``, ``tag`` to ``lang``); columns by header name."""
    df = _named(_csv(spark, None, ",", multi_line).csv(path), ["text", "labels", "tag", "en_translated"])
    return df.select("text", F.col("labels").alias("label"), F.col("tag").alias("lang"),
                     F.col("en_translated").alias("text_en"))


def read_wide_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-05: English CSV with one translation column per language; columns by header name."""
    df = _named(_csv(spark, None, ",", multi_line).csv(path), ["text", "labels", "tag", *TRANSLATABLE])
    return df.withColumnRenamed("labels", "label").withColumnRenamed("tag", "lang")


def translate_to(df: DataFrame, lang: str) -> DataFrame:
    """PRJ-03 on the wide form: the text becomes its ``lang`` translation."""
    validate_translatable(lang)
    return df.withColumn("text", F.col(lang))


def read_lexicon_dir(spark: SparkSession, root: str, langs: list[str]) -> DataFrame:
    """SRC-06: per language directory, the first column of every CSV file
    (README files are skipped by the glob), distinct -> (lang, word)."""
    out = None
    for lang in langs:
        df = _csv(spark, None, ",").option("pathGlobFilter", "*.csv").csv(f"{root}/{lang}")
        words = df.select(F.lit(lang).alias("lang"), F.col(df.columns[0]).alias("word"))
        out = words if out is None else out.unionByName(words)
    if out is None:
        raise ValueError("no lexicon languages given")
    return out.where(F.col("word").isNotNull()).distinct()


def read_corpus(spark: SparkSession, path: str, lang: str, date: str | None = None) -> DataFrame:
    """SRC-07: unlabelled corpus table partitioned by (lang[, date]); the
    predicates prune partitions and only ``text`` is kept (COR-01)."""
    df = spark.read.parquet(path).where(F.col("lang") == lang)
    if date is not None:
        df = df.where(F.col("date") == date)
    return df.select("text")


# --- FLT-07 option checks -----------------------------------------------------------
def validate_langs(langs: list[str], allowed=LANGUAGES + ["all"]) -> None:
    bad = [x for x in langs if x not in allowed]
    if bad:
        raise ValueError(f"unknown language code(s): {bad}")


def validate_translatable(lang: str) -> None:
    if lang not in TRANSLATABLE:
        raise ValueError(f"no translation column for {lang!r}; there are {TRANSLATABLE}")


def validate_method(method: str) -> None:
    if method not in DA_METHODS:
        raise ValueError(f"unknown domain-adaptation method {method!r}")


def validate_source_target(source: str, target: str) -> None:
    """Q19: a source equal to the target would leak test rows."""
    if source == target:
        raise ValueError("source language equals the target language")
