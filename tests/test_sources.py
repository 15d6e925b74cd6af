"""File sources and sinks: round trips, null tokens, discovery, lexicon dirs."""

import os
import tempfile

from pyspark.sql import functions as F

from lexiflow.sources import files as FI
from lexiflow.sources import sinks as SK


def _tmp():
    return tempfile.mkdtemp(prefix="lexiflow-test-")


def test_tsv_round_trip_quotes_tabs_newlines(spark):
    rows = [("say \"hi\"\tthere\nnext line", "positive"), ("plain", "neutral")]
    df = spark.createDataFrame(rows, "text string, label string")
    out = os.path.join(_tmp(), "t")
    SK.write_tsv(df, out)
    back = FI.read_split_tsv(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_raw_tsv_header_names_and_null_tokens(spark):
    d = _tmp()
    p = os.path.join(d, "ha_train.tsv")
    with open(p, "w") as f:
        f.write("tweet_id\ttweet\tsentiment\n1\tgood\tpositive\n2\tNA\tneutral\n3\tnull\tnegative\n")
    df = FI.read_raw_tsv(spark, p)
    assert df.columns == ["ID", "text", "label"]
    assert df.na.drop("any").count() == 1
    assert FI.read_raw_tsv(spark, p, pandas_nulls=False).na.drop("any").count() == 3


def test_discover_language_from_file_name(spark):
    d = _tmp()
    for lang in ("ha", "yo"):
        with open(os.path.join(d, f"{lang}_train.tsv"), "w") as f:
            f.write("a\tb\tc\n1\ttext\tpositive\n")
    with open(os.path.join(d, "README.txt"), "w") as f:
        f.write("ignore me")
    df = FI.discover_raw(spark, d)
    assert sorted(r["lang"] for r in df.collect()) == ["ha", "yo"]


def test_lexicon_dir_first_column(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "yo"))
    with open(os.path.join(d, "yo", "pos.csv"), "w") as f:
        f.write("word,score\nire,1\ndara,1\n")
    with open(os.path.join(d, "yo", "neg.csv"), "w") as f:
        f.write("w,s\nburu,1\nire,1\n")
    with open(os.path.join(d, "yo", "README.txt"), "w") as f:
        f.write("x,y\nnot,a word\n")
    lex = FI.read_lexicon_dir(spark, d, ["yo"])
    assert sorted(r["word"] for r in lex.collect()) == ["buru", "dara", "ire"]


def test_write_read_splits_partition_pruning(spark):
    df = spark.createDataFrame([("a", "positive", "ha", "train"), ("b", "neutral", "yo", "test")],
                               "text string, label string, lang string, split string")
    out = os.path.join(_tmp(), "splits")
    SK.write_splits(df, out)
    got = FI.read_splits(spark, out, lang="ha", split="train")
    assert [r["text"] for r in got.collect()] == ["a"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(lang" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_hot_split_is_written_by_many_tasks(spark):
    import glob
    df = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("positive").alias("label"),
                                    F.lit("ha").alias("lang"), F.lit("train").alias("split")).repartition(8)
    out, key = os.path.join(_tmp(), "hot"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "1m")
    try:
        SK.write_splits(df, out)
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{out}/lang=ha/split=train/part-*")) > 1
    assert spark.read.parquet(out).count() == 60_000


def test_csv_columns_by_name(spark):
    import pytest
    d = _tmp()
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write('tag,extra,en_translated,labels,text\nha,9,"hi, there",positive,"a ""b""\nc"\n')
    got = [tuple(r) for r in FI.read_combined_csv(spark, d).collect()]
    assert got == [('a "b"\nc', "positive", "ha", "hi, there")]
    with open(os.path.join(d, "w.txt"), "w") as f:
        f.write("yo,sw,note,text,ha,ig,am,labels,tag\nY,S,n,T,H,I,A,neutral,en\n")
    wide = FI.read_wide_csv(spark, os.path.join(d, "w.txt"))
    assert wide.columns == ["text", "label", "lang", "am", "ig", "ha", "sw", "yo"]
    assert FI.translate_to(wide, "sw").first()["text"] == "S"
    with pytest.raises(ValueError, match="pt"):
        FI.translate_to(wide, "pt")
    with pytest.raises(ValueError, match="en_translated"):
        FI.read_combined_csv(spark, os.path.join(d, "w.txt"))


def test_corpus_partitions(spark):
    out = os.path.join(_tmp(), "corpus")
    rows = [("a", "ha", "2020", 1), ("b", "ha", "2021", 2), ("c", "yo", "2021", 3)]
    spark.createDataFrame(rows, "text string, lang string, date string, x int").write.partitionBy("lang", "date").parquet(out)
    assert sorted(r[0] for r in FI.read_corpus(spark, out, "ha").collect()) == ["a", "b"]
    one = FI.read_corpus(spark, out, "ha", "2021")
    assert one.columns == ["text"] and [r[0] for r in one.collect()] == ["b"]


def test_predictions_and_metrics_sinks(spark):
    d = _tmp()
    pred = spark.createDataFrame([(1, "ha", "positive")], "id long, lang string, predicted_label string")
    SK.write_predictions(pred, os.path.join(d, "p"), "bigram", 20, 42)
    back = spark.read.parquet(os.path.join(d, "p"))
    assert set(back.columns) >= {"scorer", "shots", "seed", "lang"}
    m = spark.createDataFrame([(0, 0.5)], "epoch int, f1 double")
    for run in ("a", "b", "a", "a"):  # a run again leaves the same rows
        SK.append_metrics(m, os.path.join(d, "m"), run)
    assert sorted(r["run"] for r in spark.read.parquet(os.path.join(d, "m")).collect()) == ["a", "b"]
    rep = SK.score_report(spark.createDataFrame([(0.123456,)], "x double")).first()[0]
    assert rep == 0.123


def test_option_checks():
    import pytest
    with pytest.raises(ValueError):
        FI.validate_langs(["xx"])
    with pytest.raises(ValueError):
        FI.validate_translatable("pt")
    with pytest.raises(ValueError):
        FI.validate_method("nope")
    with pytest.raises(ValueError):
        FI.validate_source_target("ha", "ha")
    FI.validate_langs(["ha", "all"])


def test_udf_scorer_surface(spark):
    import pandas as pd
    from lexiflow.operators import fewshot as FS

    @F.pandas_udf("double")
    def length_scorer(prompt: pd.Series, completion: pd.Series) -> pd.Series:
        return completion.str.len().astype(float) - prompt.str.len().astype(float)

    rows = spark.createDataFrame([(1, "x", "hello")], "id long, lang string, text string")
    ctx = spark.createDataFrame([("x", "C\n")], "lang string, context string")
    sc = FS.udf_scores(FS.prompts(rows, ctx, ["lang"]), length_scorer, ["lang", "id"])
    got = {r["candidate"]: r["score"] for r in sc.collect()}
    assert got == {"positive": 8.0, "neutral": 7.0, "negative": 8.0}
