"""Every operator on the awkward rows, and on empty tables."""

import pytest

from lexiflow.llm import (bpe_tokens, decontaminate, hmm_lm, pii_crf, quality_rules, secret_scan, simhash, suffix_dedup, url_filter, warc_zip)
from lexiflow.llm.queries import tokenizer

from .cases import CLASHES, ROWS, docs

BENCH = [(1, " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(10))), (2, None), (None, "alpha1"), (3, "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


PER_ROW = {
    "hmm": lambda s, d: hmm_lm.score(d, rounds=1, states=2), "quality": lambda s, d: quality_rules.report(d),
    "bpe": lambda s, d: bpe_tokens.digests(d, *tokenizer()), "simhash": lambda s, d: simhash.report(d), "pii": lambda s, d: pii_crf.report(d),
    "secrets": lambda s, d: secret_scan.report(d), "decontaminate": lambda s, d: decontaminate.report(d, bench(s)),
    "warc": lambda s, d: warc_zip.round_trip(d, "doc_id", "text", "lang"), "url": lambda s, d: url_filter.judge(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, name):
    rows = PER_ROW[name](spark, docs(spark)).collect()
    assert sorted(map(str, (r[0] for r in rows))) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in rows if r[0] == 2]
    assert len(twice) == 2 and repr(twice[0]) == repr(twice[1])


@pytest.mark.parametrize("name", [*PER_ROW, "suffix"])
def test_empty_table(spark, name):
    run = {**PER_ROW, "suffix": lambda s, d: suffix_dedup.report(d)}[name]
    assert run(spark, docs(spark, [])).collect() == []


def test_suffix_rows(spark):
    found = {r["doc_id"] for r in suffix_dedup.report(docs(spark)).collect()}
    assert found == {1, 2, 5, 6}  # 5 repeats itself every 4001 words


def test_filters_keep_the_columns(spark):
    d = docs(spark)
    for out in (quality_rules.filter_documents(d), simhash.distinct_documents(d), decontaminate.clean_documents(d, bench(spark)), pii_crf.redact(d)):
        assert out.columns == d.columns
        for r in out.collect():  # the clashing columns keep their values
            assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))


def test_near_copies_leave_one(spark):
    ids = [r["doc_id"] for r in simhash.distinct_documents(docs(spark)).collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2  # nulls can't be named as copies


def test_missing_benchmark(spark):
    rows = decontaminate.report(docs(spark), bench(spark).limit(0)).collect()
    assert len(rows) == len(ROWS) and not any(r["contaminated"] for r in rows)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows and clashing columns through all stages, and empty tables."""
    import corpus_pipeline

    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        d = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path))
        got = [r["doc_id"] for r in d.collect()]
        assert len(got) == len(set(got)) and set(got) <= {r[0] for r in rows}
    assert corpus_pipeline.STAGES[-1][0] == "tokens"
