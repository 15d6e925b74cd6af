"""Plan checks: pruning and pushdown reach the scan; row-scale stages are
hash-partitioned (no single-partition exchange)."""

from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_query_prunes_text_and_pushes_filter(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["lang_filter"](spark, SF01))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in p or "EqualTo(lang,en)" in p
    assert "text:string" not in p  # the text column is never read


def test_split_has_no_single_partition_exchange(spark):
    from lexiflow.operators import splits as S
    from lexiflow.sources import tables as T
    df = S.split_70_10_20(T.labelled(spark, SF01).select("id", "lang", "label"), ["lang"], 42)
    p = _plan(df)
    assert "SinglePartition" not in p
    assert "hashpartitioning(lang" in p


def test_term_counting_reuses_document_partitioning(spark):
    from lexiflow.operators import features as FE
    from lexiflow.sources import tables as T
    terms = FE.doc_terms(T.labelled(spark, SF01).select("id", "text"), [], 2)
    p = _plan(terms)
    # one exchange by document id; the per-document count adds none
    assert p.count("Exchange hashpartitioning(id") == 1
    assert "Exchange hashpartitioning(id#" in p and "hashpartitioning(id#" in p


def test_no_python_udf_in_nb_plan(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["nb_predict"](spark, SF01))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
