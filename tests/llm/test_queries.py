import corpus_pipeline
import pytest
from tests.conftest import SF001, SF01
from tools.check_oracle import _rows, duck

from lexiflow.llm import bpe_tokens, pii_crf, simhash
from lexiflow.llm.queries import ORACLE_SQL, QUERIES, tokenizer


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF01)
    res = duck(SF01).execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())


def test_native_plan(spark):
    plan = QUERIES["op10_decontaminate"](spark, SF001)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline_by_brute_force(spark):
    import tiktoken

    sql, con = ORACLE_SQL, duck(SF001)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op4_quality_rules']}) WHERE kept").fetchall()}
    texts = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    ids = sorted(texts)
    fps = {i: simhash.fingerprint(texts[i]) for i in ids}
    root = {i: i for i in ids}
    for _ in range(5):
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    ids = [i for i in ids if root[i] == i]
    dirty = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op10_decontaminate']}) WHERE contaminated").fetchall()}
    ids = [i for i in ids if i not in dirty]
    stage = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii_crf.redact(stage).collect()}
    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_tokens.load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in clean.items()}


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF001).columns == docs.columns
