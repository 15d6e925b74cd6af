"""A fast subset of the SQL-oracle comparison (the full set: tools/check_oracle.py)."""

import pytest

from tools.check_oracle import _rows, duck

FAST = ["read_project", "strip_mentions", "word_tokens", "split_70_10_20", "oversample", "class_sample",
        "pair_source_target", "label_order", "vocab_topk_1", "nb_metrics", "token_blocks", "bigram_perplexity",
        "fewshot_labels", "coral_distance", "lexicon_keep", "null_group_rank", "vocab_topk_ties", "fewshot_prompts",
        "masked_accuracy", "joint_train"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, name):
    import __spark_entry__ as E
    from tests.conftest import SF01

    sdf = E.queries()[name](spark, SF01)
    res = duck(SF01).execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 14
    assert "weighted_f1" in df.columns
