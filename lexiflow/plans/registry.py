"""Name -> query callable, and name -> oracle SQL."""

from __future__ import annotations

from lexiflow.plans import catalog as C

NAMES = [
    # sources, projection, filters
    "read_project", "lang_filter", "source_filter", "class_filter", "translate_swap", "domain_tag",
    # text functions
    "strip_mentions", "lexicon_keep", "lexicon_semijoin", "word_tokens", "ngrams_1_3", "token_lengths",
    "pad_truncate", "prompt_rows", "label_ids",
    # shuffles, splits, rebalancing
    "shuffle_rank", "null_group_rank", "first_rows", "split_70_10_20", "split_70_30", "split_80_20", "holdout_ceil30", "head_10pct",
    "oversample", "class_sample", "dedupe_last_label", "pair_source_target",
    # set operations
    "dev_plus_test", "joint_pool", "pooled_corpus",
    # aggregations
    "label_order", "class_share", "corpus_counts",
    # features
    "df_tf", "vocab_topk_1", "vocab_topk_2", "vocab_topk_3", "vocab_topk_ties", "tf_counts", "idf", "tfidf_l2", "feature_grid",
    # naive Bayes, selection, evaluation
    "nb_predict", "nb_repeat_mean", "nb_grid_best", "pooled_grid_best", "lexicon_grid_best", "clf_grid", "clf_grid_best", "best_checkpoint", "constant_baseline", "nb_metrics", "slice_metrics",
    "transfer_matrix",
    # few-shot labelling
    "fewshot_context", "fewshot_scores", "fewshot_labels", "fewshot_prompts", "fewshot_sweep", "answer_span_ll",
    # unlabelled corpus
    "token_blocks", "mlm_mask", "masked_accuracy", "bigram_perplexity",
    # transfer protocols and domain distances
    "in_language", "zero_shot", "joint_train", "translate_train", "translate_test", "leave_one_out",
    "pred_entropy", "coral_distance",
    # pyspark.ml classifiers and embedding-space transfer (rows-only)
    "svm_linear", "svm_rff", "logreg", "forest", "adaboost", "mlp", "metric_history", "domain_gap", "coral_transfer",
    # BPE vocabularies and encoding (rows-only)
    "bpe_word_types", "bpe_alphabet", "bpe_pair_counts", "bpe_roundtrip", "bpe_vocab", "bpe_vocab_bytes", "bpe_encode",
]

QUERIES = {n: getattr(C, n) for n in NAMES}


def oracle() -> dict[str, str]:
    from lexiflow.plans import oracle as O

    sql = O.build()
    sql.update(O.build_more())
    return {n: sql[n] for n in NAMES if n in sql}
