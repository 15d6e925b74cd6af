"""lexiflow: labelled-text corpus analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers for labelled text tables, lexicons, corpora; writers (sinks)
functions  column expressions: hashing, tokenising, n-grams, padding, templates
operators  DataFrame operators: exact ranks, splits, rebalancing, vocabularies,
           tf-idf, naive Bayes, metrics, model selection, few-shot labelling,
           corpus preparation, transfer and domain-distance jobs, BPE
plans      the named query catalogue and its SQL oracle
"""

from lexiflow.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
