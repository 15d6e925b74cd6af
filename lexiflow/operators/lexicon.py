"""Lexicon filtering (TXT-03 via JN-01).

Tokens are exploded with their positions, semi-joined with the lexicon on
(word) — the lexicon side is small and AQE broadcasts it from its measured
size — and the surviving words are re-assembled per row in position order.
Matching is case-sensitive and keeps duplicates.  Rows with no lexicon word
are dropped (``keep_empty=False``) or kept with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import ws_tokens


def lexicon_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text",
                 key_cols: list[str] = ()) -> DataFrame:
    """JN-01: (key..., id, pos, word) for every token found in the lexicon."""
    toks = df.select(*key_cols, id_col, F.posexplode(ws_tokens(text_col)).alias("pos", "word"))
    return toks.join(lexicon.select(*key_cols, "word"), [*key_cols, "word"], "left_semi")


def keep_lexicon_words(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text",
                       key_cols: list[str] = (), keep_empty: bool = False) -> DataFrame:
    """TXT-03: replace ``text`` by its lexicon words, in order."""
    hits = lexicon_hits(df, lexicon, id_col, text_col, list(key_cols))
    kept = hits.groupBy(*key_cols, id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]),
                     " ").alias(text_col))
    rest = df.drop(text_col)
    if keep_empty:
        return rest.join(kept, [*key_cols, id_col], "left").fillna("", [text_col])
    return rest.join(kept, [*key_cols, id_col])
