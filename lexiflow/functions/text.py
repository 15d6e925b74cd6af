"""Text and token-array column expressions (all JVM-side, codegen friendly).

Each helper returns a ``Column``; nothing here runs Python per row.  The
matching SQL spellings used by the oracle live next to them (``SQL_*``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Python's str.split() separators: ASCII \t \n \v \f \r, space, \x1c-\x1f,
# U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Written with \x{..} escapes, which Java regex and RE2 both read.
WS_PATTERN = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# Word rule of the n-gram vectoriser: runs of >= 2 letters, digits or '_'
# (combining marks are not word characters).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Word rule that keeps combining marks inside words (option keep_marks=True).
WORD_PATTERN_MARKS = r"[\p{L}\p{M}\p{N}_]{2,}"
# Label domain and ids.
LABELS = ["positive", "neutral", "negative"]
LABEL_IDS = {"positive": 0, "neutral": 1, "negative": 2}
# Few-shot prompt template pieces.
TEMPLATE_PREFIX = "Tweet: "
TEMPLATE_QUESTION = "\nIs the above tweet positive, neutral, or negative?: "
# Padding / masking ids.
PAD_ID = 0
IGNORE_INDEX = -100
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_tokens(text) -> Column:
    """TXT-01: ``str.split()`` — split on any Unicode space, drop empties."""
    return F.filter(F.split(_c(text), WS_PATTERN), lambda t: t != F.lit(""))


def strip_mentions(text) -> Column:
    """TXT-02: drop tokens starting with '@', re-join with single spaces."""
    toks = F.filter(ws_tokens(text), lambda t: ~t.startswith("@"))
    return F.array_join(toks, " ")


def word_tokens(text, keep_marks: bool = False) -> Column:
    """TXT-04: lower-case, then every run of >= 2 word characters."""
    pat = WORD_PATTERN_MARKS if keep_marks else WORD_PATTERN
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pat), 0)


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of ``tokens`` joined by a space (empty if too short)."""
    t = _c(tokens)
    if n == 1:
        return F.coalesce(t, F.array().cast("array<string>"))
    # the array beside itself shifted, so that no position slices the whole array again
    shifted = F.arrays_zip(*[F.slice(t, i + 1, F.size(t) - n + 1).alias(f"w{i}") for i in range(n)])
    grams = F.transform(shifted, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)]))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_structs(tokens, max_n: int, min_n: int = 1) -> Column:
    """TXT-05: min_n..max_n-grams as ``array<struct<n:int, term:string>>`` in
    vectoriser order (all unigrams, then all bigrams, ...)."""
    t = _c(tokens)

    def tagged(g: int) -> Column:
        # one-argument lambda: PySpark reads a second parameter as the index
        return F.transform(ngrams(t, g), lambda s: F.struct(F.lit(g).alias("n"), s.alias("term")))

    parts = [tagged(g) for g in range(min_n, max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pad_to(ids, length: int, pad_id: int = PAD_ID) -> Column:
    """TXT-08: right-pad to ``length``; longer arrays are left as they are."""
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(length) - F.size(a))))


def truncate_pad(ids, length: int, pad_id: int = PAD_ID) -> Column:
    """TXT-09: keep the first ``length`` ids, then pad."""
    return pad_to(F.slice(_c(ids), 1, length), length, pad_id)


def truncate_keep_last(ids, length: int) -> Column:
    """TXT-10: when longer than ``length`` keep the first length-1 ids and the last id."""
    a = _c(ids)
    return F.when(F.size(a) > length,
                  F.concat(F.slice(a, 1, length - 1), F.slice(a, -1, 1))).otherwise(a)


def attention_mask(n_real, length: int) -> Column:
    """TXT-11: 1 for the first ``n_real`` positions of ``length``, else 0."""
    n = _c(n_real)
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= n).cast("int"))


def template(text, label) -> Column:
    """TXT-12/13: prompt line for one example (label may be the empty string)."""
    return F.concat(F.lit(TEMPLATE_PREFIX), _c(text), F.lit(TEMPLATE_QUESTION), _c(label))


def label_to_id(label, strict: bool = False) -> Column:
    """TXT-14 / JN-02: fixed label -> id map; an unknown label gives null, or
    fails the job when ``strict`` (a null label stays null)."""
    m = F.create_map(*[x for k, v in LABEL_IDS.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(m, _c(label))
    if strict:
        unknown = F.concat(F.lit("unknown label: "), _c(label).cast("string"))
        out = F.coalesce(out, F.when(_c(label).isNotNull(), F.raise_error(unknown).cast("int")))
    return out


def id_to_label(label_id) -> Column:
    """TXT-14 inverse map; -1 (unlabelled) and unknown ids give null."""
    m = F.create_map(*[x for k, v in LABEL_IDS.items() for x in (F.lit(v), F.lit(k))])
    return F.element_at(m, _c(label_id))


def hashed_ids(tokens, buckets: int, seed: str = "tok") -> Column:
    """Token ids by the hashing trick (md5 based, identical in SQL); id 0 is
    reserved for padding, so ids are 1..buckets."""
    from lexiflow.functions.hashing import hash_mod

    return F.transform(_c(tokens), lambda t: hash_mod(seed, t, buckets) + 1)


# --- SQL (DuckDB) spellings used by the oracle ------------------------------
def sql_ws_tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS_PATTERN}'), lambda x: x <> '')"


def sql_word_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_PATTERN}')"


def sql_template(text: str, label: str) -> str:
    q = TEMPLATE_QUESTION.replace("\n", "' || chr(10) || '")
    return f"('{TEMPLATE_PREFIX}' || {text} || '{q}' || {label})"


def sql_label_to_id(label: str) -> str:
    return "CASE " + " ".join(f"WHEN {label} = '{k}' THEN {v}" for k, v in LABEL_IDS.items()) + " END"
