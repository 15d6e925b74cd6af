"""DuckDB SQL equivalents of the catalogue queries (the correctness oracle).

The SQL states each operator in its plainest single-machine form (whole-group
windows, direct joins); the Spark plans compute the same rows with scalable
physical shapes.  Builders below only assemble SQL text.
"""

from __future__ import annotations

from lexiflow.functions.hashing import sql_hash_key, sql_hash_mod
from lexiflow.functions.text import (LABEL_IDS, sql_label_to_id, sql_template, sql_word_tokens,
                                     sql_ws_tokens)
from lexiflow.operators.textclf import feature_set_name
from lexiflow.sources.tables import SQL_LABELLED, SQL_LEXICON

# The run's values, stated apart from the plans so that a change there shows.
SEED = 42
FEATURE_SETS = [("count", 1), ("tfidf", 1), ("count", 2), ("tfidf", 2), ("count", 3), ("tfidf", 3)]
ALPHAS = [0.001, 0.1, 1.0, 10.0, 1000.0]


class C:
    SOURCE, TARGET = "en", "fr"
    SHOTS, SHOTS_GRID, ORDER_SEEDS = 20, [5, 10, 20], [42, 7]
    HASH_VOCAB = 30000


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def h(*keys: str) -> str:
    return sql_hash_key(SEED, *keys)


def split_cte(name: str, src: str, group: list[str], cuts: list[float], names: list[str],
              seed_keys: tuple = ()) -> str:
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    case = "CASE " + " ".join(f"WHEN rank <= floor({c}::DOUBLE * n) THEN '{nm}'" for c, nm in zip(cuts, names)) \
        + f" ELSE '{names[-1]}' END"
    return f"""{name} AS (
  SELECT *, {case} AS split FROM (
    SELECT *, row_number() OVER ({part} ORDER BY {sql_hash_key(SEED, *seed_keys, 'id')}, id) AS rank,
           count(*) OVER ({part}) AS n
    FROM {src}))"""


SPLIT3 = split_cte("split3", "labelled", ["lang"], [0.7, 0.8], ["train", "dev", "test"])
SPLIT73 = split_cte("split73", "labelled", ["lang"], [0.7], ["train", "test"])


def terms_cte(src: str, max_n: int, name: str = "terms") -> str:
    """Per-document term counts (id, n, term, tf) of 1..max_n-grams."""
    parts = ["SELECT id, 1 AS n, unnest(t) AS term FROM tok"]
    if max_n >= 2:
        parts.append("SELECT id, 2 AS n, unnest(list_transform(range(1, len(t)), "
                     "lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok")
    if max_n >= 3:
        parts.append("SELECT id, 3 AS n, unnest(list_transform(range(1, len(t) - 1), "
                     "lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS term FROM tok")
    return f"""tok AS (SELECT id, {sql_word_tokens('text')} AS t FROM {src}),
grams AS ({' UNION ALL '.join(parts)}),
{name} AS (SELECT id, n, term, count(*) AS tf FROM grams GROUP BY id, n, term)"""


def nb_ctes(keys: list[str], feature_sets, alphas, keep: list[str], min_df=7, max_df=0.8, k=100000) -> list[str]:
    """Naive-Bayes pipeline over CTEs ``terms`` (id, n, term, tf), ``ta``
    (keys, id, label) and ``ea`` (keys, id, label, keep...).  Ends in ``pred``."""
    K = ", ".join(keys)
    kk = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    fs_rows = ", ".join(f"('{feature_set_name(w, m)}', '{w}', {m})" for w, m in feature_sets)
    al_rows = ", ".join(f"({float(a)!r}::DOUBLE)" for a in alphas)
    keep_sel = "".join(f", d.{c}" for c in keep)
    keep_plain = "".join(f", {c}" for c in keep)
    return [
        f"fsets(feature_set, weighting, ngram_max) AS (VALUES {fs_rows})",
        "ranges AS (SELECT DISTINCT ngram_max FROM fsets)",
        f"alphas(alpha) AS (VALUES {al_rows})",
        f"""trt AS (SELECT {kk('a')}, t.id, t.term, t.tf, r.ngram_max
  FROM terms t JOIN ta a ON a.id = t.id JOIN ranges r ON t.n <= r.ngram_max)""",
        f"ndocs AS (SELECT {kk('a')}, r.ngram_max, count(*) AS n_docs FROM ta a, ranges r GROUP BY ALL)",
        f"st AS (SELECT {K}, ngram_max, term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM trt GROUP BY ALL)",
        f"""kept AS (SELECT st.*, nd.n_docs FROM st JOIN ndocs nd USING ({K}, ngram_max)
  WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * nd.n_docs)""",
        f"""topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K}, ngram_max ORDER BY tf DESC, term) AS r
  FROM kept) WHERE r <= {k})""",
        f"""vocab AS (SELECT {K}, ngram_max, term, tf, df, n_docs,
  row_number() OVER (PARTITION BY {K}, ngram_max ORDER BY term) - 1 AS term_index,
  ln((n_docs + 1) / (df + 1)) + 1 AS idf FROM topk)""",
        f"""evt AS (SELECT {kk('a')}, t.id, t.term, t.tf, r.ngram_max
  FROM terms t JOIN (SELECT DISTINCT {K}, id FROM ea) a ON a.id = t.id JOIN ranges r ON t.n <= r.ngram_max)""",
        f"""trx AS (SELECT {kk('c')}, f.feature_set, c.id, v.term_index,
  CASE WHEN f.weighting = 'count' THEN c.tf::DOUBLE
       ELSE c.tf * v.idf / sqrt(sum((c.tf * v.idf) * (c.tf * v.idf)) OVER (PARTITION BY {kk('c')}, f.feature_set, c.id)) END AS x
  FROM trt c JOIN vocab v USING ({K}, ngram_max, term) JOIN fsets f ON f.ngram_max = c.ngram_max)""",
        f"""evx AS (SELECT {kk('c')}, f.feature_set, c.id, v.term_index,
  CASE WHEN f.weighting = 'count' THEN c.tf::DOUBLE
       ELSE c.tf * v.idf / sqrt(sum((c.tf * v.idf) * (c.tf * v.idf)) OVER (PARTITION BY {kk('c')}, f.feature_set, c.id)) END AS x
  FROM evt c JOIN vocab v USING ({K}, ngram_max, term) JOIN fsets f ON f.ngram_max = c.ngram_max)""",
        f"""vsize AS (SELECT {kk('kt')}, f.feature_set, coalesce(s.V, 0) AS V
  FROM (SELECT DISTINCT {K} FROM ta) kt CROSS JOIN fsets f
  LEFT JOIN (SELECT {K}, ngram_max, count(*) AS V FROM vocab GROUP BY ALL) s
    ON {' AND '.join(f's.{x} = kt.{x}' for x in keys)} AND s.ngram_max = f.ngram_max)""",
        f"cdocs AS (SELECT {K}, label, count(*) AS n_c FROM ta GROUP BY ALL)",
        f"""ct AS (SELECT {kk('x')}, x.feature_set, a.label, x.term_index, sum(x.x) AS n_ct
  FROM trx x JOIN ta a USING ({K}, id) GROUP BY ALL)""",
        f"nc AS (SELECT {K}, feature_set, label, sum(n_ct) AS n_c_terms FROM ct GROUP BY ALL)",
        f"""classes AS (SELECT {kk('c')}, f.feature_set, al.alpha, c.label,
  ln(c.n_c / sum(c.n_c) OVER (PARTITION BY {kk('c')}, f.feature_set, al.alpha)) AS prior,
  CASE WHEN v.V > 0 THEN ln(al.alpha / (coalesce(nc.n_c_terms, 0) + al.alpha * v.V)) ELSE 0 END AS floor
  FROM cdocs c CROSS JOIN fsets f CROSS JOIN alphas al
  JOIN vsize v ON {' AND '.join(f'v.{x} = c.{x}' for x in keys)} AND v.feature_set = f.feature_set
  LEFT JOIN nc ON {' AND '.join(f'nc.{x} = c.{x}' for x in keys)} AND nc.feature_set = f.feature_set AND nc.label = c.label)""",
        f"weights AS (SELECT ct.*, al.alpha, ln((n_ct + al.alpha) / al.alpha) AS w FROM ct CROSS JOIN alphas al)",
        f"elen AS (SELECT {K}, feature_set, id, sum(x) AS len FROM evx GROUP BY ALL)",
        f"""base AS (SELECT {kk('d')}, f.feature_set, c.alpha, d.id, d.label{keep_sel}, c.label AS class,
  c.prior + coalesce(l.len, 0) * c.floor AS base
  FROM ea d CROSS JOIN fsets f
  LEFT JOIN elen l ON {' AND '.join(f'l.{x} = d.{x}' for x in keys)} AND l.feature_set = f.feature_set AND l.id = d.id
  JOIN classes c ON {' AND '.join(f'c.{x} = d.{x}' for x in keys)} AND c.feature_set = f.feature_set)""",
        f"""sparse AS (SELECT {kk('x')}, x.feature_set, w.alpha, x.id, w.label AS class, sum(x.x * w.w) AS sp
  FROM evx x JOIN weights w USING ({K}, feature_set, term_index) GROUP BY ALL)""",
        f"""scores AS (SELECT b.*, b.base + coalesce(s.sp, 0) AS score
  FROM base b LEFT JOIN sparse s USING ({K}, feature_set, alpha, id, class))""",
        f"""pred AS (SELECT {K}, feature_set, alpha, id, label{keep_plain}, class AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY {K}, feature_set, alpha, id
                               ORDER BY round(score, 9) DESC, {sql_label_to_id('class')}) AS rn
  FROM scores) WHERE rn = 1)""",
    ]


def metrics_ctes(src: str, keys: list[str], overall: str | None = None, name: str = "metrics",
                 digits: int | None = 6, is_confusion: bool = False) -> list[str]:
    """Confusion -> accuracy, weighted F1, balanced accuracy per key."""
    K = ", ".join(keys)
    conf = f"conf_{name}"
    cnt = "sum(cnt)" if is_confusion else "count(*)"
    ctes = [f"{conf}0 AS (SELECT {K}, label, prediction, {cnt} AS cnt FROM {src} GROUP BY ALL)"]
    if overall is not None:
        first, rest = keys[0], keys[1:]
        rest_sel = "".join(f"{r}, " for r in rest)
        sel = ", ".join(f"'{overall}' AS {first}" if x == first else x for x in keys)
        ctes.append(f"""{conf} AS (SELECT * FROM {conf}0 UNION ALL BY NAME
  SELECT {sel}, label, prediction, sum(cnt) AS cnt FROM {conf}0 GROUP BY {rest_sel}label, prediction)""")
    else:
        ctes.append(f"{conf} AS (SELECT * FROM {conf}0)")
    r = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    ctes += [
        f"""sup_{name} AS (SELECT {K}, label, sum(cnt) AS support,
  sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS tp FROM {conf} GROUP BY ALL)""",
        f"prd_{name} AS (SELECT {K}, prediction AS label, sum(cnt) AS predicted FROM {conf} GROUP BY ALL)",
        f"""tot_{name} AS (SELECT {K}, sum(cnt) AS n,
  sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS correct FROM {conf} GROUP BY ALL)""",
        f"""{name} AS (SELECT {', '.join('s.' + x for x in keys)}, CAST(t.n AS BIGINT) AS n,
  {r('t.correct / t.n')} AS accuracy,
  {r('sum(s.support / t.n * 2 * s.tp / (s.support + coalesce(p.predicted, 0)))')} AS weighted_f1,
  {r('avg(s.tp / s.support)')} AS balanced_accuracy
  FROM sup_{name} s LEFT JOIN prd_{name} p USING ({K}, label) JOIN tot_{name} t USING ({K})
  GROUP BY {', '.join('s.' + x for x in keys)}, t.n, t.correct)""",
    ]
    return ctes


def _q(*ctes, select: str) -> str:
    return with_(*ctes) + select


def build() -> dict[str, str]:
    L = SQL_LABELLED
    q: dict[str, str] = {}
    q["read_project"] = _q(L, select="SELECT id, lang, text, label FROM labelled "
                                     "WHERE id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    q["lang_filter"] = _q(L, select=f"SELECT id, lang, label FROM labelled WHERE lang = '{C.SOURCE}'")
    q["source_filter"] = _q(L, select=f"SELECT id, lang, label FROM labelled WHERE lang <> '{C.TARGET}'")
    q["class_filter"] = _q(L, select="SELECT id, lang, label FROM labelled WHERE label = 'negative'")
    q["translate_swap"] = _q(L, select="""SELECT lb.id, lb.lang, lb.label, b.text AS text
FROM labelled lb JOIN benchmark b ON b.item_id = lb.id % (SELECT count(*) FROM benchmark)""")
    q["domain_tag"] = _q(L, select=f"""SELECT id, lang, CAST(CASE WHEN lang = '{C.SOURCE}' THEN 0 ELSE 1 END AS BIGINT) AS domain
FROM labelled WHERE lang IN ('{C.SOURCE}', '{C.TARGET}')""")

    ws = sql_ws_tokens("text")
    q["strip_mentions"] = f"""SELECT doc_id AS id,
  array_to_string(list_filter({ws}, lambda x: NOT starts_with(x, '@')), ' ') AS text_clean,
  CAST(len({ws}) AS BIGINT) AS n_tokens FROM documents"""
    hits = f"""hits AS (
  SELECT id, pos, word FROM (
    SELECT id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS word
    FROM (SELECT id, {ws} AS t FROM labelled)) x
  WHERE word IN (SELECT word FROM lexicon))"""
    q["lexicon_semijoin"] = _q(L, SQL_LEXICON, hits, select="SELECT id, CAST(pos AS BIGINT) AS pos, word FROM hits")
    q["lexicon_keep"] = _q(L, SQL_LEXICON, hits, select="""SELECT lb.id, lb.lang, lb.label, k.text
FROM labelled lb JOIN (SELECT id, string_agg(word, ' ' ORDER BY pos) AS text FROM hits GROUP BY id) k ON k.id = lb.id""")
    wt = sql_word_tokens("text")
    q["word_tokens"] = f"""SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n_words, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {wt} AS t FROM documents)"""
    grams = ("list_concat(t, "
             "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), "
             "list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))")
    q["ngrams_1_3"] = _q(L, select=f"""SELECT id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT id, {grams} AS g FROM (SELECT id, {wt} AS t FROM labelled))""")
    q["token_lengths"] = f"""SELECT doc_id AS id, CAST(len({ws}) AS BIGINT) AS n_tokens,
  CAST(len({ws}) + 2 AS BIGINT) AS n_tokens_special FROM documents"""
    ids = f"list_transform({wt}, lambda x: {sql_hash_mod(repr('tok'), 'x', C.HASH_VOCAB)} + 1)"
    q["pad_truncate"] = _q(L, f"p AS (SELECT id, {ids} AS ids FROM labelled)", select="""SELECT id,
  CAST(len(ids) AS BIGINT) AS n_ids,
  array_to_string(list_concat(ids, list_transform(range(greatest(0, 500 - len(ids))), lambda x: 0)), ',') AS padded_500,
  array_to_string(list_concat(ids[1:128], list_transform(range(greatest(0, 128 - len(ids))), lambda x: 0)), ',') AS truncated_128,
  array_to_string(CASE WHEN len(ids) > 128 THEN list_concat(ids[1:127], [ids[-1]]) ELSE ids END, ',') AS keep_last_128,
  array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i <= least(len(ids), 128) THEN 1 ELSE 0 END), ',') AS mask_128
FROM p""")
    q["prompt_rows"] = _q(L, select=f"""SELECT id, {sql_template('text', 'label')} AS prompt,
  {sql_template('text', "''")} || 'negative' AS completion FROM labelled""")
    inv = "CASE " + " ".join(f"WHEN label_id = {v} THEN '{k}'" for k, v in LABEL_IDS.items()) + " END"
    q["label_ids"] = _q(L, select=f"""SELECT id, label, label_id, {inv} AS label_back FROM (
  SELECT id, label, CAST({sql_label_to_id('label')} AS BIGINT) AS label_id FROM labelled)""")

    # splits
    q["shuffle_rank"] = _q(L, select=f"""SELECT id, lang, row_number() OVER (ORDER BY {h('id')}, id) AS shuffle_rank
FROM labelled""")
    q["split_70_10_20"] = _q(L, SPLIT3, select="SELECT id, lang, split, rank, n FROM split3")
    q["split_70_30"] = _q(L, SPLIT73, select="SELECT id, lang, split, rank, n FROM split73")
    q["split_80_20"] = _q(L, split_cte("s82", "labelled", ["lang"], [0.8], ["train", "dev"]),
                          select="SELECT id, lang, split, rank, n FROM s82")
    q["holdout_ceil30"] = _q(L, select=f"""SELECT id, lang,
  CASE WHEN rank <= n - ceil(0.3::DOUBLE * n) THEN 'train' ELSE 'test' END AS split, rank, n FROM (
  SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h('id')}, id) AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM labelled)""")
    q["head_10pct"] = """SELECT id, lang, CASE WHEN rank <= round_even(n * 10 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split,
  rank, n FROM (
  SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM documents)"""
    tr73 = "tr AS (SELECT id, lang, label, text FROM split73 WHERE split = 'train')"
    q["oversample"] = _q(L, SPLIT73, tr73, f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {h('id')}, id) AS crank
  FROM tr)""", """sizes AS (SELECT lang, label, count(*) AS ncls, max(count(*)) OVER (PARTITION BY lang) AS mx
  FROM tr GROUP BY lang, label)""", """draws AS (SELECT lang, label, ncls, unnest(range(1, mx - ncls + 1)) AS copy_no
  FROM sizes WHERE mx > ncls)""", select=f"""SELECT lang, label, id, CAST(0 AS BIGINT) AS copy_no FROM tr
UNION ALL
SELECT d.lang, d.label, r.id, CAST(d.copy_no AS BIGINT) FROM draws d JOIN ranked r
  ON r.lang = d.lang AND r.label = d.label AND r.crank = {sql_hash_mod(SEED, 'd.label', 'd.copy_no', 'd.ncls')} + 1""")
    sample = f"""ex AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {h('id')}, id) AS sample_rank FROM tr)
  WHERE sample_rank <= {C.SHOTS})"""
    q["class_sample"] = _q(L, SPLIT73, tr73, sample, select="SELECT lang, label, id, sample_rank FROM ex")
    ordered = f"""exo AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h(repr('order'), 'id')}, id) AS order_rank
  FROM ex)"""
    q["dedupe_last_label"] = _q(L, SPLIT73, tr73, sample, ordered, select="""SELECT lang, text,
  arg_max(label, order_rank) AS label, min(order_rank) AS order_rank FROM exo GROUP BY lang, text""")
    q["pair_source_target"] = _q(L, f"""src AS (SELECT id AS source_id, row_number() OVER (ORDER BY {h('id')}, id) AS srank
  FROM labelled WHERE lang = '{C.SOURCE}')""", select=f"""SELECT t.id AS target_id, s.source_id
FROM labelled t JOIN src s ON s.srank = {sql_hash_mod(SEED, 't.id', f"(SELECT count(*) FROM labelled WHERE lang = '{C.SOURCE}')")} + 1
WHERE t.lang = '{C.TARGET}'""")

    # set operations
    q["dev_plus_test"] = _q(L, SPLIT3, select="SELECT id, lang, split FROM split3 WHERE split IN ('dev', 'test')")
    q["joint_pool"] = _q(L, split_cte("tg", f"(SELECT * FROM labelled WHERE lang = '{C.TARGET}')", ["lang"], [0.7],
                                      ["train", "test"]),
                         split_cte("sr", f"(SELECT * FROM labelled WHERE lang <> '{C.TARGET}')", [], [0.8],
                                   ["train", "dev"]),
                         select="""SELECT id, lang, 'target' AS slice FROM tg WHERE split = 'train'
UNION ALL SELECT id, lang, 'source' AS slice FROM sr WHERE split = 'train'""")
    q["pooled_corpus"] = _q(L, split_cte("sp", "labelled", [], [0.7, 0.8], ["train", "dev", "test"]),
                            select="SELECT id, lang, label, split FROM sp")

    # aggregations
    q["label_order"] = _q(L, SPLIT3, select="""SELECT lang, label, first_rank,
  row_number() OVER (PARTITION BY lang ORDER BY first_rank) AS label_order FROM (
  SELECT lang, label, min(rank) AS first_rank FROM split3 WHERE split = 'train' GROUP BY lang, label)""")
    q["class_share"] = _q(L, SPLIT3, select="""SELECT lang, label, cnt, round(cnt / sum(cnt) OVER (PARTITION BY lang), 6) AS share
FROM (SELECT lang, label, count(*) AS cnt FROM split3 WHERE split = 'test' GROUP BY lang, label)""")
    q["corpus_counts"] = _q(L, SPLIT3, select="SELECT lang, split, count(*) AS n_rows FROM split3 GROUP BY lang, split")

    q["null_group_rank"] = _q(L, select=f"""SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY {h('id')}, id) AS rank,
  count(*) OVER (PARTITION BY grp) AS n FROM (SELECT id, CASE WHEN source <> 'src3' THEN source END AS grp FROM labelled)""")
    q["first_rows"] = _q(L, select="SELECT id, lang, label FROM labelled ORDER BY id LIMIT 100")
    q["vocab_topk_ties"] = _q(L, SPLIT3, terms_cte("labelled", 1), """st AS (SELECT s.lang, t.term, CAST(sum(t.tf) AS BIGINT) AS tf, count(*) AS df
  FROM terms t JOIN split3 s ON s.id = t.id WHERE s.split = 'train' GROUP BY s.lang, t.term)""", """nd AS (SELECT lang, count(*) AS n FROM split3
  WHERE split = 'train' GROUP BY lang)""", """tk AS (SELECT st.* FROM st JOIN nd USING (lang) WHERE df >= 2 AND df <= 0.8::DOUBLE * n
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY tf DESC, term) <= 100)""",
                              select="SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY term) - 1 AS term_index, tf, df FROM tk")

    # features
    ta = "ta AS (SELECT lang, id, label FROM split3 WHERE split = 'train')"
    ea = "ea AS (SELECT lang, id, label, split FROM split3)"
    q["df_tf"] = _q(L, SPLIT3, ta, terms_cte("labelled", 3), select="""SELECT ta.lang, CAST(t.n AS BIGINT) AS n, t.term,
  CAST(sum(t.tf) AS BIGINT) AS tf, count(*) AS df FROM terms t JOIN ta ON ta.id = t.id GROUP BY ta.lang, t.n, t.term""")
    for m in (1, 2, 3):
        q[f"vocab_topk_{m}"] = _q(L, SPLIT3, ta, ea, terms_cte("labelled", m),
                                  *nb_ctes(["lang"], [("count", m)], [1.0], ["split"])[:9],
                                  select="SELECT lang, term, term_index, tf, df FROM vocab")
    q["idf"] = _q(L, SPLIT3, ta, ea, terms_cte("labelled", 1), *nb_ctes(["lang"], [("count", 1)], [1.0], [])[:9],
                  select="SELECT lang, term, round(idf, 6) AS idf FROM vocab")
    q["tf_counts"] = _q(L, SPLIT3, ta, ea, terms_cte("labelled", 2),
                        *nb_ctes(["lang"], [("count", 2)], [1.0], [])[:12],
                        select="SELECT lang, id, term_index, CAST(x AS BIGINT) AS tf FROM evx")
    q["tfidf_l2"] = _q(L, SPLIT3, ta, ea, terms_cte("labelled", 1),
                       *nb_ctes(["lang"], [("tfidf", 1)], [1.0], [])[:12],
                       select="SELECT lang, id, term_index, round(x, 6) AS value FROM evx")
    q["feature_grid"] = _q(L, SPLIT3, ta, ea, terms_cte("labelled", 3),
                           *nb_ctes(["lang"], FEATURE_SETS, [1.0], [])[:12],
                           select="SELECT feature_set, lang, id, term_index, round(x, 6) AS value FROM evx")

    # BPE: what training starts from, and what encoding must give back
    wt_ws = sql_ws_tokens("text")
    types = f"""wtypes AS (SELECT '\u2581' || w AS word, count(*) AS freq FROM (SELECT unnest({sql_ws_tokens("lb.text")}) AS w FROM labelled lb
  JOIN split3 s ON s.id = lb.id WHERE s.split IN ('train', 'dev')) GROUP BY w)"""
    alpha = """alpha AS (SELECT c, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS c, freq FROM wtypes)
  GROUP BY c ORDER BY n DESC, c LIMIT 500)"""
    q["bpe_word_types"] = _q(L, SPLIT3, types, select="SELECT word, freq FROM wtypes")
    q["bpe_alphabet"] = _q(L, SPLIT3, types, alpha, select="SELECT c, n FROM alpha")
    q["bpe_pair_counts"] = _q(L, SPLIT3, types, alpha, """sy AS (SELECT freq, list_filter(regexp_extract_all(word, '(?s).'),
  lambda x: list_contains(cs, x)) AS s FROM wtypes, (SELECT list(c) AS cs FROM alpha))""", select="""SELECT a, b, CAST(sum(freq) AS BIGINT) AS n
FROM (SELECT freq, unnest(s[1:len(s) - 1]) AS a, unnest(s[2:len(s)]) AS b FROM sy WHERE len(s) > 1) GROUP BY a, b HAVING sum(freq) >= 5""")
    q["bpe_roundtrip"] = _q(L, select=f"""SELECT id, CAST(len(w) AS BIGINT) AS n_words,
  md5(array_to_string(list_transform(w, lambda x: '\u2581' || x), ' ')) AS joined_md5
FROM (SELECT id, {wt_ws} AS w FROM labelled) WHERE len(w) > 0""")

    # naive Bayes, evaluation, selection
    nb1 = [L, SPLIT3, ta, ea, terms_cte("labelled", 1), *nb_ctes(["lang"], [("count", 1)], [1.0], ["split"])]
    q["nb_predict"] = _q(*nb1, select="SELECT lang, id, split, label, prediction FROM pred WHERE split <> 'train'")
    q["nb_metrics"] = _q(*nb1, *metrics_ctes("pred", ["lang", "split"], overall="all"), select="SELECT * FROM metrics")
    reps = f"""reps AS (SELECT *, CASE WHEN rank <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rank <= floor(0.8::DOUBLE * n) THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT id, lang, label, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY {sql_hash_key('rep', 'id')}, id) AS rank,
               count(*) OVER (PARTITION BY lang, rep) AS n FROM labelled, (VALUES (42), (43), (44), (45), (46)) r(rep)))"""
    q["nb_repeat_mean"] = _q(L, reps, "ta AS (SELECT lang, rep, id, label FROM reps WHERE split = 'train')",
                             "ea AS (SELECT lang, rep, id, label, split FROM reps WHERE split <> 'train')", terms_cte("labelled", 1),
                             *nb_ctes(["lang", "rep"], [("count", 1)], ALPHAS, ["split"]),
                             *metrics_ctes("pred", ["lang", "rep", "alpha", "split"], digits=None),
                             """mm AS (SELECT lang, alpha, count(DISTINCT rep) AS repeats,
  avg(CASE WHEN split = 'dev' THEN balanced_accuracy END) AS dev_bacc, avg(CASE WHEN split = 'test' THEN weighted_f1 END) AS test_f1,
  avg(CASE WHEN split = 'test' THEN balanced_accuracy END) AS test_bacc FROM metrics GROUP BY lang, alpha)""",
                             select="""SELECT lang, alpha, repeats, round(dev_bacc, 6) AS dev_bacc, round(test_f1, 6) AS test_f1,
  round(test_bacc, 6) AS test_bacc,
  row_number() OVER (PARTITION BY lang ORDER BY round(dev_bacc, 9) DESC NULLS LAST, alpha) = 1 AS best FROM mm""")
    q["constant_baseline"] = _q(L, SPLIT3, """cc AS (SELECT lang, label, count(*) AS cnt FROM split3 WHERE split = 'test'
  GROUP BY lang, label)""", """cp AS (SELECT a.lang, a.label, b.label AS constant, b.label AS prediction, a.cnt
  FROM cc a JOIN cc b ON a.lang = b.lang)""", *metrics_ctes("cp", ["lang", "constant"], is_confusion=True),
        select="""SELECT m.lang, m.constant, m.n, m.weighted_f1, m.balanced_accuracy,
  round(c.cnt / sum(c.cnt) OVER (PARTITION BY c.lang), 6) AS share
FROM metrics m JOIN cc c ON c.lang = m.lang AND c.label = m.constant""")
    def grid_of(head: list[str], key: str, src: str) -> list[str]:
        return [*head, terms_cte(src, 3), *nb_ctes([key], FEATURE_SETS, ALPHAS, ["split"]),
                *metrics_ctes("pred", [key, "feature_set", "alpha", "split"], digits=None),
                f"""gw AS (SELECT {key}, feature_set, alpha,
  max(CASE WHEN split = 'train' THEN accuracy END) AS train_acc,
  max(CASE WHEN split = 'dev' THEN weighted_f1 END) AS dev_f1,
  max(CASE WHEN split = 'dev' THEN balanced_accuracy END) AS dev_bacc,
  max(CASE WHEN split = 'test' THEN accuracy END) AS test_acc,
  max(CASE WHEN split = 'test' THEN weighted_f1 END) AS test_f1,
  max(CASE WHEN split = 'test' THEN balanced_accuracy END) AS test_bacc
  FROM metrics GROUP BY {key}, feature_set, alpha)"""]

    grid = grid_of([L, SPLIT3, ta, ea], "lang", "labelled")
    alpha_pos = "list_position([" + ", ".join(f"{float(a)!r}::DOUBLE" for a in ALPHAS) + "], alpha)"
    fs_pos = "list_position([" + ", ".join(f"'{feature_set_name(w, m)}'" for w, m in FEATURE_SETS) + "], feature_set)"
    def best_of(ctes: list[str], key: str) -> str:
        return _q(*ctes, f"""b1 AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {key}, feature_set ORDER BY round(dev_f1, 9) DESC NULLS LAST, {alpha_pos}) AS r
  FROM gw) WHERE r = 1)""", select=f"""SELECT {key}, feature_set, alpha,
  row_number() OVER (PARTITION BY {key} ORDER BY round(dev_f1, 9) DESC NULLS LAST, {fs_pos}) = 1 AS best_feature_set,
  round(train_acc, 6) AS train_acc, round(dev_f1, 6) AS dev_f1, round(test_acc, 6) AS test_acc,
  round(test_f1, 6) AS test_f1, round(test_bacc, 6) AS test_bacc FROM b1""")

    q["nb_grid_best"] = best_of(grid, "lang")
    q["pooled_grid_best"] = best_of(grid_of([
        L, split_cte("sp", "(SELECT id, label, 'pooled' AS corpus FROM labelled)", [], [0.7, 0.8], ["train", "dev", "test"]),
        "ta AS (SELECT corpus, id, label FROM sp WHERE split = 'train')", "ea AS (SELECT corpus, id, label, split FROM sp)"], "corpus", "labelled"), "corpus")
    q["lexicon_grid_best"] = best_of(grid_of([
        L, SQL_LEXICON, hits, """lexlab AS (SELECT lb.id, lb.lang, lb.label, k.text FROM labelled lb
  JOIN (SELECT id, string_agg(word, ' ' ORDER BY pos) AS text FROM hits GROUP BY id) k ON k.id = lb.id)""",
        split_cte("sp", "(SELECT id, lang, label FROM lexlab)", ["lang"], [0.7, 0.8], ["train", "dev", "test"]),
        "ta AS (SELECT lang, id, label FROM sp WHERE split = 'train')", "ea AS (SELECT lang, id, label, split FROM sp)"], "lang", "lexlab"), "lang")
    q["best_checkpoint"] = _q(*grid, f"""ckp AS (SELECT *, CAST({fs_pos} * 10 + {alpha_pos} AS BIGINT) AS step FROM gw)""",
                              select="""SELECT lang, step AS best_step, round(dev_bacc, 6) AS dev_bacc,
  round(test_f1, 6) AS test_f1, round(test_bacc, 6) AS test_bacc FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(dev_bacc, 9) DESC NULLS LAST, step) AS r FROM ckp)
WHERE r = 1""")
    q["slice_metrics"] = _q(L, SPLIT3, "ta AS (SELECT 'pooled' AS model, id, label FROM split3 WHERE split = 'train')",
                            "ea AS (SELECT 'pooled' AS model, id, label, lang AS slice FROM split3 WHERE split = 'test')",
                            terms_cte("labelled", 1), *nb_ctes(["model"], [("count", 1)], [1.0], ["slice"]),
                            *metrics_ctes("pred", ["slice"], overall="all"), select="SELECT * FROM metrics")
    q["transfer_matrix"] = _q(L, SPLIT3, "ta AS (SELECT lang AS source, id, label FROM split3 WHERE split = 'train')",
                              """ea AS (SELECT s.source, t.id, t.label, t.lang AS target
  FROM split3 t CROSS JOIN (SELECT DISTINCT source FROM ta) s WHERE t.split IN ('dev', 'test'))""",
                              terms_cte("labelled", 1), *nb_ctes(["source"], [("count", 1)], [1.0], ["target"]),
                              *metrics_ctes("pred", ["target", "source"], overall="all"), select="SELECT * FROM metrics")
    return q


def bigram_ctes(keys: list[str], ex: str, rows: str, alpha: float = 1.0, p: str = "bg") -> list[str]:
    """Class-conditional bigram scorer.  ex: (keys, text, label); rows:
    (keys, id, text).  Ends in {p}_scores(keys, id, candidate, score)."""
    K = ", ".join(keys)
    kk = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    j = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    wt = sql_word_tokens("text")
    a = f"{float(alpha)!r}"
    ev = "unnest(list_concat(['<s>'], t)[1:len(t)]) AS prev, unnest(t) AS w"
    return [
        f"{p}_ext AS (SELECT {K}, label AS candidate, {wt} AS t FROM {ex})",
        f"{p}_exev AS (SELECT * FROM (SELECT {K}, candidate, {ev} FROM {p}_ext) WHERE w IS NOT NULL)",
        f"{p}_n2 AS (SELECT {K}, candidate, prev, w, count(*) AS n2 FROM {p}_exev GROUP BY ALL)",
        f"{p}_n1 AS (SELECT {K}, candidate, prev, count(*) AS n1 FROM {p}_exev GROUP BY ALL)",
        f"{p}_voc AS (SELECT {K}, count(DISTINCT w) + 1 AS V FROM (SELECT {K}, unnest(t) AS w FROM {p}_ext) GROUP BY ALL)",
        f"""{p}_cls AS (SELECT DISTINCT {kk('e')}, e.candidate, coalesce(v.V, 1) AS V
  FROM {p}_ext e LEFT JOIN {p}_voc v ON {j('e', 'v')})""",
        f"{p}_rt AS (SELECT {K}, id, {wt} AS t FROM {rows})",
        f"""{p}_rev AS (SELECT {K}, id, prev, w, count(*) AS m FROM (
  SELECT * FROM (SELECT {K}, id, {ev} FROM {p}_rt) WHERE w IS NOT NULL) GROUP BY ALL)""",
        f"""{p}_pa AS (SELECT {kk('r')}, r.id, n.candidate, sum(r.m * (ln(n.n2 + {a}) - ln({a}))) AS sa
  FROM {p}_rev r JOIN {p}_n2 n ON {j('r', 'n')} AND r.prev = n.prev AND r.w = n.w GROUP BY ALL)""",
        f"""{p}_pb AS (SELECT {kk('r')}, r.id, n.candidate, sum(r.m * (ln(n.n1 + {a} * c.V) - ln({a} * c.V))) AS sb
  FROM {p}_rev r JOIN {p}_n1 n ON {j('r', 'n')} AND r.prev = n.prev
  JOIN {p}_cls c ON {j('c', 'n')} AND c.candidate = n.candidate GROUP BY ALL)""",
        f"""{p}_base AS (SELECT {kk('r')}, r.id, c.candidate, len(r.t) AS n_tok, len(r.t) * (ln({a}) - ln({a} * c.V)) AS b
  FROM {p}_rt r JOIN {p}_cls c ON {j('r', 'c')})""",
        f"""{p}_scores AS (SELECT {kk('b')}, b.id, b.candidate,
  CASE WHEN b.n_tok > 0 THEN (b.b + coalesce(pa.sa, 0) - coalesce(pb.sb, 0)) / b.n_tok ELSE 0 END AS score
  FROM {p}_base b
  LEFT JOIN {p}_pa pa ON {j('b', 'pa')} AND b.id = pa.id AND b.candidate = pa.candidate
  LEFT JOIN {p}_pb pb ON {j('b', 'pb')} AND b.id = pb.id AND b.candidate = pb.candidate)""",
    ]


def wide_cte(keys: list[str], src: str, name: str = "wide") -> str:
    K = ", ".join(keys)
    cols = ", ".join(f"round(max(CASE WHEN candidate = '{x}' THEN score END), 6) AS {x}" for x in LABEL_IDS)
    return f"""{name} AS (SELECT w.*, b.predicted_label FROM
  (SELECT {K}, id, {cols} FROM {src} GROUP BY ALL) w JOIN
  (SELECT {K}, id, candidate AS predicted_label FROM (
     SELECT *, row_number() OVER (PARTITION BY {K}, id ORDER BY round(score, 9) DESC, {sql_label_to_id('candidate')}) AS rn
     FROM {src}) WHERE rn = 1) b USING ({K}, id))"""


def blocks_ctes(L: int = 128, batch: int = 1000) -> list[str]:
    wt = sql_word_tokens("text")
    return [
        f"""bd AS (SELECT doc_id AS id, lang, {wt} AS t,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents)""",
        f"bb AS (SELECT *, (rank - 1) // {batch} AS batch FROM bd)",
        """bo AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY lang, batch ORDER BY rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  sum(len(t)) OVER (PARTITION BY lang, batch) AS total FROM bb)""",
        """btk AS (SELECT lang, batch, total, off + generate_subscripts(t, 1) - 1 AS gpos, unnest(t) AS tok FROM bo)""",
        f"""blk AS (SELECT lang, CAST(batch AS BIGINT) AS batch, CAST(gpos // {L} AS BIGINT) AS block,
  list(tok ORDER BY gpos) AS toks
  FROM btk WHERE gpos < CASE WHEN total >= {L} THEN (total // {L}) * {L} ELSE total END
  GROUP BY lang, batch, gpos // {L})""",
    ]


def nb_transfer(*head: str, keys: list[str], keep: list[str], src: str = "labelled") -> list[str]:
    return [*head, terms_cte(src, 1), *nb_ctes(keys, [("count", 1)], [1.0], keep)]


def build_more() -> dict[str, str]:
    L = SQL_LABELLED
    q: dict[str, str] = {}
    tr73t = "fstr AS (SELECT s.id, s.lang, s.label, lb.text FROM split73 s JOIN labelled lb ON lb.id = s.id WHERE s.split = 'train')"
    dev73t = "fsdev AS (SELECT s.id, s.lang, s.label, lb.text FROM split73 s JOIN labelled lb ON lb.id = s.id WHERE s.split = 'test')"
    exs = [f"""fss AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {h('id')}, id) AS sample_rank FROM fstr)
  WHERE sample_rank <= {C.SHOTS})""",
           f"""fso AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h(repr('order'), 'id')}, id) AS order_rank
  FROM fss)""",
           """fsx AS (SELECT lang, text, arg_max(label, order_rank) AS label, min(order_rank) AS order_rank
  FROM fso GROUP BY lang, text)"""]
    head = [L, SPLIT73, tr73t, dev73t, *exs]
    line = sql_template("text", "label") + " || chr(10)"
    q["fewshot_context"] = _q(*head, select=f"""SELECT lang, count(*) AS n_examples,
  string_agg({line}, '' ORDER BY order_rank) AS context FROM fsx GROUP BY lang""")
    ask = sql_template("d.text", "''")
    q["fewshot_prompts"] = _q(*head, f"""ctx AS (SELECT lang, string_agg({line}, '' ORDER BY order_rank) AS context FROM fsx GROUP BY lang)""",
                              f"""pr AS (SELECT d.lang, d.id, c.context || {ask} AS prompt FROM fsdev d JOIN ctx c ON c.lang = d.lang)""",
                              select="""SELECT lang, id, candidate, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5,
  md5(prompt || candidate) AS completion_md5 FROM pr, (VALUES ('negative'), ('neutral'), ('positive')) v(candidate)""")
    bg = bigram_ctes(["lang"], "fsx", "fsdev")
    q["fewshot_scores"] = _q(*head, *bg, select="SELECT lang, id, candidate, round(score, 6) AS score FROM bg_scores")
    q["fewshot_labels"] = _q(*head, *bg, wide_cte(["lang"], "bg_scores"), select="""SELECT w.*, s.label
FROM wide w JOIN split73 s ON s.id = w.id""")
    grid = ", ".join(f"({s})" for s in C.SHOTS_GRID)
    seeds = ", ".join(f"({s})" for s in C.ORDER_SEEDS)
    sweep = [L, SPLIT73, tr73t, dev73t,
             f"""sm AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {h('id')}, id) AS sample_rank FROM fstr)""",
             f"""sg AS (SELECT s.*, g.shots, sd.seed FROM sm s JOIN (VALUES {grid}) g(shots) ON s.sample_rank <= g.shots
  CROSS JOIN (VALUES {seeds}) sd(seed))""",
             f"""so AS (SELECT *, row_number() OVER (PARTITION BY lang, shots, seed
  ORDER BY {sql_hash_key('seed', repr('order'), 'id')}, id) AS order_rank FROM sg)""",
             """sx AS (SELECT lang, shots, seed, text, arg_max(label, order_rank) AS label, min(order_rank) AS order_rank
  FROM so GROUP BY lang, shots, seed, text)""",
             """srows AS (SELECT d.id, d.lang, d.label, d.text, k.shots, k.seed FROM fsdev d
  JOIN (SELECT DISTINCT lang, shots, seed FROM sx) k ON k.lang = d.lang)""",
             *bigram_ctes(["lang", "shots", "seed"], "sx", "srows"),
             wide_cte(["lang", "shots", "seed"], "bg_scores")]
    q["fewshot_sweep"] = _q(*sweep, select="""SELECT w.lang, CAST(w.shots AS BIGINT) AS shots, CAST(w.seed AS BIGINT) AS seed,
  count(*) AS n, round(avg(CASE WHEN r.label = w.predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM wide w JOIN srows r ON r.lang = w.lang AND r.shots = w.shots AND r.seed = w.seed AND r.id = w.id
GROUP BY w.lang, w.shots, w.seed""")

    tpl_ex = sql_word_tokens(sql_template("text", "label"))
    tpl_dev = sql_word_tokens(sql_template("d.text", "c.candidate"))
    labels_v = ", ".join(f"('{x}')" for x in LABEL_IDS)
    q["answer_span_ll"] = _q(*head, f"actx AS (SELECT lang, {tpl_ex} AS t FROM fsx)",
                             """acev AS (SELECT * FROM (SELECT lang, unnest(list_concat(['<s>'], t)[1:len(t)]) AS prev,
  unnest(t) AS w FROM actx) WHERE w IS NOT NULL)""",
                             "ac2 AS (SELECT lang, prev, w, count(*) AS n2 FROM acev GROUP BY ALL)",
                             "ac1 AS (SELECT lang, prev, count(*) AS n1 FROM acev GROUP BY ALL)",
                             "acv AS (SELECT lang, count(DISTINCT w) + 1 AS V FROM (SELECT lang, unnest(t) AS w FROM actx) GROUP BY lang)",
                             f"""acand AS (SELECT d.lang, d.id, c.candidate, {tpl_dev} AS t,
  len({sql_word_tokens('c.candidate')}) AS ans_len FROM fsdev d CROSS JOIN (VALUES {labels_v}) c(candidate))""",
                             """atk AS (SELECT lang, id, candidate, ans_len, len(t) AS n_tokens, generate_subscripts(t, 1) - 1 AS pos,
  unnest(list_concat(['<s>'], t)[1:len(t)]) AS prev, unnest(t) AS w FROM acand)""",
                             select="""SELECT k.lang, k.id, k.candidate,
  round(avg(ln((coalesce(a.n2, 0) + 1.0) / (coalesce(b.n1, 0) + v.V))), 6) AS answer_ll
FROM atk k LEFT JOIN ac2 a ON a.lang = k.lang AND a.prev = k.prev AND a.w = k.w
LEFT JOIN ac1 b ON b.lang = k.lang AND b.prev = k.prev JOIN acv v ON v.lang = k.lang
WHERE k.pos >= k.n_tokens - k.ans_len GROUP BY k.lang, k.id, k.candidate""")

    # corpus
    q["token_blocks"] = _q(*blocks_ctes(), select="""SELECT lang, batch, block, CAST(len(toks) AS BIGINT) AS n_tokens,
  array_to_string(toks, ' ') AS text FROM blk""")
    key = "lang, batch, block"
    hk = sql_hash_key(SEED, "lang", "batch", "block", "(i - 1)")
    part = lambda a, n: f"(CAST(('0x' || substr({hk}, {a}, 8)) AS BIGINT) % {n})"
    ch = f"({part(1, 100)} < 15)"
    ids = f"list_transform(toks, lambda x: {sql_hash_mod(repr('tok'), 'x', C.HASH_VOCAB)} + 1)"
    masked = [*blocks_ctes(), f"bi AS (SELECT {key}, {ids} AS ids FROM blk)",
                       f"""bm AS (SELECT {key},
  list_transform(ids, lambda x, i: CASE WHEN NOT {ch} THEN x WHEN {part(9, 10)} < 8 THEN {C.HASH_VOCAB + 1}
                                        WHEN {part(9, 10)} < 9 THEN {part(17, C.HASH_VOCAB)} + 1 ELSE x END) AS masked,
  list_transform(ids, lambda x, i: CASE WHEN {ch} THEN x ELSE -100 END) AS targets FROM bi)"""]
    q["masked_accuracy"] = _q(*masked, select="""SELECT count(*) AS n, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT unnest(targets) AS t, unnest(masked) AS p FROM bm) WHERE t <> -100""")
    q["mlm_mask"] = _q(*masked,
                       select=f"""SELECT {key}, CAST(len(list_filter(targets, lambda t: t <> -100)) AS BIGINT) AS n_masked,
  array_to_string(masked, ',') AS masked_ids, array_to_string(targets, ',') AS targets FROM bm""")
    wt = sql_word_tokens("text")
    q["bigram_perplexity"] = _q(
        """pd AS (SELECT doc_id AS id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank,
  count(*) OVER (PARTITION BY lang) AS n FROM documents)""",
        "ps AS (SELECT *, CASE WHEN rank <= round_even(n * 10 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split FROM pd)",
        f"pt AS (SELECT lang, split, {wt} AS t FROM ps)",
        """pe AS (SELECT * FROM (SELECT lang, split, unnest(list_concat(['<s>'], t)[1:len(t)]) AS prev, unnest(t) AS w FROM pt)
  WHERE w IS NOT NULL)""",
        "p2 AS (SELECT lang, prev, w, count(*) AS n2 FROM pe WHERE split = 'train' GROUP BY ALL)",
        "p1 AS (SELECT lang, prev, count(*) AS n1 FROM pe WHERE split = 'train' GROUP BY ALL)",
        """pv AS (SELECT lang, count(DISTINCT w) + 1 AS V FROM (SELECT lang, unnest(t) AS w FROM pt WHERE split = 'train')
  GROUP BY lang)""",
        "pm AS (SELECT lang, prev, w, count(*) AS m FROM pe WHERE split = 'validation' GROUP BY ALL)",
        """pj AS (SELECT m.lang, m.m, -(ln(coalesce(a.n2, 0) + 1.0) - ln(coalesce(b.n1, 0) + 1.0 * coalesce(v.V, 1))) AS nll
  FROM pm m LEFT JOIN p2 a ON a.lang = m.lang AND a.prev = m.prev AND a.w = m.w
  LEFT JOIN p1 b ON b.lang = m.lang AND b.prev = m.prev LEFT JOIN pv v ON v.lang = m.lang)""",
        select="""SELECT lang, CAST(sum(m) AS BIGINT) AS n_events, round(sum(m * nll) / sum(m), 6) AS mean_nll,
  round(exp(sum(m * nll) / sum(m)), 6) AS perplexity FROM pj GROUP BY lang""")

    # transfer
    S_ = "en"
    src_en = split_cte("srcsp", f"(SELECT id, lang, label FROM split73 WHERE lang = '{S_}')", [], [0.8], ["train", "dev"])
    q["in_language"] = _q(*nb_transfer(L, SPLIT73, "ta AS (SELECT lang AS target, id, label FROM split73 WHERE split = 'train')",
                                       "ea AS (SELECT lang AS target, id, label FROM split73 WHERE split = 'test')",
                                       keys=["target"], keep=[]),
                          *metrics_ctes("pred", ["target"], overall="all"), select="SELECT * FROM metrics")
    zs_head = [L, SPLIT73, split_cte("srcsp", "(SELECT id, lang, label FROM split73)", ["lang"], [0.8], ["train", "dev"]),
               "ta AS (SELECT lang AS source, id, label FROM srcsp WHERE split = 'train')",
               """ea AS (SELECT s.source, t.id, t.label, t.lang AS target FROM split73 t
  JOIN (SELECT DISTINCT lang AS source FROM split73) s ON s.source <> t.lang WHERE t.split = 'test')"""]
    q["zero_shot"] = _q(*nb_transfer(*zs_head, keys=["source"], keep=["target"]),
                        *metrics_ctes("pred", ["target", "source"], overall="all"), select="SELECT * FROM metrics")
    pool = """loopool AS (SELECT s.id, s.lang, s.label, t.target FROM split73 s
  CROSS JOIN (SELECT DISTINCT lang AS target FROM split73) t WHERE s.lang <> t.target)"""
    q["joint_train"] = _q(*nb_transfer(L, SPLIT73, pool, split_cte("loosp", "loopool", ["target"], [0.8], ["train", "dev"]), """ta AS (
  SELECT lang AS target, id, label FROM split73 WHERE split = 'train'
  UNION ALL SELECT target, id, label FROM loosp WHERE split = 'train')""", """ea AS (
  SELECT lang AS target, id, label, 'target' AS slice FROM split73 WHERE split = 'test'
  UNION ALL SELECT target, id, label, 'source' AS slice FROM loosp WHERE split = 'dev')""", keys=["target"], keep=["slice"]),
                          *metrics_ctes("pred", ["target", "slice"]), select="SELECT * FROM metrics")
    both = ("bothtext AS (SELECT id, text FROM labelled UNION ALL "
            "SELECT -(lb.id + 1) AS id, b.text FROM labelled lb JOIN benchmark b "
            "ON b.item_id = lb.id % (SELECT count(*) FROM benchmark))")
    src_en = split_cte("srcsp", f"(SELECT id, lang, label FROM split73 WHERE lang = '{S_}')", [], [0.8], ["train", "dev"])
    tgts = f"tgts AS (SELECT DISTINCT lang AS target FROM split73 WHERE lang <> '{S_}')"
    q["translate_train"] = _q(*nb_transfer(L, SPLIT73, src_en, both, tgts, f"""ta AS (
  SELECT lang AS target, id, label FROM split73 WHERE lang <> '{S_}' AND split = 'train'
  UNION ALL SELECT t.target, -(s.id + 1) AS id, s.label FROM srcsp s, tgts t WHERE s.split = 'train')""", f"""ea AS (
  SELECT lang AS target, id, label, 'target' AS slice FROM split73 WHERE lang <> '{S_}' AND split = 'test'
  UNION ALL SELECT t.target, -(s.id + 1) AS id, s.label, 'source' AS slice FROM srcsp s, tgts t WHERE s.split = 'dev')""",
                                           keys=["target"], keep=["slice"], src="bothtext"),
                              *metrics_ctes("pred", ["target", "slice"]), select="SELECT * FROM metrics")
    q["translate_test"] = _q(*nb_transfer(L, SPLIT73, src_en, both,
                                          f"ta AS (SELECT '{S_}' AS source, id, label FROM srcsp WHERE split = 'train')",
                                          f"""ea AS (SELECT '{S_}' AS source, -(id + 1) AS id, label, lang AS target FROM split73
  WHERE lang <> '{S_}' AND split = 'test')""",
                                          keys=["source"], keep=["target"], src="bothtext"),
                             *metrics_ctes("pred", ["target"]), select="SELECT * FROM metrics")
    q["leave_one_out"] = _q(*nb_transfer(L, SPLIT73, pool, split_cte("loosp", "loopool", ["target"], [0.8], ["train", "dev"]),
                                         "ta AS (SELECT target, id, label FROM loosp WHERE split = 'train')",
                                         "ea AS (SELECT lang AS target, id, label FROM split73 WHERE split = 'test')",
                                         keys=["target"], keep=[]),
                            *metrics_ctes("pred", ["target"], overall="all"), select="SELECT * FROM metrics")
    q["pred_entropy"] = _q(*nb_transfer(*zs_head, keys=["source"], keep=["target"]),
                           "se AS (SELECT source, target, id, class, exp(score - max(score) OVER (PARTITION BY source, target, id)) AS e FROM scores)",
                           "sp AS (SELECT source, target, id, class, e / sum(e) OVER (PARTITION BY source, target, id) AS p FROM se)",
                           """rh AS (SELECT source, target, id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h
  FROM sp GROUP BY source, target, id)""",
                           "rn AS (SELECT source, target, count(*) AS n, avg(h) AS mean_entropy FROM rh GROUP BY source, target)",
                           """mq AS (SELECT s.source, s.target, s.class, sum(s.p) / r.n AS q FROM sp s
  JOIN rn r USING (source, target) GROUP BY s.source, s.target, s.class, r.n)""",
                           """dv AS (SELECT source, target, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) AS diversity
  FROM mq GROUP BY source, target)""",
                           select="""SELECT source, target, CAST(r.n AS BIGINT) AS n, round(r.mean_entropy, 6) AS mean_entropy,
  round(d.diversity, 6) AS diversity FROM rn r JOIN dv d USING (source, target)""")
    q["coral_distance"] = _q(
        "ce AS (SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS domain, embedding FROM embeddings)",
        "cx AS (SELECT vec_id, domain, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM ce)",
        """cm AS (SELECT a.domain, a.i, b.i AS j, sum(a.v * b.v) AS sxx FROM cx a JOIN cx b ON a.vec_id = b.vec_id
  GROUP BY a.domain, a.i, b.i)""",
        "cu AS (SELECT domain, i, avg(v) AS m, count(*) AS n FROM cx GROUP BY domain, i)",
        """cc AS (SELECT o.domain, o.i, o.j, (o.sxx / a.n - a.m * b.m) * a.n / (a.n - 1) AS c FROM cm o
  JOIN cu a ON a.domain = o.domain AND a.i = o.i JOIN cu b ON b.domain = o.domain AND b.i = o.j)""",
        select="""SELECT CAST(max(s.i) AS BIGINT) AS d,
  CAST((SELECT max(n) FROM cu WHERE domain = 0) AS BIGINT) AS n_source,
  CAST((SELECT max(n) FROM cu WHERE domain = 1) AS BIGINT) AS n_target,
  round(sum((s.c - t.c) * (s.c - t.c)) / (4 * max(s.i) * max(s.i)), 6) AS coral
FROM cc s JOIN cc t ON s.i = t.i AND s.j = t.j AND s.domain = 0 AND t.domain = 1""")
    return q
