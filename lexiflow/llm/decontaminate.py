"""Benchmark passages in documents, by a distributed positional inverted index.

``postings``           the stored positional index: (document, term, position) of every benchmark term, and text lengths
``slots``              each benchmark window's terms and offsets from the rarest on
``phrase_matches``     exact occurrences of windows, by intersecting offset-adjusted posting lists
``proximity_matches``  places where the rarest terms of a window stand close together, in any order
``mark``               hit words, items and the verdict for each document

A window is ``WINDOW`` consecutive words of an item, or the whole item where it
has fewer; a window one of whose terms never occurs in the documents is dropped at once.  Candidates
come from the posting list of a window's rarest term; the lists of its second and
third rarest terms, moved by their offsets, are intersected with them one after the other, and
the lists of its remaining terms together, read only in documents that still have a candidate.
Lists are intersected by semi joins on (document, term, position), so no posting carries text and
a frequent term or window spreads over its documents and positions.

Term counts come from the index by partial aggregation.  The terms of a benchmark and the documents with
candidates are broadcast only when their stored files are small; larger ones are joined by shuffles.

Everything is DataFrame and SQL functions.

Documents are told apart by id and text, so repeated rows get equal results and
rows that share an id but not a text get their own.  Nulls: a null text has no
words; a null document id is an id like others; benchmark rows without id or
words match nothing.  Empty tables give empty results or clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import fits, stored

WINDOW = 13
RAREST = 3  # terms of a window that are intersected one by one, and that must stand close together
CONTAMINATED_PERCENT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null text: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its files are small."""
    return F.broadcast(df) if fits(df) else df


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["th"] == right["th"])


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, win, terms): the distinct windows of each item; equal windows have equal ``win``."""
    items = (bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
             .where("item IS NOT NULL AND size(w) > 0").distinct())
    last = F.greatest(F.size("w") - size, F.lit(0))
    rows = items.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("first"))
    rows = rows.select("item", F.slice("w", F.col("first") + 1, F.lit(size)).alias("terms")).distinct()
    return rows.select("item", F.md5(F.array_join("terms", " ").cast("binary")).alias("win"), "terms")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, text): ``th`` tells texts of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"),
                       F.col(text_col).alias("text"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index of ``docs``, rows of ``keyed``, for the stored table ``terms``: (id, th, pos, term, n_words).

    ``n_words`` is null but in one row of each text, that of its last word, whatever that is; a text without words
    has a row without position."""
    rows = docs.select("id", "th", words_of(F.col("text")).alias("words"))
    rows = rows.select("id", "th", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "term"))
    known = terms.withColumn("known", F.lit(True))
    rows = rows.join(F.broadcast(known) if fits(terms) else known, "term", "left").withColumn(
        "n_words", F.when(F.coalesce(F.col("pos") + 1, F.lit(0)) == F.col("n"), F.col("n").cast("long")))
    return stored(rows.where("known OR n_words IS NOT NULL").select("id", "th", "pos", "term", "n_words"), "postings")


def slots(wins: DataFrame, index: DataFrame) -> DataFrame:
    """(win, slots, rare) of the windows whose terms all occur: (term, off) of each of its words, the
    rarest term first, and its ``RAREST`` rarest distinct terms in that order."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    each = wins.select("win", "terms").distinct().select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    each = each.join(counts, "term").groupBy("win", "size").agg(F.array_sort(F.collect_list(F.struct("n", "term", "off"))).alias("s"))
    drop_n = F.transform("s", lambda x: F.struct(x["term"].alias("term"), x["off"].alias("off")))
    return (each.where(F.size("s") == F.col("size"))
            .select("win", drop_n.alias("slots"), F.slice(F.array_distinct(F.transform("s", lambda x: x["term"])), 1, RAREST).alias("rare")))


def padded(items: str, k: int) -> Column:
    """Entry ``k`` of an array, or its first where it has fewer."""
    return F.expr(f"{items}[IF(size({items}) > {k}, {k}, 0)]")


def phrase_matches(index: DataFrame, rare: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, th, win, first, last): document positions of each exact occurrence of the windows ``wins``, the
    stored rows of ``slots``; ``rare`` is the part of ``index`` that holds their rarest terms."""
    heads = wins.select("win", *[padded("slots", k).alias(f"s{k}") for k in range(RAREST)], F.col("slots")[0]["term"].alias("term"))
    found = rare.join(small(heads) if fits(wins) else heads, "term").withColumn("first", F.expr("pos - s0.off")).where("first >= 0")
    for k in range(1, RAREST):
        post = rare.select("id", "th", F.col("term").alias("t"), F.col("pos").alias("at"))
        found = found.join(post, same_doc(found, post) & (F.col(f"s{k}.term") == F.col("t")) & (F.expr(f"first + s{k}.off") == F.col("at")), "left_semi")
    found = stored(found.select("id", "th", "win", "first").distinct(), "phrase-candidates")

    rest = F.expr(f"IF(size(slots) > {RAREST}, slice(slots, {RAREST + 1}, size(slots)), slice(slots, 1, 1))")
    tails = wins.select("win", F.size("slots").alias("size"), F.size(rest).alias("wanted"), rest.alias("rest"))
    wanted = (found.join(small(tails) if fits(wins) else tails, "win").select("id", "th", "win", "first", "size", "wanted", F.explode("rest").alias("s"))
              .select("id", "th", "win", "first", "size", "wanted", F.col("s.term").alias("t"), F.expr("first + s.off").alias("at")))
    where = stored(found.select("id", "th").distinct(), "phrase-documents")
    post = index.join(small(where), same_doc(index, where), "left_semi")
    met = wanted.join(post, same_doc(wanted, post) & (F.col("t") == F.col("term")) & (F.col("at") == F.col("pos")), "left_semi")
    return (met.groupBy("id", "th", "win", "first", "size", "wanted").agg(F.count("*").alias("n")).where("n = wanted")
            .select("id", "th", "win", "first", (F.col("first") + F.col("size") - 1).alias("last")))


def proximity_matches(rare: DataFrame, wins: DataFrame, within: int = WINDOW) -> DataFrame:
    """(id, th, win, pos): places of a window's rarest term with its ``RAREST`` rarest distinct
    terms less than ``within`` words away, in any order; arguments as for ``phrase_matches``."""
    heads = wins.select("win", *[padded("rare", k).alias(f"r{k}") for k in range(1, RAREST)], F.col("rare")[0].alias("term"))
    found = rare.join(small(heads) if fits(wins) else heads, "term").withColumn("block", F.expr(f"pos div {within}"))
    # a word is close to another if it lies in the same block of positions or one beside it
    post = rare.select("id", "th", F.col("term").alias("t"), F.col("pos").alias("at"),
                       F.explode(F.expr(f"sequence(pos div {within} - 1, pos div {within} + 1)")).alias("near"))
    for k in range(1, RAREST):
        found = found.join(post, same_doc(found, post) & (F.col(f"r{k}") == F.col("t")) & (F.col("block") == F.col("near"))
                           & (F.abs(F.col("pos") - F.col("at")) < within), "left_semi")
    return found.select("id", "th", "win", "pos")


def per_document(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``sizes`` with the columns that ``found`` has for their document, if any."""
    right = found.select(F.col("id").alias("_id"), F.col("th").alias("_th"), *[c for c in found.columns if c not in ("id", "th")])
    return sizes.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th")


def mark(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", proximity: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, th;
    with ``proximity`` also n_near (positions of proximity matches) and near_items (sorted, joined by commas)."""
    rows = keyed(docs, id_col, text_col)
    found = stored(windows(bench), "bench-windows")
    terms = stored(found.select(F.explode("terms").alias("term")).distinct(), "bench-terms")
    index = postings(rows, terms)
    wins = stored(slots(found, index), "bench-slots")
    first = stored(wins.select(F.explode("rare").alias("term")).distinct(), "rare-terms")
    rare = stored(index.join(small(first), "term", "left_semi"), "rare-postings")
    owners = found.select("win", "item")
    owners = small(owners) if fits(found) else owners

    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["last"] - F.greatest(x["first"], acc["upto"] + 1) + 1, F.lit(0))).alias("n"),
        F.greatest(acc["upto"], x["last"]).alias("upto"))
    spans = F.array_sort(F.collect_set(F.struct("first", "last")))
    items_of = F.array_sort(F.collect_set("item"))
    hits = phrase_matches(index, rare, wins).join(owners, "win").groupBy("id", "th").agg(
        F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto")), step, lambda acc: acc["n"]).alias("_hit"),
        items_of.alias("_items"))
    sizes = index.where("n_words IS NOT NULL").select("id", "th", "n_words")
    out = per_document(sizes, hits)
    items = F.coalesce("_items", F.expr("CAST(array() AS array<string>)"))
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    cols = [F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * CONTAMINATED_PERCENT)).alias("contaminated"), "th"]
    if proximity:
        close = proximity_matches(rare, wins).join(owners, "win").groupBy("id", "th").agg(
            F.size(F.collect_set("pos")).cast("long").alias("_near"), F.array_join(items_of, ",").alias("_near_items"))
        out = per_document(out, close)
        cols += [F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("_near_items", F.lit("")).alias("near_items")]
    return out.select(*cols)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return mark(docs, bench, proximity=True).drop("th")


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = mark(docs, bench).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    bad = small(stored(bad, "contaminated"))
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (th == bad["_th"]), "left_anti")


#: Exact matches by plain window equality, proximity by the words around each place of a window's rarest term.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT dw.doc_id, dw.s, dw.size, bw.item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id),
place AS (SELECT doc_id, unnest(w) AS term, unnest(generate_series(1, len(w))) AS p FROM d),
cnt AS (SELECT term, count(*) AS n FROM place GROUP BY term),
bt AS (SELECT item, win, term, n, row_number() OVER (PARTITION BY item, win ORDER BY n, term) AS rank,
              min(coalesce(n, 0)) OVER (PARTITION BY item, win) AS least
       FROM (SELECT DISTINCT item, win, unnest(string_split(win, ' ')) AS term FROM bw) LEFT JOIN cnt USING (term)),
rare AS (SELECT item, win, arg_min(term, rank) AS term, list(term) AS terms FROM bt WHERE least > 0 AND rank <= 3 GROUP BY item, win),
close AS (SELECT DISTINCT place.doc_id, place.p, rare.item FROM place JOIN rare USING (term) JOIN d ON place.doc_id = d.doc_id
          WHERE list_has_all(d.w[greatest(p - 12, 1):p + 12], rare.terms)),
near AS (SELECT doc_id, count(DISTINCT p) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM close GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(its.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(its.items, ','), '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(near.n, 0) AS BIGINT) AS n_near, coalesce(near.items, '') AS near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""

#: The proximity columns alone.
NEAR_SQL = f"SELECT doc_id, n_near, near_items FROM ({SQL})"
