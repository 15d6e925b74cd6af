"""Ranked lexical search: accumulator-limited, term at a time.

``postings``   the stored index: one row for each (document, benchmark term)
``weights``    each item's terms from the rarest on, with the most that the terms after it can add
``ranked``     the ``k`` best documents of each item, with exact integer scores

All items go through their terms together, a round for each band of document
frequency: a band ends where the frequency halves, so the first round takes
the rarest terms and the last the commonest.  A round adds its terms'
contributions to the accumulators, one for each (item, document).  Before it, an
item whose remaining terms together cannot reach its k-th best partial score
stops creating accumulators: a document that has none can't come into the
result any more.  From then on its survivors, the accumulators that can still
reach that score, are updated exactly and thinned after each round.  The bounds
are exact for the index (the largest contribution of each term), and a tie with the
k-th score never stops an item, so the result is that of scoring everything.

The k-th partial score is read from counts over narrow score bands; the least
score of the band where the count reaches k is never above it.  The
index holds only terms of the items, lies in the order of the documents, and is never shuffled
by term: items' term tables are broadcast below a measured size.  Accumulators are
grouped by (item, document), which no common term makes hot.

Every row of the documents and of the items is one of its own, also where ids
or texts repeat; rows with equal ids and scores give equal rows.  Nulls: a null text has no terms; a null
document id is an id like others and comes after them in a tie; a null item id is kept.
A text is read whole, however long.  Only the id and text columns are read, so other columns may have any
names.  Items without terms and empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import fits, map_batches, stored

TOP = 20
#: The pattern of a term over lower-cased UTF-8: all that isn't ASCII belongs to it.
TERM = rb"[0-9a-z\x80-\xff]+"
FINEST_BAND = 8  # terms in fewer than 1 of 2**8 documents share the first round
STEPS = 64  # score bands for each power of e


def document_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, tfs) for every row of ``docs``: its number of terms, and each distinct one with its occurrences."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    out = T.StructType([*src.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())),
                        T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        find = re.compile(TERM).findall
        for b in batches:
            counts = [Counter(find(x.lower())) for x in b.column(2).to_pylist()]  # bytes.lower changes A-Z only
            ends = [0]
            for c in counts:
                ends.append(ends[-1] + len(c))
            offsets = pa.array(ends, pa.int32())
            terms = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
            tfs = pa.array([f for c in counts for f in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([sum(c.values()) for c in counts], pa.int64()),
                 pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)],
                names=["row", "id", "n", "terms", "tfs"])

    return map_batches(src, run, out)


def exploded(counted: DataFrame) -> DataFrame:
    z = F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    return counted.select("row", "id", "n", z).select("row", "id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index (row, id, n, tid, tf): for every document that has terms an entry with a null ``tid``,
    and one for each of the given ``terms`` (tid, term) in it."""
    counted = document_terms(docs, id_col, text_col).where("n > 0")
    # the document's own entry has a key that no term equals and no other document has
    own = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).alias("terms"), F.lit(0).cast("long").alias("tfs"))
    rows = counted.withColumn("t", F.explode(F.concat(F.array(own), F.arrays_zip("terms", "tfs"))))
    rows = rows.select("row", "id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    rows = rows.join(F.broadcast(terms) if fits(terms) else terms, "term", "left").where("tf = 0 OR tid IS NOT NULL")
    return stored(rows.select("row", "id", "n", "tid", "tf"), "search-index")


def impact(n_docs: int, n_terms: int) -> Column:
    """The part of a contribution that the document decides."""
    length = F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 12 * (75 + length))


def weights(items: DataFrame, terms: DataFrame, index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(q, tid, w, band, rest): each item's terms that some document holds.

    ``w`` is the term's weight times its occurrences in the item, ``band`` counts from the rarest terms on, and ``rest``
    is the most that the item's terms of this and all later bands can add to one document."""
    held = index.where("tid IS NOT NULL").select("tid", impact(n_docs, n_terms).alias("impact"))
    stats = held.groupBy("tid").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    own = exploded(items).select(F.col("row").alias("q"), "term", F.col("tf").alias("qtf"))
    rows = own.join(terms, "term").join(stats, "tid")
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long") * F.col("qtf")
    halvings = F.floor(F.log2(F.lit(float(n_docs)) / F.col("df"))).cast("int")
    rows = rows.select("q", "tid", w.alias("w"), (F.lit(FINEST_BAND) - F.least(halvings, F.lit(FINEST_BAND))).alias("band"),
                       (w * F.col("most")).alias("bound"))
    later = Window.partitionBy("q").orderBy("band").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.select("q", "tid", "w", "band", F.sum("bound").over(later).alias("rest"))


def reachable(acc: DataFrame, k: int) -> DataFrame:
    """(q, kth): a score that at least ``k`` accumulators of the item reach, for items with ``k`` accumulators above 0."""
    bands = (acc.where("score > 0").groupBy("q", F.floor(F.log(F.col("score").cast("double")) * STEPS).alias("b"))
             .agg(F.count("*").alias("n"), F.min("score").alias("least")))
    above = Window.partitionBy("q").orderBy(F.desc("b"))
    return (bands.select("q", "least", F.sum("n").over(above).alias("n")).where(F.col("n") >= k)
            .groupBy("q").agg(F.max("least").alias("kth")))


def scored(index: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame | None:
    """(q, row, id, score): accumulators of each item, with its ``k`` best among them and exact; None without terms.

    ``index`` as of ``postings``, ``wanted`` as of ``weights``; one round for each band."""
    wanted = stored(wanted, "search-weights")
    small = F.broadcast if fits(wanted) else lambda df: df
    bands = [r["band"] for r in wanted.select("band").distinct().orderBy("band").collect()]
    held = index.where("tid IS NOT NULL").select("row", "id", "tid", impact(n_docs, n_terms).alias("impact"))

    def added(terms: DataFrame) -> DataFrame:
        return held.join(small(terms), "tid").select("q", "row", "id", (F.col("w") * F.col("impact")).alias("score"))

    acc = None
    for i, band in enumerate(bands):
        now = wanted.where(F.col("band") == band).select("q", "tid", "w")
        if acc is None:
            grown = added(now)
        elif state.where("shut").first() is None:
            grown = acc.unionByName(added(now))
        else:
            shut = small(state.where("shut").select("q"))
            survivors = stored(acc.join(shut, "q", "left_semi").select("q", "row"), "search-survivors")
            late = added(now.join(shut, "q", "left_semi")).join(F.broadcast(survivors) if fits(survivors) else survivors, ["q", "row"], "left_semi")
            grown = acc.unionByName(added(now.join(shut, "q", "left_anti"))).unionByName(late)
        acc = stored(grown.groupBy("q", "row").agg(F.max("id").alias("id"), F.sum("score").alias("score")), "search-accumulators")
        rest = wanted.where(F.col("band") > band).groupBy("q").agg(F.max("rest").alias("rest"))
        state = reachable(acc, k).join(rest, "q", "left").select("q", "kth", F.coalesce("rest", F.lit(0)).alias("rest"))
        state = stored(state.withColumn("shut", F.col("rest") < F.col("kth")), "search-state")
        # where unseen documents can't come in, neither can accumulators that stay below
        acc = (acc.join(small(state), "q", "left").where("shut IS NULL OR NOT shut OR score + rest >= kth")
               .select("q", "row", "id", "score"))
    return acc


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of each item, equal scores by id."""
    spark = docs.sparkSession
    items = stored(document_terms(items, item_col, item_text_col).where("n > 0"), "search-items")
    terms = stored(items.select(F.explode("terms").alias("term")).distinct()
                   .select(F.monotonically_increasing_id().alias("tid"), "term"), "search-terms")
    index = postings(docs, terms, id_col, text_col)
    sizes = index.where("tid IS NULL").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = scored(index, weights(items, terms, index, *sizes), *sizes, k)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema["id"].dataType), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", index.schema["id"].dataType), T.StructField("score", T.LongType())]))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = found.where("score > 0").select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    names = items.select(F.col("row").alias("q"), F.col("id").alias("item_id"))
    return top.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


#: Every document scored for every item.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents) WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest(w) AS term FROM q) GROUP BY q, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
       FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
im AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * CAST(len(d.w) AS BIGINT) * n_docs) // n_terms)) AS impact
       FROM tf JOIN d USING (r), s),
sc AS (SELECT q, r, CAST(sum(qtf * w * impact) AS BIGINT) AS score FROM qt JOIN wt USING (term) JOIN im USING (term) GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
      FROM sc JOIN d USING (r) WHERE score > 0) JOIN q USING (q)
WHERE rank <= 20
"""
