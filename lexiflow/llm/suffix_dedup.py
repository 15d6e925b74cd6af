"""Repeated passages by a distributed sparse suffix array.

Words are hashed; a window of ``LEAST`` words has ``LEAST - GRAM + 1`` grams of
``GRAM`` words, of which the least hash (its minimiser) is kept.  So both copies
of a passage keep the same positions, chosen by content alone.

1. ``anchors``    the minimiser positions of every text: (gram, row, pos)
2. anchors whose gram occurs once are dropped (counts are summed up in each task first)
3. ``suffixes``   for grams that occur at most ``NEIGHBOURS + 1`` times the suffix: gram, the words to its
   right, those to its left, reversed
4. ``matches``    suffixes are range-sorted by all three; each is compared with its ``NEIGHBOURS`` next ones on
   either side, so with all of its gram, and a common part is extended to the right and left; rows at the
   edges of sorted partitions are compared in a second, small step
5. ``windows``    for grams that occur more often the hashes of the windows whose minimiser they are
   (one row for a window, however many hold the gram), and ``repeats``, those that occur twice: no two
   occurrences are compared, so a gram that a third of all documents hold costs no more than others
6. ``spans``      a document's overlapping matches joined

Both copies of a window have the same minimiser, so its gram sends both to step 4 or both to step 5: the
spans are the union of all windows of ``LEAST`` words that occur twice (words compared by 32-bit hashes in
step 4, grams and windows by 64-bit ones).

Rows are told apart by id and text.  Nulls: a null text has no words; a null id is an id like others.  Texts
of fewer than ``LEAST`` words have no spans.  Repeated rows repeat each other's
passages.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import batch, map_batches, stored

LEAST, GRAM, NEIGHBOURS = 50, 25, 4
REMEMBERED = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, for up to ``REMEMBERED`` words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words (runs of doubling lengths put together, modulo 2**64)."""
    n = len(words) - size + 1
    out, done = np.zeros(n, np.uint64), 0
    run, length, base = words, 1, BASE  # hashes of all runs of ``length`` words, and the weight of such a run
    while length <= size:
        if size & length:
            out = out * base + run[done:done + n]
            done += length
        run = run[:-length] * base + run[length:]
        base = np.uint64(int(base) ** 2 % 2**64)
        length *= 2
    return _mixed(out)


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the leftmost least hash of some run of ``window`` hashes."""
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(view.argmin(1) + np.arange(len(view)))


def row_key(id_col: str = "id", text_col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))


def anchors(rows: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(gram, row, pos) of ``rows`` (row, text)."""
    def run(batches):
        known = WordHashes()
        schema = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
        for b in batches:
            g, r, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = known.of(text)
                if len(words) >= least:
                    h = grams(words, gram)
                    at = minimisers(h, least - gram + 1)
                    g.append(h[at].view(np.int64))
                    r.append(np.full(len(at), row, np.int64))
                    p.append(at.astype(np.int32))
            yield batch(schema, pa.array(np.concatenate(g)), pa.array(np.concatenate(r)), pa.array(np.concatenate(p)))

    return map_batches(rows.select("row", "text"), run, "gram long, row long, pos int")


def suffixes(rows: DataFrame, kept: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(gram, right, left, id, row, pos): ``right`` and ``left`` hold four bytes for each of up to
    ``least - gram`` words after the gram and, backwards, before it."""
    lists = kept.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    src = rows.join(lists, F.col("row") == F.col("_row")).select("id", "row", "text", "at")
    reach = least - gram
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        known = WordHashes()
        for b in batches:
            for k in range(b.num_rows):
                words = known.of(b.column(2)[k].as_py())
                at = np.asarray(b.column(3)[k].as_py(), np.int64)
                if len(words) < least:
                    continue
                h = grams(words, gram)
                at = at[at < len(h)]
                short = (words >> np.uint64(32)).astype(">u4")
                back = short[::-1].copy()
                n, m = len(words), len(at)
                right = [short[p + gram:p + gram + reach].tobytes() for p in at.tolist()]
                left = [back[n - p:n - p + reach].tobytes() for p in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(right, pa.binary()), pa.array(left, pa.binary()),
                     pa.array([b.column(0)[k].as_py()] * m, b.schema.field(0).type),
                     pa.array(np.full(m, b.column(1)[k].as_py(), np.int64)), pa.array(at.astype(np.int32))],
                    names=["gram", "right", "left", "id", "row", "pos"])

    return map_batches(src, run, f"gram long, right binary, left binary, id {kind}, row long, pos int")


def windows(rows: DataFrame, crowded: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(win, id, row, pos): a hash of each window of ``least`` words whose minimiser is among ``crowded`` (row, pos)."""
    lists = crowded.groupBy(F.col("row").alias("_row")).agg(F.collect_set("pos").alias("at"))
    src = rows.join(lists, F.col("row") == F.col("_row")).select("id", "row", "text", "at")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        known = WordHashes()
        for b in batches:
            for k in range(b.num_rows):
                words = known.of(b.column(2)[k].as_py())
                if len(words) < least:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(grams(words, gram), least - gram + 1)
                at = np.flatnonzero(np.isin(view.argmin(1) + np.arange(len(view)), b.column(3)[k].as_py()))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams(words, least)[at].view(np.int64)), pa.array([b.column(0)[k].as_py()] * m, b.schema.field(0).type),
                     pa.array(np.full(m, b.column(1)[k].as_py(), np.int64)), pa.array(at.astype(np.int32))],
                    names=["win", "id", "row", "pos"])

    return map_batches(src, run, f"win long, id {kind}, row long, pos int")


def repeats(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, id, start, end, other) of each of the windows ``found`` that occurs twice; ``other`` is the least document of the other occurrences."""
    # Spark keeps two rows of a window in each task before the shuffle
    order = Window.partitionBy("win").orderBy(F.col("id").asc_nulls_last(), "row", "pos")
    two = found.withColumn("k", F.row_number().over(order)).where("k <= 2")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    least_two = stored(two.groupBy(F.col("win").alias("_win")).agg(
        F.count("*").alias("n"), of(1, "id").alias("_id"), of(1, "row").alias("_row"), of(1, "pos").alias("_pos"), of(2, "id").alias("_next"))
        .where("n > 1").drop("n"), "repeated-windows")
    own = (F.col("row") == F.col("_row")) & (F.col("pos") == F.col("_pos"))
    start = F.col("pos").cast("long")
    return (found.join(least_two, F.col("win") == F.col("_win"))
            .select("row", "id", start.alias("start"), (start + least).alias("end"), F.when(own, F.col("_next")).otherwise(F.col("_id")).alias("other")))


def _words(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as a matrix of words, and the number of words in each row."""
    data = column.to_pylist()
    n = np.fromiter(map(len, data), np.int64, len(data)) // 4
    flat = b"".join(x.ljust(4 * reach, b"\0") for x in data)
    return np.frombuffer(flat, ">u4").reshape(-1, reach), n


def _common(a, a_n, b, b_n) -> np.ndarray:
    """How many leading words two rows share."""
    same = a == b
    n = np.where(same.all(1), a.shape[1], (~same).argmax(1))
    return np.minimum(n, np.minimum(a_n, b_n))


def compared(rows: pa.Table, reach: int, least: int, gram: int, neighbours: int) -> pa.Table | None:
    """(row, id, start, end, other) of each suffix that shares a passage of
    ``least`` words with a close one: all such passages hold its gram, so they
    join to one range; ``other`` is the least document of them."""
    g = rows.column("gram").to_numpy()
    right, right_n = _words(rows.column("right"), reach)
    left, left_n = _words(rows.column("left"), reach)
    pos = rows.column("pos").to_numpy().astype(np.int64)
    rank = pc.rank(rows.column("id"), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    none = np.int64(len(g) + 1)
    start, end, other = pos.copy(), np.zeros(len(g), np.int64), np.full(len(g), none)
    for d in range(1, min(neighbours, len(g) - 1) + 1):
        i = np.flatnonzero(g[:-d] == g[d:])
        j = i + d
        after = _common(right[i], right_n[i], right[j], right_n[j])
        before = _common(left[i], left_n[i], left[j], left_n[j])
        long = before + gram + after >= least
        i, j, after, before = i[long], j[long], after[long], before[long]
        for x, y in ((i, j), (j, i)):
            start[x] = np.minimum(start[x], pos[x] - before)
            end[x] = np.maximum(end[x], pos[x] + gram + after)
            other[x] = np.minimum(other[x], rank[y])
    hit = np.flatnonzero(other < none)
    if not len(hit):
        return None
    holder = np.zeros(none, np.int64)
    holder[rank] = np.arange(len(g))
    return pa.table({"row": rows.column("row").take(hit), "id": rows.column("id").take(hit), "start": start[hit], "end": end[hit],
                     "other": rows.column("id").take(holder[other[hit]])})


def _compare(df: DataFrame, least: int, gram: int, neighbours: int, edges: bool) -> DataFrame:
    """Matches within each sorted partition; with ``edges`` also its first and last rows, for a second comparison."""
    reach = least - gram
    names = ["gram", "right", "left", "id", "row", "pos"]
    kind = df.schema["id"].dataType.simpleString()
    extra = ", gram long, right binary, left binary, pos int, part int" if edges else ""

    def run(batches):
        part, tail, first = TaskContext.get().partitionId(), None, None

        def out(table, **more):
            n = table.num_rows
            cols = []
            for f in schema:
                if f.name in more:
                    cols.append(pa.array([more[f.name]] * n, f.type))
                elif f.name in table.column_names:
                    cols.append(table.column(f.name).cast(f.type))
                else:
                    cols.append(pa.nulls(n, f.type))
            return pa.table(cols, schema=schema).combine_chunks().to_batches()

        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            if schema is None:
                t = b.schema.field("id").type
                fields = [("row", pa.int64()), ("id", t), ("start", pa.int64()), ("end", pa.int64()), ("other", t)]
                if edges:
                    fields += [("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("pos", pa.int32()), ("part", pa.int32())]
                schema = pa.schema(fields)
            here = pa.Table.from_batches([b]).select(names)
            if first is None:
                first = here.slice(0, neighbours)
            rows = here if tail is None else pa.concat_tables([tail, here]).combine_chunks()
            found = compared(rows, reach, least, gram, neighbours)
            if found is not None and found.num_rows:
                yield from out(found)
            tail = rows.slice(max(0, rows.num_rows - neighbours))
        if edges and first is not None:
            yield from out(first, part=part)
            yield from out(tail, part=part)

    return map_batches(df.select(*names), run, f"row long, id {kind}, start long, end long, other {kind}{extra}")


def matches(found: DataFrame, least: int = LEAST, gram: int = GRAM, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(row, id, start, end, other): word ranges that the document ``other`` holds too."""
    order = ["gram", "right", "left", "row", "pos"]
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = stored(_compare(found.repartitionByRange(n, *order).sortWithinPartitions(*order), least, gram, neighbours, True), "matches")
    # at most twice ``neighbours`` rows of each sorted partition
    edge = inner.where("part IS NOT NULL").select(*["gram", "right", "left", "id", "row", "pos"]).distinct()
    outer = _compare(edge.coalesce(1).sortWithinPartitions(*order), least, gram, neighbours, False)
    cols = ["row", "id", "start", "end", "other"]
    return inner.where("part IS NULL").select(*cols).unionByName(outer.select(*cols))


def spans(found: DataFrame) -> DataFrame:
    """(id, start, end, other) of overlapping or touching matches joined; ``other`` is the least document of the joined matches."""
    each = found.groupBy("row", "start", "end").agg(F.first("id").alias("id"), F.min("other").alias("other"))
    lists = each.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("m"))
    kind = f"array<{lists.schema['m'].dataType.elementType.simpleString()}>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["other"], x["other"]).alias("other"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return lists.select("row", "id", F.explode(F.aggregate("m", F.expr(f"CAST(array() AS {kind})"), step)).alias("s")).select("row", "id", "s.*")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
                   neighbours: int = NEIGHBOURS) -> DataFrame:
    """(row, id, start, end, other): word ranges of every document that consist of repeated passages; ``end`` is exclusive."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", row_key())
    marks = stored(anchors(rows, least, gram), "anchors")
    # stored, so that both sides of the join are plain exchanges, whose hot partitions Spark splits
    often = stored(marks.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-grams")
    kept = stored(marks.join(often, F.col("gram") == F.col("_gram")).select("row", "pos", (F.col("_n") > neighbours + 1).alias("crowded")), "kept-anchors")
    few = matches(suffixes(rows, kept.where("NOT crowded"), least, gram), least, gram, neighbours)
    many = repeats(stored(windows(rows, kept.where("crowded"), least, gram), "windows"), least)
    return spans(few.unionByName(many))


def report(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                                       (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"))
