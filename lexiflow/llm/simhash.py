"""SimHash fingerprints, all links within a bit distance, and their components.

Search is by the generalised pigeonhole principle: the 64 bits are cut into m parts with
thresholds t_i that sum to distance - m + 1 (a part with -1 is not searched); two
fingerprints within the distance agree to within t_i bits in at least one part i.  Correlated
bits are grouped into the same part.  For each m the thresholds are chosen by
dynamic programming on the estimated cost of each part and threshold: the rows that a
search ball adds, and the candidates that it lets through.  Estimates come from
``SAMPLE`` fingerprints in hash order; every fingerprint is indexed and
searched, so the choice changes the cost, never the links.

Copies are grouped by fingerprint before the search.  Candidates are verified
inside the join, so a large group of near copies doesn't leave it as pairs
unless they are links.  Components are found by alternating large-star and
small-star rounds on the links, each stored in the shared folder.

Nulls: a null text has no words, hence the fingerprint zero, which links like any other.  A row
with a null id gets the component of its fingerprint's links; a component without
any id is null.  Empty tables give empty results; repeated rows give repeated rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import first_by_hash, free_names, map_batches, stored
from lexiflow.operators.sizes import small_side

SHINGLE, DISTANCE = 4, 4
SAMPLE = 1000
MOST_PARTS = 6
#: Cost of a probe row beside that of a candidate that a join compares.
PROBE_COST, CANDIDATE_COST = 1.0, 0.1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is set where over half of the shingles' XXH64 values (seed 42) have it."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    hashes = [digest(joined[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1:])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i:i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp) of every row, ``fp`` as a signed long; ``th`` tells texts of one id apart."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))

    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(x or "", shingle)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["id", "th", "fp"])

    return map_batches(src, run, f"id {src.schema['id'].dataType.simpleString()}, th long, fp long")


# --- plan of the search -----------------------------------------------------

def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bit positions in m parts of nearly equal size, correlated bits together:
    a part grows by the free bit with the largest correlation to it."""
    with np.errstate(invalid="ignore", divide="ignore"):  # bits that never change
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(c, 0)
    free, parts = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        left = sorted(free)
        part = [left[int(c[np.ix_(left, left)].sum(1).argmax())]]
        free.discard(part[0])
        while len(part) < size:
            left = sorted(free)
            part.append(left[int(c[np.ix_(left, part)].sum(1).argmax())])
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to search, for ``n`` fingerprints like those of ``sample``."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best = None
    for m in range(1, min(MOST_PARTS, distance + 1) + 1):
        parts, total = grouped_bits(bits, m), distance - m + 1
        table = {(0): (0.0, [])}  # sum of thresholds so far -> (cost, thresholds)
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            masked = sample & mask
            near = np.zeros(distance + 2)
            for i in range(len(sample)):
                d = np.bitwise_count(masked[i + 1:] ^ masked[i])
                near += np.bincount(np.minimum(d, distance + 1), minlength=distance + 2)
            # an unseen match is as likely as between independent bits
            share = np.maximum(near.cumsum() / pairs, [ball(len(part), t) / 2.0 ** len(part) for t in range(distance + 2)])
            cost = [0.0] + [PROBE_COST * n * (1 + ball(len(part), t)) + CANDIDATE_COST * n * n / 2 * share[t] for t in range(distance + 1)]
            new: dict = {}
            for s, (c, ts) in table.items():
                for t in range(-1, distance + 1):
                    if s + t not in new or c + cost[t + 1] < new[s + t][0]:
                        new[s + t] = (c + cost[t + 1], [*ts, t])
            table = new
        c, ts = table[total]
        if best is None or c < best[0]:
            best = (c, [(p, t) for p, t in zip(parts, ts) if t >= 0])
    return best[1]


# --- links and components ---------------------------------------------------

def _probe(k: int, part, flips: list[int]):
    return F.transform(F.array(*map(F.lit, flips)), lambda f: F.struct(F.lit(k).alias("k"), part.bitwiseXOR(f).alias("v")))


def links(fps: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` within the distance."""
    n = fps.count()
    chosen = np.array([r["fp"] for r in first_by_hash(fps.select("fp"), sample, "fp", total=n).collect()], np.int64).view(np.uint64)
    probes, index = [], []
    for k, (bits, t) in enumerate(plan(chosen, n, distance)):
        mask = sum(1 << b for b in bits)
        flips = [signed(sum(1 << b for b in f)) for r in range(t + 1) for f in combinations(bits, r)]
        part = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        index.append(F.struct(F.lit(k).alias("k"), part.alias("v")))
        probes.append(_probe(k, part, flips))
    x = fps.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("i")).select("b", "i.*")
    q = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("i")).select("a", "i.*")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return q.join(x, (q["k"] == x["k"]) & (q["v"] == x["v"]) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); ``root`` is the least node of its component."""
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(cur)
    while was[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(cur)
        if now == was:
            break
        was = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, th, fp, root, component) of every row of ``docs``; ``root`` tells components apart whose least ids are equal."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-groups")
    roots = components(links(fps, distance))
    own = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component"))
    named = own.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("id", "th", "fp", "root", "component")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                F.col("component").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row with the least id of each component, with the columns of ``docs``: of rows
    that repeat this id the one with the least text hash; rows with a null id all stay."""
    found = stored(classes(docs), "classes")
    first = found.where("id = component")
    best = first.groupBy(F.col("root").alias("_root")).agg(F.min("th").alias("_best"))
    others = first.join(best, F.col("root") == F.col("_root")).where("th <> _best")
    gone = found.where("id <> component").select("id", "th").unionByName(others.select("id", "th"))
    gone = small_side(stored(gone.select("id", "th").distinct(), "copies"))
    hash_col, = free_names(docs, "text_hash")
    rows = docs.withColumn(hash_col, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    rest = rows.join(gone, (rows["doc_id"] == gone["id"]) & (rows[hash_col] == gone["th"]), "left_anti")
    again = first.groupBy("id", "th").count().where("count > 1").limit(1).count()
    if again:  # rows that repeat an id and its text
        rest = rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", hash_col]).unionByName(rest.where("doc_id IS NULL"))
    return rest.drop(hash_col)
