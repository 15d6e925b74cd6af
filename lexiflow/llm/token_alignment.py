"""Alignment of two tokenizers' tokens, by merge-path partitioning.

``merge_path``   where diagonals of equal spacing cut the merge of two sorted lists of token ends
``cut_piece``    one piece's complete groups, and its open token runs at either end
``align``        the groups of one text: its pieces, stitched
``aligned_groups``  one row per group: byte range and both tokenizers' ids
``report``       per document the counts and digests, with corpus-wide counts of linked id pairs

The ends of the tokens of A and B are merged by value.  Binary searches along
diagonals divide the merged order into pieces of ``PIECE`` ends each, whatever
the share of A and B in it; each piece is then cut on its own where an A token and a B
token end at the same byte.  What a piece leaves open before its first and
after its last cut is stitched to its neighbours; where a diagonal parts two equal ends,
the cut is made while stitching.

Within a group every A token is linked with every B token; a group is counted by
its distinct ids, so that its links are never written out one by one.  A document's distinct linked pairs with
their multiplicity are stored; how many documents hold a pair, and the highest such count of each A id, are sums
over all documents.  The commonest ``HEAD`` pairs or fewer are broadcast to look their counts up,
the others are joined by a shuffle; no pair of the second kind is frequent enough to be a hot key.

Nulls: a null or empty text has no tokens, nor has one whose tokens of either side
don't join to the text's bytes after one space; such rows have zeros and an empty digest.  Every row of the documents gives one row,
repeated rows and null ids too, and a pair's count counts rows.  Texts are read whole.  Only the id and text
columns are read, so other columns may have any names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import map_batches, stored

PIECE = 4096
HEAD = 1 << 19
SMALL = 64  # links of a group that are written out before equal ones are summed
#: The words that a byte-level vocabulary of this kind is merged within: a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged values come from ``a``, for each d; on equal values ``a`` goes first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        mid = (low + high) >> 1
        live = low < high
        m, d = mid[live], diagonals[live]
        up = a[m] <= b[d - 1 - m]
        low[live] = np.where(up, m + 1, low[live])
        high[live] = np.where(up, high[live], m)
    return low


def cut_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) before each common end of one piece; the rest of the piece stays open."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = np.nonzero(b[at] == a)[0] if len(b) else np.empty(0, np.int64)
    return both + 1, at[both] + 1


def align(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups as numbers of A tokens and of B tokens; both lists of ends must end at the same byte."""
    total = len(a_ends) + len(b_ends)
    diagonals = np.append(np.arange(0, total, piece), total)
    ia = merge_path(a_ends, b_ends, diagonals)
    ib = diagonals - ia
    out_a, out_b = [], []
    for p in range(len(ia) - 1):
        i, j = ia[p], ib[p]
        # the diagonal before this piece may part an A end from an equal B end
        if i and j < len(b_ends) and a_ends[i - 1] == b_ends[j]:
            out_a.append([i])
            out_b.append([j + 1])
        x, y = cut_piece(a_ends[i:ia[p + 1]], b_ends[j:ib[p + 1]])
        out_a.append(x + i)
        out_b.append(y + j)
    return np.concatenate(out_a).astype(np.int64), np.concatenate(out_b).astype(np.int64)


class Pair:
    """Both tokenizers with the bytes of their tokens; one for each task process."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(a_path)
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        size = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(size)))
        self.b_bytes = [bytes([int(w[3:5], 16)]) if self.b.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        n = max(size, len(self.a_bytes))
        self.names = np.array([f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(n)], object)
        self.stride = n

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where either side's bytes differ from the text's."""
        full = [i for i, x in enumerate(texts) if x]
        out: list = [([], [])] * len(texts)
        spaced = [" " + texts[i] for i in full]
        a = map(self.a.encode_ordinary, spaced)
        b = self.b.encode([texts[i] for i in full], num_threads=1)
        for i, want, x, y in zip(full, spaced, a, b):
            raw = want.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw:
                out[i] = x, y
        return out

    def group_text(self, a, b, ga, gb) -> str:
        """``a1,a2|b1;a3|b2,b3`` for the groups that end after ``ga`` and ``gb`` tokens."""
        n = self.stride
        a_names, b_names = a.copy(), b.copy()  # a comma after each id,
        a_names[ga - 1] += n  # a bar after the last of A,
        b_names[gb - 1] += 2 * n  # a semicolon after the last of B,
        b_names[-1] += n  # and nothing at the end
        # a token's place: those of its own side before it and those of the other side in earlier groups
        codes = np.empty(len(a) + len(b), np.int64)
        size_a, size_b = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        codes[np.arange(len(a)) + np.repeat(gb - size_b, size_a)] = a_names
        codes[np.arange(len(b)) + np.repeat(ga, size_b)] = b_names
        return "".join(self.names[codes].tolist())


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable bytes for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def byte_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes in a byte-level vocabulary file, whose merges must be in the order of the ids they make;
    special tokens, which aren't made of byte letters by merges, are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab, byte_of = spec["model"]["vocab"], byte_letters()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(set(made)):
        raise ValueError(f"{path}: merges aren't in the order of their ids")
    return {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in special}


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def distinct(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, occurrences) of the distinct ids of each group, by group."""
    keys, n = np.unique(groups << 20 | ids, return_counts=True)
    return keys >> 20, keys & ((1 << 20) - 1), n


def linked_pairs(a, b, ga, gb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A id, B id, links) of the distinct pairs of one text, by id; in a group of many links equal ids are counted first."""
    size_a, size_b = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    groups = np.arange(len(ga))
    xg, yg = np.repeat(groups, size_a), np.repeat(groups, size_b)
    xi, yi, xn, yn = a, b, None, None
    if (size_a * size_b).max() > SMALL:
        xg, xi, xn = distinct(xg, a)
        yg, yi, yn = distinct(yg, b)
        size_b = np.bincount(yg, minlength=len(ga))
    # each A id of a group beside each B id of it
    first = np.cumsum(size_b) - size_b
    reps = size_b[xg]
    y_at = np.arange(reps.sum()) + np.repeat(first[xg] - np.cumsum(reps) + reps, reps)
    keys = np.repeat(xi, reps) << 20 | yi[y_at]
    if xn is None:
        keys, n = np.unique(keys, return_counts=True)
    else:
        keys, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, weights=np.repeat(xn, reps) * yn[y_at]).astype(np.int64)
    return keys >> 20, keys & ((1 << 20) - 1), n


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _each(batches, a_path: str, b_path: str, piece: int):
    """For each batch its row and id columns, and for each row (A ids, B ids, A ends, group ends in A, in B) or None without tokens."""
    both = pair(a_path, b_path)
    for batch in batches:
        rows = []
        for a, b in both.tokens(batch.column(2).to_pylist()):
            if not a:
                rows.append(None)
                continue
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_ends = np.cumsum(both.a_size[a])
            rows.append((a, b, a_ends, *align(a_ends, np.cumsum(both.b_size[b]), piece)))
        yield both, batch, rows


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(row, id, group, start, end, a_ids, b_ids): one row per group, its bytes counted in a space and the text."""
    src = _texts(docs, id_col, text_col)
    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([*src.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("group", "start", "end")],
                        T.StructField("a_ids", ints), T.StructField("b_ids", ints)])

    def run(batches):
        for _, batch, rows in _each(batches, a_path, b_path, piece):
            for k, r in enumerate(rows):
                if r is None:
                    continue
                a, b, a_ends, ga, gb = r
                n, ends = len(ga), a_ends[ga - 1]
                cuts = [pa.ListArray.from_arrays(pa.array(np.append(0, g), pa.int32()), pa.array(x, pa.int32())) for g, x in ((ga, a), (gb, b))]
                same = pa.array(np.full(n, k), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(np.arange(n)),
                                                  pa.array(np.append(0, ends[:-1])), pa.array(ends), *cuts], names=out.names)

    return map_batches(src, run, out)


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) for every row; ``pairs`` are its distinct linked (a, b) with their number of links."""
    src = _texts(docs, id_col, text_col)
    link = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("links", T.LongType())])
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    out = T.StructType([*src.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in numbers],
                        T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(link))])

    def run(batches):
        none = (0, 0, 0, 0, "", *[np.empty(0, np.int64)] * 3)
        for both, batch, rows in _each(batches, a_path, b_path, piece):
            cols = []
            for r in rows:
                if r is None:
                    cols.append(none)
                    continue
                a, b, _, ga, gb = r
                x, y, n = linked_pairs(a, b, ga, gb)
                cols.append((len(a), len(b), len(ga), int(n.sum()), hashlib.sha256(both.group_text(a, b, ga, gb).encode()).hexdigest(), x, y, n))
            c = list(zip(*cols)) or [()] * 8
            flat = [np.concatenate([np.empty(0, np.int64), *p]) for p in c[5:]]
            ends = np.cumsum([0, *[len(p) for p in c[5]]])
            pairs = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2])], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in c[:4]], pa.array(c[4], pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=out.names)

    return map_batches(src, run, out)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, n, best): how many rows hold each pair linked, and whether that is the most of its A id."""
    counts = texts.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # at most B's vocabulary in a window


def common_from(counts: DataFrame, head: int = HEAD) -> int:
    """The least power of two so that at most ``head`` pairs are held by as many rows."""
    sizes = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and (total := total + sizes.get(least - 1, 0)) <= head:
        least -= 1
    return 1 << least


def report(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, piece: int = PIECE) -> DataFrame:
    texts = stored(linked(docs, a_path, b_path, piece=piece), "linked-pairs")
    counts = stored(pair_counts(texts), "pair-counts")
    least = common_from(counts, head)
    rows = texts.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.links")
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("n")).alias("total")]
    known = rows.join(F.broadcast(counts.where(F.col("n") >= least)), ["a", "b"], "left")
    common = known.where("n IS NOT NULL").groupBy("row").agg(*sums)
    if least > 1:
        rare = known.where("n IS NULL").select("row", "a", "b", "links").join(counts.where(F.col("n") < least).hint("shuffle_merge"), ["a", "b"])
        common = common.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    zero = F.lit(0).cast("long")
    return (texts.drop("pairs").join(common, "row", "left")
            .select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", zero).alias("n_best"),
                    F.coalesce("total", zero).alias("count_sum"), "groups_sha256"))
