"""Byte-level BPE encoding and decoding by a ranks file.

Each match of the pattern is merged on its own.  A segment tree over the byte
positions of the match stores the smallest rank of a live pair in each span;
the leftmost leaf holding the root's minimum is the next merge, and a merge
makes at most three point updates (the merged pair, its left neighbour, the
part that went away), each logarithmic in the match's length.  A match of n
bytes so costs O(n log n), also where a text is one word of 100,000 letters.

Frequent matches are remembered in a bounded two-generation table per task;
the table changes the time, never the result.

Nulls: a null text is read as empty and has no ids; null ids decode to no
bytes.  Empty tables give empty results; every input row gives one row, so
repeated rows stay repeated.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import map_batches

NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost pair of least rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i:i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # of the live part that starts here, which is where the next one starts
    prev = list(range(-1, n - 1))

    def put(i: int, v: int) -> None:
        i += size
        tree[i] = v
        while i > 1:
            other = tree[i ^ 1]
            low = v if v <= other else other
            i >>= 1
            if tree[i] == low:
                return
            tree[i] = v = low

    while tree[1] != NONE:
        low, i = tree[1], 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = end[i]
        end[i] = k = end[j]
        put(j, NONE)
        if k < n:
            prev[k] = i
            put(i, get(piece[i:end[k]], NONE))
        else:
            put(i, NONE)
        if (p := prev[i]) >= 0:
            put(p, get(piece[p:k], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Merger:
    """``merge_ranks`` for many matches of up to ``longest`` bytes at once: one
    row of a two-dimensional array holds the segment tree of one match, and each
    round merges the leftmost least pair of every row that still has one."""

    def __init__(self, ranks: dict[bytes, int], longest: int = 64):
        self.ranks, self.longest = ranks, longest
        self.none = none = np.int32(2**31 - 1)
        pairs, merged = array("q"), array("i")  # each pair makes one word, so none comes twice
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.merged = np.append(np.array(merged, np.int32)[order], none)
        self.own = {i: i for i in ranks.values()}  # one object for each id
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def pair_rank(self, a, b):
        k = a << 32 | b
        at = np.searchsorted(self.keys, k)
        return np.where(self.keys[at] == k, self.merged[at], self.none)

    def many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each match; the matches have at most ``longest`` bytes."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = (r,)
            else:
                by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, rows in by_size.items():
            for i, ids in zip(rows, self._same_size([pieces[i] for i in rows], size)):
                out[i] = ids
        return out

    def _same_size(self, pieces: list[bytes], size: int):
        k, none = len(pieces), self.none
        n = np.fromiter(map(len, pieces), np.int64, k)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(k, size)
        ids = self.byte[raw].reshape(-1)
        pos = np.arange(size)
        tree = np.full((k, 2 * size), none, np.int32)
        grid = ids.reshape(k, size)
        tree[:, size:2 * size - 1] = np.where(pos[None, 1:] < n[:, None], self.pair_rank(grid[:, :-1], grid[:, 1:]), none)
        node = size
        while node > 1:
            node //= 2
            tree[:, node:2 * node] = np.minimum(tree[:, 2 * node:4 * node:2], tree[:, 2 * node + 1:4 * node:2])
        tree = tree.reshape(-1)
        after = np.tile(pos + 1, k)  # start of the part after the live part that starts here
        before = np.tile(pos - 1, k)
        live = np.ones(k * size, bool)
        rows = np.arange(k)
        while True:
            low = tree[rows * (2 * size) + 1]
            keep = low != none
            rows, low = rows[keep], low[keep]
            if not len(rows):
                break
            at_tree, at, last = rows * (2 * size), rows * size, n[rows]
            node = np.ones(len(rows), np.int64)
            while node[0] < size:
                node *= 2
                node += tree[at_tree + node] != low
            i = node - size
            j = after[at + i]
            nxt = after[at + j]
            ids[at + i] = low
            live[at + j] = False
            after[at + i] = nxt
            inner = nxt < last
            before[(at + nxt)[inner]] = i[inner]
            tree[at_tree + size + j] = none
            right = np.full(len(rows), none, np.int32)
            right[inner] = self.pair_rank(ids[(at + i)[inner]], ids[(at + nxt)[inner]])
            tree[at_tree + size + i] = right
            p = before[at + i]
            has = p >= 0
            tree[(at_tree + size + p)[has]] = self.pair_rank(ids[(at + p)[has]], ids[(at + i)[has]])
            p = np.where(has, p, i)
            nodes = [size + i, size + j, size + p]
            level = size
            while level > 1:
                level //= 2
                for m in nodes:
                    m >>= 1
                    up = at_tree + 2 * m
                    tree[at_tree + m] = np.minimum(tree[up], tree[up + 1])
        live &= np.tile(pos, k) < np.repeat(n, size)
        counts = live.reshape(k, size).sum(1)
        flat, a = ids[live].tolist(), 0
        for c in counts.tolist():
            yield tuple(map(self.own.__getitem__, flat[a:a + c]))
            a += c


class Encoder:
    """Texts -> ids.  Up to ``2 * most`` matches are remembered; those that a
    batch of texts adds are merged together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 100_000, longest: int = 64):
        import regex

        self.ranks, self.most, self.longest = ranks, most, longest
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.find, self.merger = regex.compile(pattern).findall, Merger(ranks, longest)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def learn(self, new: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of matches that ``known`` lacks; returns those too long to remember."""
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        known, older, fresh, long = self.known, self.older, [], {}
        for p in new:
            if (ids := older.get(p)) is not None:
                known[p] = ids
            elif len(p) <= self.longest and len(b := p.encode()) <= self.longest:
                fresh.append((p, b))
            else:
                long[p] = tuple(merge_ranks(p.encode(), self.ranks))
        for (p, _), ids in zip(fresh, self.merger.many([b for _, b in fresh])):
            known[p] = ids
        return long

    def encode_many(self, texts: list[str], most_chars: int = 1 << 20) -> list[list[int]]:
        """Ids of each text; texts are taken together up to ``most_chars``, which bounds the memory for their matches."""
        out, group, chars = [], [], 0
        for x in texts:
            if group and chars + len(x) > most_chars:
                out += self._encode_group(group)
                group, chars = [], 0
            group.append(x)
            chars += len(x)
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[list[int]]:
        found = [self.find(x) for x in texts]
        known = self.known
        new = set()
        for pieces in found:
            new.update(pieces)
        new.difference_update(known)
        before = known
        long = self.learn(new)
        if self.known is not before:  # the older generation keeps what this batch still needs
            known = {**self.older, **self.known}
        if long:
            known = {**known, **long}
        return [[i for p in pieces for i in known[p]] for pieces in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def encoder(path: str, pattern: str) -> Encoder:
    """A task's encoder; it goes with the task, so idle workers hold no memory."""
    return Encoder(load_ranks(path), pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row; with ``decoded`` also the bytes that the ids decode to."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                        *[T.StructField("decoded", T.BinaryType())] * decoded])

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for b in batches:
            ids = enc.encode_many([x or "" for x in b.column(1).to_pylist()])
            cols = [b.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if decoded:
                cols.append(pa.array([enc.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][:len(cols)])

    return map_batches(src, run, out)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded`` (binary): the bytes of the ids.
    A column of that name in ``df`` is replaced; an id without bytes is an error."""
    src = df.drop("decoded")
    out = T.StructType([*src.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = src.columns.index(ids_col)

    def run(batches):
        text_of = {i: b for b, i in load_ranks(ranks_path).items()}
        for b in batches:
            ids = b.column(at)
            data = [b"".join([text_of[i] for i in x]) for x in (ids[k].as_py() or () for k in range(len(ids)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "decoded"])

    return map_batches(src, run, out)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded texts."""
    rows = encode(df, ranks_path, pattern, decoded=True)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
