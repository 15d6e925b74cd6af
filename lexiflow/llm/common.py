"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.session import checkpoint_dir
from lexiflow.sources.tables import read_table

#: Rows and bytes of an Arrow batch given to a Python worker: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, name).select(*cols)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later
    plans scan only the columns they need, and a lost executor costs a re-read."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fits(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether the files of ``df``, a stored table, have at most ``limit`` bytes, by Spark's own estimate of a scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def first_by_hash(df: DataFrame, n: int, *cols: str, total: int | None = None) -> DataFrame:
    """At most ``n`` rows of ``df``, whose ``cols`` are distinct, in the order of a hash of ``cols``.  Of a long table only about 1.2 times as
    many rows are sorted at all: those whose hash is under a bound that the number of rows gives."""
    total, hashed = df.count() if total is None else total, F.xxhash64(*cols)
    share = (1.2 * n + 1000) / max(total, 1)
    if share < 1:
        df = df.where(hashed < int(share * 2.0**64 - 2.0**63))
    return df.orderBy(hashed, *cols).limit(n)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema)],
                                      schema=schema)


def scan_spans(df: DataFrame, id_col: str, text_col: str, find: Callable[[], Callable[[str], list[tuple[str, int, int, bool]]]]) -> DataFrame:
    """(id, spans) for every row, null text read as empty.

    ``find()`` runs once in each task and gives the function from a text to its
    (kind, start, end, base) spans in code points.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("spans", SPANS)])

    def run(batches):
        spans_of = find()
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans_of(x or "")] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["id", "spans"])

    return map_batches(src, run, out)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def span_digest(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts per kind and digest columns of the spans made by ``scan_spans``:
    by start, then kind in the order of ``kinds`` (others after them, by end)."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])

    def joined(keep=None):
        s = F.filter("spans", keep) if keep else F.col("spans")
        s = F.array_sort(F.transform(s, lambda x: F.struct(
            x["start"].alias("start"), F.coalesce(F.element_at(order, x["kind"]), F.lit(len(kinds))).alias("o"),
            x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = lambda x: x["base"]
    of = lambda k: lambda x: x["base"] & (x["kind"] == k)
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                     joined().alias("spans"))
