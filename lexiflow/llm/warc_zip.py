"""Web archives packaged as ZIP files: writing, and reading without extraction.

An archive file is a ZIP whose members are stored uncompressed:
``archive/data.warc.gz`` (one gzip member per WARC record) and
``indexes/index.cdxj`` (one JSON line per record with its offset and length in
the first).  The reader takes the end-of-central-directory record from the
file's tail, follows the ZIP64 locator where there is one, lists the central
directory, finds where each stored member starts, reads the indexes, and
fetches each record by a range read of the file.

Equal payloads of at least ``least_bytes`` bytes are stored once: the row with the
largest id holds the response, the others are revisit records that refer to it.
Rows with equal ids and payloads are each a response if they have that id.

Files go through ``pyarrow.fs`` at a URI in the shared folder, under a name that
is new in each task attempt; only the files named in the stored manifest of
finished tasks are read, so lost or repeated attempts leave no trace in the
result.

Nulls: a null payload is empty; a null id stays null (it is a response only if
no other row has its payload); a null address is left out of the record.  An
empty table makes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import batch, map_batches, shared_path, stored

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: A new archive file begins after so many records or payload bytes.
FILE_RECORDS, FILE_BYTES = 20_000, 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str):
    """(file system, path) of a URI or an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# --- records ----------------------------------------------------------------

def record(row: dict) -> bytes:
    """A WARC record as one gzip member."""
    revisit = row["record_type"] == "revisit"
    block = HTTP if revisit else HTTP + row["payload"]
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{'' if row['id'] is None else row['id']}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", row["payload_bytes"])]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> dict:
    """Header fields (lower-case names) and ``block`` of a gzipped WARC record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(out["content-length"])
    if len(rest) < n:
        raise ValueError("truncated WARC record")
    return out | {"block": rest[:n]}


# --- ZIP directories --------------------------------------------------------

class Range:
    """Range reads of one file of a file system."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("range beyond the end of the file")
        return data

    def close(self) -> None:
        self.file.close()


def directory(f) -> dict[str, tuple[int, int, int]]:
    """Member name -> (offset of its local header, compressed size, method).

    ``f`` has ``size`` and ``read(at, n)``.  Fields that hold the all-ones mark are taken from the ZIP64 records.
    """
    tail_at = max(0, f.size - 65_557)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HLL", tail, at + 10)
    place = tail_at + at - 20
    if place >= 0 and (locator := f.read(place, 20))[:4] == b"PK\x06\x07":
        end64 = f.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", end64, 32)
    data, out, p = f.read(start, size), {}, 0
    for _ in range(count):
        if data[p:p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, plain = struct.unpack_from("<LL", data, p + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, p + 28)
        local = struct.unpack_from("<L", data, p + 42)[0]
        name = data[p + 46:p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                if plain == 0xFFFFFFFF:
                    wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if local == 0xFFFFFFFF:
                    local = wide.pop(0)
            e += 4 + n
        out[name] = (local, packed, method)
        p += 46 + n_name + n_extra + n_comment
    return out


def stored_start(f, member: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    local, _, method = member
    if method != 0:
        raise ValueError("the member is compressed, not stored")
    head = f.read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return local + 30 + sum(struct.unpack_from("<HH", head, 26))


def index_entries(f) -> list[tuple[int, int]]:
    """(absolute offset, length) of every record named in the archive's indexes."""
    members = directory(f)
    starts = {k.rpartition("/")[2]: stored_start(f, v) for k, v in members.items() if k.startswith("archive/")}
    out = []
    for name, member in members.items():
        if name.startswith("indexes/"):
            for line in f.read(stored_start(f, member), member[1]).splitlines():
                e = json.loads(line[line.index(b"{"):])
                out.append((starts[e["filename"]] + e["offset"], e["length"]))
    return out


# --- Spark ------------------------------------------------------------------

def with_digests(df: DataFrame, id_col: str, payload_col: str, url_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("_sha", F.sha1("payload"))
    kept = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("_sha").alias("_k"))
            .agg(F.max("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    rows = rows.join(kept, F.col("_sha") == F.col("_k"), "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("id"))
    return rows.select("id", "url", "payload", "payload_bytes", "_sha",
                       F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("_first")).alias("refers_to"))


def write(df: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``with_digests`` to archives under ``folder``; returns
    the stored manifest (path, records)."""
    def run(batches):
        schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        state: dict = {}

        def begin():
            name = f"part-{uuid.uuid4().hex}.wacz"
            sink = store.open_output_stream(f"{base}/{name}")
            z = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
            state.update(name=name, sink=sink, zip=z, at=0, bytes=0, lines=[],
                         member=z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True))

        def finish():
            state["member"].close()
            state["zip"].writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(state["lines"]))
            state["zip"].close()
            state["sink"].close()
            n, name = len(state["lines"]), state["name"]
            state.clear()
            return batch(schema, [f"{folder}/{name}"], [n])

        for b in batches:
            for row in b.to_pylist():
                if not state:
                    begin()
                row["payload_digest"] = base64.b32encode(bytes.fromhex(row["_sha"])).decode()
                data = record(row)
                state["member"].write(data)
                entry = {"url": row["url"], "digest": f"sha1:{row['payload_digest']}", "offset": state["at"],
                         "length": len(data), "filename": WARC_MEMBER.rpartition("/")[2]}
                state["lines"].append(f"{row['id']} 19700101000000 {json.dumps(entry)}\n")
                state["at"] += len(data)
                state["bytes"] += len(row["payload"])
                if len(state["lines"]) >= FILE_RECORDS or state["bytes"] >= FILE_BYTES:
                    yield finish()
        if state:
            yield finish()

    return stored(map_batches(df, run, "path string, records long"), "warc-manifest")


def records(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record of the archives in ``manifest``."""
    def run(batches):
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in batches:
            for path in b.column(0).to_pylist():
                f = Range(path)
                try:
                    found = index_entries(f)
                finally:
                    f.close()
                for i in range(0, len(found), 4096):
                    part = found[i:i + 4096]
                    yield batch(schema, [path] * len(part), [x for x, _ in part], [x for _, x in part])

    return map_batches(manifest.select("path"), run, "path string, offset long, length long")


def read(entries: DataFrame, id_type: str = "long") -> DataFrame:
    """id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to of each
    record, by range reads.  A response whose payload differs from its digest is an error."""
    def run(batches):
        schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
        name, f = None, None
        urn = lambda x: x[len("<urn:page:"):-1] or None if x else None
        for b in batches:
            rows = []
            for path, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if path != name:
                    if f:
                        f.close()
                    name, f = path, Range(path)
                r = parse_record(f.read(at, n))
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                payload = None
                if r["warc-type"] == "response":
                    payload = r["block"].partition(b"\r\n\r\n")[2]
                    if sha1_base32(payload) != digest:
                        raise ValueError(f"digest mismatch at {path}:{at}")
                rows.append((urn(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], payload,
                             int(r["x-payload-length"]) if payload is None else len(payload), digest, urn(r.get("warc-refers-to"))))
            if rows:
                yield batch(schema, *map(list, zip(*rows)))
        if f:
            f.close()

    out = map_batches(entries.select("path", "offset", "length"), run,
                      "id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write every row as a record, then read all records back."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write(with_digests(pages, id_col, payload_col, url_col), folder)
    return read(records(manifest), pages.schema[id_col].dataType.simpleString())


def report(pages: DataFrame) -> DataFrame:
    return round_trip(pages).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What reading back must give, in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
