import io
import zipfile

import pytest

from lexiflow.llm import warc_zip


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, at, n):
        return self.data[at:at + n]


def archive(members, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment"])
def test_directories(monkeypatch, limit, comment):
    if limit:  # every size and offset goes to the ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    members = {"archive/data.warc.gz": b"x" * 100, "indexes/index.cdxj": b"y" * 50, "gr\u00fc\u00df": b"z"}
    data = archive(members, comment)
    assert (b"PK\x06\x06" in data) == bool(limit)
    f = Bytes(data)
    found = warc_zip.directory(f)
    assert {k: f.read(warc_zip.stored_start(f, m), m[1]) for k, m in found.items()} == members


def test_broken_archives():
    with pytest.raises(ValueError):
        warc_zip.directory(Bytes(b"not a zip"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", "x" * 1000)
    f = Bytes(out.getvalue())
    with pytest.raises(ValueError):
        warc_zip.stored_start(f, warc_zip.directory(f)["archive/data.warc.gz"])


def test_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (None, "u", "same"), (5, "u", "é\r\n\r\nbody"), (5, "u", "é\r\n\r\nbody")]
    got = warc_zip.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {(r["id"], r["url"]): r for r in got}
    assert len(got) == len(rows)
    assert (by[1, "http://a/1"]["record_type"], by[1, "http://a/1"]["refers_to"]) == ("revisit", 2)
    assert (by[None, "u"]["record_type"], by[None, "u"]["refers_to"]) == ("revisit", 2)
    assert by[2, "http://a/2"]["payload"] == b"same" and by[1, "http://a/1"]["payload_bytes"] == 4
    assert by[3, None]["refers_to"] == 4 and by[3, None]["payload_digest"] == warc_zip.sha1_base32(b"")
    assert [bytes(r["payload"]).decode() for r in got if r["id"] == 5] == ["é\r\n\r\nbody"] * 2


def test_many_small_archives(spark, monkeypatch):
    rows = [(i, f"http://a/{i}", f"body {i % 40}") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    digests = warc_zip.with_digests(df, "page_id", "html", "url", least_bytes=7).collect()
    assert sum(r["record_type"] == "revisit" for r in digests) == sum(len(f"body {i % 40}") >= 7 for i in range(60))
    got = warc_zip.round_trip(df).collect()
    assert {r["id"] for r in got if r["record_type"] == "response"} == set(range(60, 100))
