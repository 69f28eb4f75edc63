"""WARC archives: round trips, revisits, framing and damage."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc

LONG = "<p>ünï</p>" * 400
PAGES = [
    (1, "http://a.example/1", LONG), (5, "http://a.example/5", LONG), (3, None, LONG), (None, "http://b.example/none", LONG), (5, "http://a.example/5b", LONG), (5, "http://a.example/5b", LONG),
    (7, "http://c.example/\r\nX-Evil: 1 ☃", "short"), (8, "http://c.example/8", "short"), (9, "u", None), (10, "u", ""), (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000),
    (15, "u", "z" * 3_000_000), (16, "u", "\r\n\r\nWARC/1.1\r\n\r\n\x00" * 90), (None, "n", "q" * 2000), (None, "n", "q" * 2000), (17, "u", "r" * 2000), (None, "v", "r" * 2000),
]
SCHEMA = "page_id long, url string, html string, key string, body int"


def want(pages):
    top = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        first = top.get(h) if len(body) >= 1000 else None
        again = first is not None and i != first
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages, folder, **more):
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], SCHEMA)
    archives = warc.write(df.repartition(3), folder, **more)
    path = f"{folder}-records"
    warc.read(archives, payloads=True).write.parquet(path)
    return archives, spark.read.parquet(path)


def test_round_trip(spark, tmp_path):
    archives, found = round_trip(spark, PAGES, f"file://{tmp_path}/w", archive_bytes=1500)
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES) and archives.count() > 3
    got = warc.resolved(found).collect()
    assert sorted(((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(PAGES)
    assert all(r.digests_agree and r.error is None and r.record_id.startswith("<urn:uuid:") for r in got)
    texts = {(i, u): (h or "") for i, u, h in PAGES}
    for r in got:
        if r.record_type == "response" and r.source_id != 7:
            assert r.payload.decode() == texts[r.source_id, r.target_uri]
    assert {r.target_uri for r in got if r.source_id == 7} == {"http://c.example/%0D%0AX-Evil:%201%20☃"}
    binary = spark.read.format("binaryFile").load([r.path for r in archives.collect()])
    assert warc.read(binary.select("path", "content")).count() == len(PAGES)


def test_members_are_records(spark, tmp_path):
    archives, _ = round_trip(spark, PAGES, f"file://{tmp_path}/w")
    for r in archives.collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes
        at = [x["offset"] for x in warc.records(io.BytesIO(data).read)]
        assert len(at) == r.records
        for a, b in zip(at, [*at[1:], len(data)], strict=True):
            text = gzip.decompress(data[a:b])
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert [x["payload_sha1"] for x in warc.records(io.BytesIO(gzip.decompress(data)).read)] == [x["payload_sha1"] for x in warc.records(io.BytesIO(data).read)]  # without members, or in one


def test_empty(spark, tmp_path):
    archives, found = round_trip(spark, [], f"file://{tmp_path}/w")
    assert archives.count() == 0 and warc.resolved(found).count() == 0


def test_reads_by_small_steps():
    rows = [warc.page_record(k, f"u{k}", b"z" * (50_000 * k), None, "2024-01-01T00:00:00Z") for k in range(12)]
    data = io.BytesIO(b"".join(rows))
    found = list(warc.records(lambda n: data.read(min(n, 7)), payloads=True))
    assert [len(r["payload"]) for r in found] == [50_000 * k for k in range(12)]
    bomb = b"".join([warc.record({"WARC-Type": "resource", "WARC-Record-ID": "x"}, bytes(20_000_000))])
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(bomb).read)] == [20_000_000]


def test_damage():
    rows = [warc.page_record(k, "u", f"page {k} ".encode() * 100, None, "2024-01-01T00:00:00Z") for k in range(6)]
    bad = bytearray(rows[2])
    bad[40:60] = bytes(20)
    data = b"".join([rows[0], rows[1], bytes(bad), *rows[3:]])
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data).read))
    found = list(warc.records(io.BytesIO(data).read, strict=False))
    ids = [int(r["fields"]["x-source-id"]) for r in found if not r["error"]]
    assert ids == [0, 1, 3, 4, 5] and sum(r["error"] is not None for r in found) == 1
    cut = list(warc.records(io.BytesIO(b"".join(rows)[:-9]).read, strict=False))
    assert [r["error"] is not None for r in cut] == [False] * 6 + [True]  # the last record is whole, its member is not
    half = list(warc.records(io.BytesIO(b"".join(rows)[:-60]).read, strict=False))
    assert [r["error"] is not None for r in half] == [False] * 5 + [True]
    wrong = warc.record({"WARC-Type": "resource", "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"body")
    assert next(warc.records(io.BytesIO(wrong).read, strict=False))["error"] == "a digest differs"
    other = warc.record({"WARC-Type": "resource", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"body").hexdigest()}, b"body")
    assert next(warc.records(io.BytesIO(other).read))["digests_agree"] is True
    assert list(warc.records(io.BytesIO(b"junk, no archive\n").read, strict=False))[0]["error"]
    assert list(warc.records(io.BytesIO(b"").read)) == []


def test_missing_response(spark, tmp_path):
    _, found = round_trip(spark, PAGES[:3], f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="no such response"):
        warc.resolved(found.filter("record_type = 'revisit'")).collect()
