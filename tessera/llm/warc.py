"""WARC archives: a writer that deals pages to many archives, and a sequential reader.

Each record is a gzip member of its own. Of records with equal payloads of at least `min_bytes` the one with the largest id is a
response, and the others are revisits that refer to it and carry no payload. Payloads are told apart by their SHA-256, ids alone
meet in the aggregate, and a payload is moved at most once.

Archives are written by the tasks that hold the pages, under names that no other attempt uses; the manifest, a table that
Spark commits, names those that count, so a repeated task adds nothing. The reader takes an archive as a stream: bytes are
inflated as they come, a record is framed by its Content-Length, digests are summed up while the block passes, and only a
payload that is asked for is held. Archives come as paths, or with their content as a column where only Spark can open them.

Nulls and edge cases: a null payload is empty; a null id or URL is left out of the header and read back as null; a null id is
smaller than any other, and rows that repeat the largest id of a payload are all responses, under one record id. Line ends and
other control characters in a URL are percent-encoded. Other columns are not written. An empty table gives an empty manifest.
A damaged member, a wrong length or a wrong digest is an error; without `strict` it is a row with `error`, and the reader
goes on at the next member that can be read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: Field that this writer adds for the row's id.
ID_FIELD = "X-Source-Id"

ARCHIVE_BYTES = 1 << 28
CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"


def record_id(id_: int | None, payload_sha1: str) -> str:
    """A URN that both a response and those that refer to it can work out."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{id_}:{payload_sha1}'.encode()).digest()[:16], version=5)}>"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(fields: dict[str, str | None], block: bytes, level: int = 4) -> bytes:
    """A record as one gzip member. Fields without a value are left out."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}\r\n\r\n".encode()])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([pack.compress(head), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()])


def page_record(id_: int | None, url: str | None, payload: bytes, leader: int | None, date: str) -> bytes:
    """A page's response, or its revisit if another row, `leader`, is the response."""
    sha1 = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = leader is not None
    block = http if revisit else http + payload
    return record(
        {
            "WARC-Type": "revisit" if revisit else "response",
            "WARC-Record-ID": record_id(id_, sha1),
            "WARC-Date": date,
            "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
            ID_FIELD: None if id_ is None else str(id_),
            "WARC-Refers-To": record_id(leader, sha1) if revisit else None,
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Payload-Digest": _base32(sha1),
            "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest()),
            "Content-Type": HTTP,
        },
        block,
    )


class Damaged(Exception):
    pass


class Members:
    """The bytes under a row of gzip members (or plain bytes), read from front to back and inflated as they come."""

    def __init__(self, read: Callable[[int], bytes]):
        self._read, self.raw, self.at, self.buffer = read, b"", 0, bytearray()  # at: offset of raw in the archive
        self.unzip, self.full, self.plain, self.ended = None, False, False, False
        self.start = 0  # offset of the member that is read last

    def _more(self) -> bool:
        """Inflates some more; False at the end of the archive."""
        if not self.raw and not self.full:
            self.raw = bytes(self._read(CHUNK))
            if not self.raw:
                self.ended = True
                if self.unzip is not None:
                    self.unzip = None
                    raise Damaged("the archive ends inside a member")
                return False
        if self.unzip is None:
            if len(self.raw) < 2:
                self.raw += bytes(self._read(CHUNK))
            packed = self.raw[:2] == MAGIC[:2]
            if not self.at:
                self.plain = not packed
            if not self.plain:
                self.start = self.at
                if not packed:
                    raise Damaged("no gzip member begins here")
                self.unzip = zlib.decompressobj(31)
        if self.plain:
            self.buffer += self.raw
            self.at, self.raw = self.at + len(self.raw), b""
            return True
        try:
            some = self.unzip.decompress(self.raw, 4 * CHUNK)
        except zlib.error as wrong:
            raise Damaged(f"a gzip member cannot be inflated: {wrong}") from None
        self.buffer += some
        self.full = len(some) == 4 * CHUNK  # there may be more, without further input
        left = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        self.at, self.raw = self.at + len(self.raw) - len(left), left
        if self.unzip.eof:
            self.unzip, self.full = None, False
        return True

    def line(self, most: int = 1 << 20) -> bytes:
        """Up to and with the next line end; empty at the end of the archive."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if seen > most:
                raise Damaged("a header line has no end")
            if not self._more():
                break
        end = end + 1 if end >= 0 else len(self.buffer)
        out = bytes(self.buffer[:end])
        del self.buffer[:end]
        return out

    def some(self, most: int) -> bytes:
        """Up to most bytes, at least one."""
        while not self.buffer:
            if not self._more():
                raise Damaged("the archive ends inside a record")
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out

    def resume(self) -> bool:
        """After damage: goes to the next place that looks like a member's start; False if there is none."""
        self.buffer.clear()
        skip = 1 if self.at <= self.start else 0
        self.unzip, self.full = None, False
        while not self.ended:
            found = self.raw.find(MAGIC, skip)
            if found >= 0:
                self.at, self.raw = self.at + found, self.raw[found:]
                return True
            keep = min(2, len(self.raw))
            self.at, self.raw = self.at + len(self.raw) - keep, self.raw[len(self.raw) - keep :]
            skip = 0
            more = bytes(self._read(CHUNK))
            self.ended = not more
            self.raw += more
        return False


class _Digests:
    """Running digests of what passes."""

    def __init__(self, named: str | None):
        self.named, self.sha1, self.size = named, hashlib.sha1(usedforsecurity=False), 0
        kind = (named or "").partition(":")[0].lower().replace("-", "")
        self.other = hashlib.new(kind) if kind != "sha1" and kind in hashlib.algorithms_available and not kind.startswith("shake") else None

    def update(self, some: bytes) -> None:
        self.size += len(some)
        self.sha1.update(some)
        if self.other is not None:
            self.other.update(some)

    def agrees(self) -> bool | None:
        """Whether the named digest is this one; None if none is named that is known."""
        kind, _, value = (self.named or "").partition(":")
        if not value or (kind.lower() != "sha1" and self.other is None):
            return None
        own = (self.other or self.sha1).digest()
        return value.strip().lower() in (own.hex(), base64.b32encode(own).decode().lower().rstrip("="), base64.b32encode(own).decode().lower())


def _hex(digest: str | None) -> str | None:
    """The SHA-1 that a header names, as hex."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    out, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if last is not None and text[:1] in (" ", "\t"):
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records(read: Callable[[int], bytes], payloads: bool = False, strict: bool = True) -> Iterator[dict]:
    """The records of an archive in order: offset, fields (names in lower case), block_bytes, payload_bytes, payload_sha1, digests_agree, payload, error."""
    members, lost = Members(read), None
    while True:
        try:
            first = members.line()
            if not first and members.ended:
                break
            if not first.strip():  # the two empty lines behind a record
                continue
            offset = members.at - len(members.buffer) - len(first) if members.plain else members.start
            if not first.startswith(b"WARC/"):
                raise Damaged("a record does not begin with its version")

            def header(source: Callable[[], bytes]) -> dict[str, str]:
                lines = []
                while (line := source()).strip():
                    lines.append(line)
                return _fields(iter(lines))

            fields = header(members.line)
            if not fields.get("content-length", "").isdigit():
                raise Damaged("a record has no length")
            left = int(fields["content-length"])
            block, payload = _Digests(fields.get("warc-block-digest")), _Digests(fields.get("warc-payload-digest"))
            http, head, held = fields.get("content-type", "").startswith("application/http"), bytearray(), []
            inside = not http
            while left:
                some = members.some(min(left, CHUNK))
                left -= len(some)
                block.update(some)
                if not inside:
                    head += some
                    end = head.find(b"\r\n\r\n")
                    if end < 0:
                        continue
                    some, head, inside = bytes(head[end + 4 :]), head[: end + 4], True
                payload.update(some)
                if payloads:
                    held.append(some)
            out = {"offset": offset, "fields": fields, "block_bytes": block.size, "payload_bytes": payload.size, "payload_sha1": payload.sha1.hexdigest(), "payload": b"".join(held) if payloads else None, "error": None}
            seen = [block.agrees()]
            if fields.get("warc-type") == "revisit":  # the payload is elsewhere: its size and digest are as the header says
                size = _fields(iter(bytes(head).split(b"\r\n"))).get("content-length", "")
                out |= {"payload_bytes": int(size) if size.isdigit() else None, "payload_sha1": _hex(fields.get("warc-payload-digest")), "payload": None}
            else:
                seen.append(payload.agrees())
            out["digests_agree"] = False if False in seen else (True if True in seen else None)
            if out["digests_agree"] is False:
                out["error"] = "a digest differs"
                if strict:
                    raise ValueError(f"offset {offset}: a digest differs")
            lost = None
            yield out
        except Damaged as wrong:
            if strict:
                raise ValueError(f"offset {members.start}: {wrong}") from None
            if lost is None:  # a stretch that cannot be read is one row
                lost = members.start
                yield {"offset": lost, "fields": {}, "block_bytes": None, "payload_bytes": None, "payload_sha1": None, "payload": None, "digests_agree": None, "error": str(wrong)}
            if not members.resume():
                break


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row below folder, a shared one, and returns the manifest (path, records, bytes) of the archives."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("body"))
    big = F.octet_length("body") >= min_bytes
    first = rows.filter(big).groupBy(F.sha2("body", 256).alias("_key")).agg(F.max("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # short payloads have keys that meet none and lie apart
    keyed = rows.withColumn("key", F.when(big, F.sha2("body", 256)).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "url").cast("string"))))
    marked = keyed.join(first, F.col("key") == F.col("_key"), "left")
    marked = marked.select("id", "url", "body", F.when(~F.col("leader").eqNullSafe(F.col("id")), F.col("leader")).alias("leader"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        out, path, done, sizes = None, None, [], [0, 0]
        try:
            for batch in batches:
                columns = [batch.column(k) for k in range(4)]
                for k in range(batch.num_rows):
                    if out is None:
                        path, sizes = f"{uuid.uuid4().hex}.warc.gz", [0, 0]
                        out = files.open_output_stream(f"{base}/{path}", compression=None)
                    member = page_record(*(c[k].as_py() for c in columns), date)
                    out.write(member)
                    sizes[0] += 1
                    sizes[1] += len(member)
                    if sizes[1] >= archive_bytes:
                        out.close()
                        out = None
                        done.append((path, *sizes))
            if out is not None:
                out.close()
                done.append((path, *sizes))
        except BaseException:
            if out is not None:
                out.close()
            for name in [path, *(d[0] for d in done)]:
                if name and files.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                    files.delete_file(f"{base}/{name}")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])
        give_back()

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    return Scratch(pages.sparkSession).table(marked.mapInArrow(run, "path string, records long, bytes long"), "archives")


_SCHEMA = "path string, offset long, record_id string, record_type string, date string, target_uri string, source_id long, refers_to_id string, content_type string, block_bytes long, payload_bytes long, payload_digest string, digests_agree boolean, fields map<string,string>, payload binary, error string"


def read(archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record of the archives: (path), or (path, content) as Spark's binaryFile gives them. An archive is read by one task, as a stream."""
    small_batches(archives.sparkSession)
    given = "content" in archives.columns
    columns = ["path", "content"] if given else ["path"]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = {"offset": pa.int64(), "source_id": pa.int64(), "block_bytes": pa.int64(), "payload_bytes": pa.int64(), "digests_agree": pa.bool_(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

    def row(path: str, r: dict) -> tuple:
        f = r["fields"]
        own = f.get(ID_FIELD.lower(), "")
        return (
            path, r["offset"], f.get("warc-record-id"), f.get("warc-type"), f.get("warc-date"), f.get("warc-target-uri"), int(own) if re.fullmatch(r"-?\d+", own) else None, f.get("warc-refers-to"),
            f.get("content-type"), r["block_bytes"], r["payload_bytes"], r["payload_sha1"], r["digests_agree"], list(f.items()), r["payload"], r["error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                if given:
                    stream = io.BytesIO(batch.column(1)[k].as_py() or b"")
                else:
                    files, name = fs.FileSystem.from_uri(path)
                    stream = files.open_input_stream(name, compression=None)
                with stream:
                    rows, held = [], 0
                    for r in records(stream.read, payloads, strict):
                        rows.append(row(path, r))
                        held += len(r["payload"] or b"")
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)
        give_back()

    rows = archives.select(*columns)
    if not given:
        rows = rows.repartition(max(1, archives.count()))  # the names alone are dealt out, an archive to a task
    return rows.mapInArrow(run, _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """records of read(), which should be a written table, with refers_to: the source id of the response that a revisit refers to. It must be there, with the same digest and size."""
    ours = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.max("source_id").alias("_source"), F.max("payload_digest").alias("_digest"), F.max("payload_bytes").alias("_bytes"))
    back = records.filter("record_type = 'revisit'").join(ours, F.col("refers_to_id") == F.col("_id"), "left")
    same = F.col("_digest").eqNullSafe(F.col("payload_digest")) & F.col("_bytes").eqNullSafe(F.col("payload_bytes"))
    back = back.withColumn("refers_to", F.when(same, F.col("_source")).otherwise(F.raise_error(F.concat(F.lit("a revisit has no such response: "), F.coalesce("record_id", F.lit(""))))))
    return records.filter("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(back.drop("_id", "_source", "_digest", "_bytes"))
