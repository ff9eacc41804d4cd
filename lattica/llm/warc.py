"""Op 4: WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing: SHA-1 digests are made by Spark; of equal payloads the least page id is the response and the
others are revisits of it (HTTP header only). Only ids and digests are shuffled, and staged for that;
what is found to revisit is broadcast where it is few rows, else joined. Records are gzip members of
archives of about `ARCHIVE` bytes.

Reading: a file is walked member by member (or version line by version line, where not compressed); a
member may hold several records. A record counts if its gzip CRC, header, length, closing and digests
hold (SHA-1, SHA-256, SHA-512 and MD5, in base32 or hexadecimal; other algorithms are taken on trust).
Otherwise the reader searches the next member magic or version line that starts a valid record, goes on
there, and logs the bytes between as a quarantined gap. Members are unpacked in pieces and the ends of
headers are looked up once, so time grows with the file, not with its square; a member may be of any
length that memory holds, as its file is.

Defined cases: null payload is empty; null page ids become an empty id, and such a row is a revisit if
another row with an id has its payload, else a response; rows that repeat the response's id and
payload are responses too; url may be null (empty); very long payloads are written and read whole, an
archive each; other columns are not carried, whatever their names; empty tables give empty archives and
results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, few, slices, staged

ARCHIVE, PIECE = 4 << 20, 1 << 16
END = b"\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.[0-9]+\r\n")
LENGTH = re.compile(rb"[0-9]{1,18}")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Rows page_id, url, payload, digest, refers_to (null: a response). Payloads below `least` bytes are all responses."""
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    thin = staged(rows.filter(F.octet_length("payload") >= least).select("page_id", "digest", F.octet_length("payload").alias("n")), "warc-digests")
    first = thin.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    again = thin.join(few(first, "warc-first"), ["digest", "n"]).filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = few(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct(), "warc-revisits")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def record_id(page_id) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def record(page_id, url: bytes, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A WARC/1.1 record; its block is an HTTP answer, of a revisit only the header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = (b"response", http + payload) if refers_to is None else (b"revisit", http)
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + re.sub(rb"\s", b"%20", url), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: " + record_id(refers_to), b"WARC-Profile: " + PROFILE, b"WARC-Block-Digest: sha1:" + b32encode(hashlib.sha1(block).digest())]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + END + block + END


def member(data: bytes) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_batches(size: int, compress: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, held, length = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            name = f"part-{part:06d}-{n:06d}.warc" + ".gz" * compress
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])

        for batch in slices(batches, 64):
            columns = [batch.column(i).to_pylist() for i in (0, 3, 4)]
            for page_id, digest, refers_to, url, payload in zip(*columns, as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                one = record(page_id, url, payload, digest, refers_to)
                held.append(member(one) if compress else one)
                length += len(held[-1])
                if length >= size:
                    yield archive()
                    n, held, length = n + 1, [], 0
        if held:
            yield archive()

    return run


def write_archives(planned: DataFrame, size: int = ARCHIVE, compress: bool = True) -> DataFrame:
    """Archives (name, content), written to the shared folder and read again."""
    return staged(planned.mapInArrow(write_batches(size, compress), "name string, content binary"), "warc")


def same_digest(told: str, data: bytes) -> bool:
    """Does data have the labelled digest? Labels of unknown algorithms and other codings say nothing against it."""
    name, colon, value = told.rpartition(":")
    name = (name if colon else "sha1").lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(name, data, usedforsecurity=False).digest()
    return value.upper().rstrip("=") in (b32encode(own).decode().rstrip("="), own.hex().upper())


class Finder:
    """Places of a mark in data, each looked for once however often it is asked for from before it."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.asked, self.at = data, mark, 0, data.find(mark)

    def after(self, at: int) -> int:
        """The first place at or after `at`, -1 if there is none."""
        if not (self.asked <= at and (self.at < 0 or at <= self.at)):
            self.asked, self.at = at, self.data.find(self.mark, at)
        return self.at


def parse(data: bytes, at: int, alone: bool, ends: Finder) -> tuple[dict, int] | str:
    """The record at a version line of data and its end, or why it is none. alone: data is a member's, and nothing else."""
    head_end = ends.after(at)
    if head_end < 0:
        return "header does not end"
    lines = data[at:head_end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/[01]\.[0-9]+", lines[0]):
        return "no version line"
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        head[name.strip().lower().decode("latin-1")] = value.strip()
    if not LENGTH.fullmatch(head.get("content-length", b"")):
        return "no content length"
    start = head_end + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != END:
        return "length and closing disagree"
    if alone and end + 4 != len(data) and not START.match(data, end + 4):
        return "bytes after the record"
    block = data[start:end]
    own = head.get("warc-block-digest", b"").decode("latin-1")
    if own and not same_digest(own, block):
        return "block digest differs"
    http, _, payload = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    kind = head.get("warc-type", b"").decode("latin-1")
    told = head.get("warc-payload-digest", b"").decode("latin-1")
    if kind == "response" and told and not same_digest(told, payload):
        return "payload digest differs"
    # Where no digest vouches for the length, another record or the end must follow.
    if not (alone or own or told and kind == "response" or end + 4 == len(data) or START.match(data, end + 4)):
        return "no record after this one"
    size = int(fields[b"content-length"]) if kind == "revisit" and LENGTH.fullmatch(fields.get(b"content-length", b"")) else len(payload)
    digest = told.removeprefix("sha1:") if told else b32encode(hashlib.sha1(payload).digest()).decode()
    return {"type": kind, "id": head.get("warc-record-id", b"").decode("latin-1"), "url": head.get("warc-target-uri", b"").decode("utf-8", "replace"), "digest": digest, "refers_to": head["warc-refers-to"].decode("latin-1") if "warc-refers-to" in head else None, "payload": payload, "payload_bytes": size}, end + 4


def unpacked(data: bytes, at: int) -> tuple[bytes, int] | str:
    """What the gzip member at `at` holds, and its end; or why it is none."""
    unpack, out = zlib.decompressobj(31), []
    try:
        while at < len(data):
            piece = data[at : at + PIECE]
            out.append(unpack.decompress(piece))
            at += len(piece)
            if unpack.eof:
                return b"".join(out), at - len(unpack.unused_data)
    except zlib.error as e:
        return f"member: {e}"
    return "member does not end"


def attempt(data: bytes, at: int, ends: Finder) -> tuple[list[dict], int] | str:
    """The records at `at` (one, or a member's), and their end; or why there are none."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        got = parse(data, at, False, ends)
        return got if isinstance(got, str) else ([got[0]], got[1])
    got = unpacked(data, at)
    if isinstance(got, str):
        return got
    raw, end = got
    records, place, inner = [], 0, Finder(raw, END)
    while place < len(raw):
        one = parse(raw, place, True, inner)
        if isinstance(one, str):
            return one
        records.append(one[0])
        place = one[1]
    return (records, end) if records else "member is empty"


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """('record', start, end, record) and ('gap', start, end, reason) in order; together they cover data. Records of a member share its bounds."""
    at, gap, reason, ends = 0, None, "", Finder(data, END)
    while at < len(data):
        got = attempt(data, at, ends)
        if isinstance(got, str):
            if gap is None:
                gap, reason = at, got
            # The next place that might start a record; attempt() then decides.
            found = START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for one in got[0]:
            yield "record", at, got[1], one
        at = got[1]
    if gap is not None:
        yield "gap", gap, len(data), reason


READ = "name string, kind string, start long, end long, reason string, record_type string, record_id string, url string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def read_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    fields = [("name", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for batch in slices(batches, 1):
        name, content = batch.column(0)[0].as_py(), batch.column(1)[0].as_py() or b""
        rows, held = [], 0
        for kind, start, end, what in salvage(content):
            if kind == "gap":
                rows.append((name, kind, start, end, what, None, None, None, None, None, None, None))
            else:
                rows.append((name, kind, start, end, None, what["type"], what["id"], what["url"], what["digest"], what["refers_to"], what["payload_bytes"], what["payload"]))
                held += len(what["payload"])
            if held > ARCHIVE:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)


def read_archives(archives: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Records (kind 'record') and quarantined gaps (kind 'gap') of archives, e.g. of binaryFile (path, content)."""
    return archives.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(read_batches, READ)


def op4_salvage(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    got = read_archives(write_archives(plan(pages))).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP4_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, sha1(b) x from p),
w as (select *, min(page_id) over (partition by x, n) f from h),
g as (select *, list_transform([1, 11, 21, 31], lambda i: cast('0x' || substr(x, i, 10) as bigint)) parts from w)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(parts, lambda q: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((q >> s) & 31 as integer) + 1, 1)), '')), '') as payload_digest,
       case when page_id = f then 'response' else 'revisit' end as record_type,
       case when page_id = f then null else f end as refers_to
from g
"""
