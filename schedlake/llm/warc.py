"""WARC archives with a two-level capture index.

Writing: every task writes its rows as gzip members of archive files of its own and returns where each
record lies.  Index: capture keys (host labels reversed, then the path, then the id) are range-partitioned
and sorted; each partition becomes a file of compressed blocks that ends with its block directory (first
key, offset and length of each block), and a catalogue holds the first key of each index file.
Look-ups come sorted by key: a task binary-searches catalogue, directory and block, and reads only the
blocks it needs.  The records found are read by byte ranges, archive by archive in order of offset.

Files go through pyarrow's file systems, so the folder is any URI those open (file, hdfs, s3, gs) or a
path; it must be shared by all executors.  A task that is run again writes files under new names, and only
files named in the finished table count, so lost executors leave unread files behind and nothing else.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, table, whole
from schedlake.session import shared_folder, written

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "file string, offset bigint, length bigint"


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _printable(text: str) -> str:
    """Without the characters that end a header or a field of the index."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def reversed_host(url: str | None) -> str:
    """``http://A.b.org:80/x?y#z`` as ``org,b,a:80)/x?y``; no URL as the empty key."""
    if not url:
        return ""
    rest = _printable(url.split("://", 1)[-1].split("#", 1)[0])
    at = re.search(r"[/?]|$", rest).start()
    host, _, port = rest[:at].rsplit("@", 1)[-1].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[at:] or "/")


def capture_key(url: str | None, row_id: int | None) -> str:
    """Sorts by reversed host, path and id; ids are shifted so that they sort as text, none comes first."""
    return f"{reversed_host(url)}\t{'' if row_id is None else f'{row_id + 2**63:020d}'}"


def record(row_id: int | None, url: str | None, payload: bytes, sha1_hex: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP head only."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    block = HTTP_HEAD + payload if response else HTTP_HEAD
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": name(row_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _printable(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if not response:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": name(refers_to),
        }
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; a damaged one raises."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block, end = rest[: int(head["Content-Length"])], rest[int(head["Content-Length"]) :]
    if version != "WARC/1.1" or end != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if head["WARC-Type"] == "response" and digest != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return head, payload


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    revisit_bytes: int = 0, file_bytes: int = 1 << 30,
) -> DataFrame:
    """Writes a record per row and returns (key, file, offset, length) of each, as a written table.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest id is a response
    and the others revisit it; smaller payloads are all responses.  A null body is empty.  Rows without an id are
    responses if no row of their group has one.  Repeated rows of a response are responses.  Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), whole(body_col).alias("body"))
    rows = rows.withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    groups = (
        rows.where(F.octet_length("body") >= revisit_bytes)
        .groupBy("sha1").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("sha1").alias("same"), "keep")
    )
    groups = written(groups, "warc-groups")
    dealt = rows.join(groups, (F.col("sha1") == F.col("same")) & (F.octet_length("body") >= revisit_bytes), "left").select(
        "id", "url", "body", "sha1", (F.col("same").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("response"), "keep"
    )
    schema = f"key string, {RECORD}"
    types = arrow_types(pages.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        fs.create_dir(root)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for row_id, url, body, sha1, response, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are packed one by one
                member = record(row_id, url, body.encode(), sha1, response, keep)
                out.write(member)
                found.append((capture_key(url, row_id), name, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            if found:
                yield arrow([list(c) for c in zip(*found, strict=True)], types)
        if out is not None:
            out.close()

    return written(dealt.mapInArrow(run, schema), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> list[tuple[str, str]]:
    """Writes the index files; returns the catalogue, (first key, file) in order: one entry per partition."""
    schema = "first string, name string"
    types = arrow_types(captures.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        block = list(itertools.islice(lines, block_lines))
        if not block:
            return
        fs, root = _folder(folder)
        fs.create_dir(root)
        name, first, directory, at = f"index-{uuid.uuid4().hex}", block[0][0], [], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            while block:
                packed = zlib.compress("\n".join(f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in block).encode())
                out.write(packed)
                directory.append((block[0][0], at, len(packed)))
                at += len(packed)
                block = list(itertools.islice(lines, block_lines))
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed + struct.pack("<QQ", at, len(packed)))
        yield arrow([[first], [name]], types)

    order = ["key", "file", "offset"]
    sorted_rows = captures.select("key", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    files = written(sorted_rows.mapInArrow(run, schema), "index-files")
    return sorted((r.first, r.name) for r in files.collect())  # bounded by the number of partitions


class _Index:
    """Reads of one task: keeps the directory and the block it read last."""

    def __init__(self, folder: str, catalogue: list[tuple[str, str]]):
        self.fs, self.root = _folder(folder)
        self.catalogue, self.firsts = catalogue, [k.encode() for k, _ in catalogue]
        self.opened, self.read_block = None, None

    def _directory(self, n: int) -> None:
        if self.opened != n:
            self.file = self.fs.open_input_file(f"{self.root}/{self.catalogue[n][1]}")
            end = self.file.size()
            at, size = struct.unpack("<QQ", self.file.read_at(16, end - 16))
            self.blocks = json.loads(zlib.decompress(self.file.read_at(size, at)))
            self.block_firsts = [b[0].encode() for b in self.blocks]
            self.opened = n

    def _block(self, n: int, b: int) -> None:
        if self.read_block != (n, b):
            _, at, size = self.blocks[b]
            self.lines = [x.rsplit("\t", 3) for x in zlib.decompress(self.file.read_at(size, at)).decode().split("\n")]
            self.keys = [x[0].encode() for x in self.lines]
            self.read_block = (n, b)

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Every record of the key: equal keys may begin in the block before the first one they head."""
        sought = key.encode()
        n = max(0, bisect.bisect_left(self.firsts, sought) - 1)
        for n in range(n, len(self.firsts)):
            if self.firsts[n] > sought:
                return
            self._directory(n)
            b = max(0, bisect.bisect_left(self.block_firsts, sought) - 1)
            for b in range(b, len(self.blocks)):
                if self.block_firsts[b] > sought:
                    return
                self._block(n, b)
                for i in range(bisect.bisect_left(self.keys, sought), bisect.bisect_right(self.keys, sought)):
                    yield self.lines[i][1], int(self.lines[i][2]), int(self.lines[i][3])


def look_up(keys: DataFrame, folder: str, catalogue: list[tuple[str, str]]) -> DataFrame:
    """(key, file, offset, length) of the records whose capture key is among ``keys`` (column ``key``; repeats count once)."""
    schema = f"key string, {RECORD}"
    types = arrow_types(keys.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(folder, catalogue)
        for batch in batches:
            found = [(k, *x) for k in batch.column(0).to_pylist() for x in index.find(k)]
            if found:
                yield arrow([list(c) for c in zip(*found, strict=True)], types)

    asked = keys.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key")
    return asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, schema)


READ = "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at (file, offset, length); a revisit's ``payload`` is null, its size and digest are those of the full payload."""
    types = arrow_types(places.sparkSession, READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        opened, file = None, None
        number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text)) else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = []
                for name, offset, length in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if name != opened:
                        opened, file = name, fs.open_input_file(f"{root}/{name}")
                    head, payload = parse(file.read_at(length, offset))
                    response = head["WARC-Type"] == "response"
                    found.append((
                        number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                        None if response else number(head["WARC-Refers-To"]),
                        len(payload) if response else int(head["X-Payload-Length"]),
                        head["WARC-Payload-Digest"].removeprefix("sha1:"), payload if response else None,
                    ))
                yield arrow([list(c) for c in zip(*found, strict=True)], types)

    order = ["file", "offset"]
    return places.select(*order, "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    captures = write_archives(table(spark, sf_dir, "pages"), folder)
    catalogue = write_index(captures, folder)
    places = look_up(captures.select("key"), folder, catalogue)
    return read_records(places, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# five hexadecimal digits are four of base 32
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {5 * g + 1}, 5) AS INT) >> {shift}) % 32 + 1, 1)"
    for g in range(8) for shift in (15, 10, 5, 0)
)
CHECK = f"""
    with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
    g as (select h, max(page_id) as keep from d group by h)
    select page_id, payload_bytes, {_DIGITS} as payload_digest,
        case when page_id is not distinct from keep then 'response' else 'revisit' end as record_type,
        case when page_id is distinct from keep then keep end as refers_to
    from d join g using (h)
"""
