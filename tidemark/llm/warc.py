"""WARC archives: written by Spark's own writer, read back by ranges of bytes.

A record is one gzip member, so an archive can be entered anywhere.  A reading task looks in its range for the bytes
that begin a member, decodes what follows and takes it for a record if it says so, ends with the right checksum and is
followed by another member or the end; from there it goes from member to member.  It owns the records that start in
its range and reads the last of them to its end, wherever that lies.

Members are put down by the text writer, which commits whole files only and reaches every store that Spark does.  It
ends each row with a byte of its own; a member under 16 MB ends with a zero, the highest byte of its length, so that
byte is left to the writer.  Longer ones are followed by an empty member, which ends with a zero too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, remove, scratch
from tidemark.llm.shingles import in_parts

MAGIC = b"\x1f\x8b\x08"
#: Payloads from this many bytes on are written once.
LEAST = 100
RANGE, CHUNK = 64 << 20, 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"


def packed(data: bytes) -> bytes:
    """``data`` as a gzip member, the same at each call."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def urn(page_id: Any) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: Any, url: str | None, payload: bytes, digest: str, length: int, refers_to: Any, date: str) -> bytes:
    """A record of a page, a revisit if it refers to another one; ``length`` is that of the payload in either case."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": urn(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url)
    head["WARC-Payload-Digest"] = f"sha256:{digest}"
    if refers_to is not None:
        head |= {"WARC-Refers-To": urn(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": HTTP, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def row_of(data: bytes) -> bytes:
    """What the writer needs for the member of ``data``: all but a final zero, which it adds."""
    member = packed(data)
    return member[:-1] if not member[-1] else member + packed(b"")[:-1]


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row to new archives below ``path``, whose names are the writer's.

    Of rows with equal payloads (by SHA-256) of at least ``least`` bytes those of the least id are responses with the
    payload, the others revisits without it.  Null html is empty.  Rows without an id are responses.  Rows that repeat the least
    id are all responses.  Other columns are ignored; an empty table gives archives without records.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    groups = rows.where(F.col("id").isNotNull() & (F.col("n") >= least)).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    at = scratch(pages.sparkSession, "warc-groups")
    firsts = cut(groups.where("many > 1").select("digest", "first"), at)  # as a table, so that a join on large groups can be split
    rows = rows.join(firsts.hint("merge"), "digest", "left").withColumn("refers", F.when(F.col("id") > F.col("first"), F.col("first")))
    rows = rows.select("id", "url", F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "n", "refers")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            none = lambda x: None if x is None or x != x else x
            yield pd.DataFrame({"member": [row_of(record(none(i), u, p, d, n, none(r), date)) for i, u, p, d, n, r in zip(b["id"], b["url"], b["payload"], b["digest"], b["n"], b["refers"], strict=True)]})

    # ids as text, since pandas would make floats of those beside nulls
    texts = [F.col(c).cast("string").alias(c) for c in ("id", "refers")]
    rows = rows.select(texts[0], "url", "payload", "digest", "n", texts[1]).mapInPandas(members, "member binary")
    rows.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)  # a cast changes no bytes
    remove(pages.sparkSession, at)


class Archive:
    """A file read by blocks at any place."""

    def __init__(self, uri: str, size: int):
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file, self.size, self.at, self.block = store.open_input_file(path), size, -1, b""

    def read(self, at: int) -> memoryview:
        """Some bytes from there on; none at the end."""
        k = at // CHUNK
        if k != self.at:
            self.at, self.block = k, self.file.read_at(min(CHUNK, max(0, self.size - k * CHUNK)), k * CHUNK)
        return memoryview(self.block)[at - k * CHUNK :]

    def next_magic(self, at: int, end: int) -> int | None:
        """The first place from ``at`` and before ``end`` where a member may begin."""
        while at < end:
            here = self.read(at)
            near = bytes(here) + (bytes(self.read(at + len(here))[:2]) if at + len(here) < self.size else b"")
            found = near.find(MAGIC)
            if found >= 0:
                return at + found if at + found < end else None
            at += max(1, len(here))
        return None

    def member(self, at: int, begins: bytes = b"") -> tuple[bytes, int] | None:
        """What the member there holds, and where it ends; None if there is none, or if it does not begin so."""
        z, out, seen = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                data = self.read(at)
                if not data:
                    return None
                out.append(z.decompress(data))
                at += len(data) - len(z.unused_data)
                if seen < len(begins):
                    seen = sum(map(len, out))
                    if not b"".join(out).startswith(begins[:seen]):
                        return None
        except zlib.error:
            return None
        data = b"".join(out)
        return (data, at) if data.startswith(begins) else None

    def begins(self, at: int) -> bool:
        """Whether a member may begin there, or the file ends."""
        return at >= self.size or (bytes(self.read(at)[:3]) + bytes(self.read(at + len(self.read(at)[:3]))[:3]))[:3] == MAGIC

    def records(self, start: int, end: int) -> Iterator[bytes]:
        """The records that start in the range, without white space or empty members between them."""
        at = self.next_magic(start, end)
        while at is not None:
            got = self.member(at, VERSION)
            if not got or not self.begins(got[1]):  # no record, but bytes that look like one's beginning
                at = self.next_magic(at + 1, end)
                continue
            while got:
                if got[0]:
                    yield got[0]
                at = got[1]
                if at >= min(end, self.size):
                    return
                got = self.member(at)
            raise ValueError(f"no gzip member at byte {at}")


def parsed(data: bytes) -> tuple:
    """The columns of RECORD."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    payload, length = block[: int(fields.get("content-length", 0))], None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        said = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
        length = int(said.group(1)) if said else len(payload)
    return (*(fields.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")), length, payload)


def ranges(spark: SparkSession, path: str, size: int) -> list[tuple[str, int, int, int]]:
    """(file, start, end, bytes of the file) for all ranges of the files below a folder; hidden ones are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [(f.getPath(), f.getLen()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.isFile()]
    return [(f.toString(), k, min(n, k + size), n) for f, n in files if f.getName()[0] not in "._" for k in range(0, n, size)]


def read_warc(spark: SparkSession, path: str, *, range_bytes: int = RANGE) -> DataFrame:
    """The records (RECORD) of the archives below ``path``, a task for each ``range_bytes`` of a file.

    Files are opened by pyarrow, which knows local, HDFS, S3, GCS and Azure paths.  A range without a record's start
    gives none; a record of any length is read by the task that owns it.  Bytes after a record that are no member raise an
    error, so that nothing is lost in silence.  An empty folder gives no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, held = [c.split()[0] for c in RECORD.split(", ")], [], 0
        for b in batches:
            for uri, start, end, size in b.itertuples(index=False):
                for data in Archive(uri, size).records(start, end):
                    rows.append(parsed(data))
                    held += len(data)
                    if held > CHUNK * 8:
                        yield pd.DataFrame(rows, columns=names).astype({"http_length": "Int64"})
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"http_length": "Int64"})

    found = ranges(spark, path, range_bytes)
    todo = spark.createDataFrame(found, "uri string, start long, end long, size long").repartition(max(1, len(found)))
    return todo.mapInPandas(read, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of ``write_warc``: page_id, bytes and digest of the full payload, type and refers_to.

    A response's digest and length are those of the payload read; a revisit's are the ones that it names.
    """
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")
    whole = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
