"""WARC archives as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, each with the digest of the payload so far; the last chunk's digest is the
record's. Writer and reader hold one chunk and one block of a file, never a record: a payload may be larger than memory. The chunks of a record follow each other in
one task, because a digest runs from front to back; records are spread.

``write_archive``: each task writes its records to a file of its own, one gzip member per record, checks length and digest on the way and reports (file, start, end) of
each ``SEGMENT`` bytes. The report, written by Spark, is the archive's manifest: a file that a lost task left behind is in no manifest and so not part of the archive.
``read_archive`` gives one task each segment; it reads gzip members and plain records alike. ``archive`` decides which records repeat a payload: digests meet in one aggregation,
repeats are a table of their own, and payloads are not shuffled as long as that table is below ``SENT_BYTES``.

Defined cases: a null payload is empty; a null record id is written as none and read as null, and is referred to by nothing; a null uri is left out; payloads below
``REVISIT_BYTES`` are never revisits; rows that repeat both id and payload share their fate, so all that repeat the smallest id are responses; ids that repeat with other payloads
are records of their own; an empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import query, read, remove

CHUNK, BLOCK = 64 << 10, 256 << 10
SEGMENT, FILE_BYTES = 8 << 20, 1 << 30  # compressed bytes
REVISIT_BYTES, SENT_BYTES = 100, 32 << 20
HEAD_BYTES = 1 << 20  # of the named fields of one record
ID, DATE = "urn:x-record:", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "file string, start long, end long, records long"
_FIELDS = "record_id string, record_type string, uri string, refers_to string, announced string, "
_CHUNKS = "chunk_no int, last boolean, payload_bytes long, digest string"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def chunked(records: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """Records with ``payload`` (binary, null: empty) replaced by rows (chunk_no, last, data)."""
    body = F.coalesce(F.col(payload), F.lit(b""))
    last = F.greatest(F.lit(0), F.expr(f"cast((octet_length({payload}) - 1) div {size} as int)"))
    rows = records.withColumn("_last", F.coalesce(last, F.lit(0))).select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("chunk_no"))
    return rows.select(*[c for c in records.columns if c != payload], "chunk_no", (F.col("chunk_no") == F.col("_last")).alias("last"),
                       F.substring(body, F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))


class Running:
    """Length and digest of a payload so far, chunk by chunk."""

    def __init__(self):
        self.size, self.sha = 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.sha.update(data)

    def digest(self) -> str:
        return self.sha.copy().hexdigest()


def digests(chunks: DataFrame) -> DataFrame:
    """``chunks`` (those of a record one after the other) with ``data`` replaced by payload_bytes and digest up to and with each chunk."""
    rest = [c for c in chunks.columns if c != "data"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Running()
        for b in frames:
            sizes, shas = [], []
            for k, data in zip(b.column("chunk_no").to_pylist(), b.column("data")):
                if k == 0:
                    now = Running()
                now.add(data.as_buffer() or b"")
                sizes.append(now.size)
                shas.append(now.digest())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], [*rest, "payload_bytes", "digest"])

    return chunks.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "data"], "payload_bytes long", "digest string"]))


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), value)


def _urn(record_id: str | None) -> str:
    return "none" if record_id is None else f"id:{quote(record_id, safe='')}"


def head(record_id, record_type, uri, refers_to, digest, size) -> bytes:
    """Named fields of a record and the start of its block."""
    block = 0 if record_type == "warcinfo" else len(HTTP)
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{ID}{_urn(record_id)}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_field(uri)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{_urn(refers_to)}>"]
    if block:
        lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    lines.append(f"Content-Length: {block + (size if record_type != 'revisit' else 0)}")
    return "\r\n".join([*lines, "", ""]).encode() + (HTTP if block else b"")


class _File:
    """An archive file being written, with the segments finished so far."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.out, self.at, self.start, self.records, self.segments = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0, 0, 0, []
        self.begin(head(str(uuid.uuid4()), "warcinfo", None, None, None, 0))
        self.finish(END)

    def begin(self, data: bytes) -> None:
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(data)

    def add(self, data) -> None:
        self._put(self.zip.compress(data))

    def finish(self, data: bytes) -> None:
        self.add(data)
        self._put(self.zip.flush())
        self.records += 1
        if self.at - self.start >= SEGMENT:
            self.cut()

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def cut(self) -> None:
        if self.at > self.start:
            self.segments.append((self.name, self.start, self.at, self.records))
        self.start, self.records = self.at, 0

    def close(self) -> list[tuple]:
        self.cut()
        self.out.close()
        return self.segments


def _writer(folder: str, file_bytes: int):
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "start", "end", "records"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now = None, Running()
        for b in frames:
            cols = [b.column(c).to_pylist() for c in ("record_id", "record_type", "uri", "refers_to", "digest", "payload_bytes", "chunk_no", "last")]
            for *fields, size, no, last, data in zip(*cols, b.column("data")):
                if no == 0:
                    if file and file.at >= file_bytes:
                        yield out(file.close())
                        file = None
                    file, now = file or _File(folder), Running()
                    file.begin(head(*fields, size))
                now.add(data := data.as_buffer() or b"")
                if fields[1] != "revisit":
                    file.add(data)
                if last:
                    if (now.size, now.digest()) != (size, fields[4]):
                        raise ValueError(f"record {fields[0]}: the payload has not the announced length and digest")
                    file.finish(END)
        if file:
            yield out(file.close())

    return run


def write_archive(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows (record_id, record_type, uri, refers_to, digest, payload_bytes, chunk_no, last, data) as WARC files under ``folder``; returns the manifest."""
    chunks.mapInArrow(_writer(f"{folder}/data", file_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return chunks.sparkSession.read.parquet(f"{folder}/manifest")


class _Bytes:
    """Bytes of a part of a file, unpacked where they are gzip members; one block is held at a time."""

    def __init__(self, stream, left: int):
        self.stream, self.left, self.held, self.raw = stream, left, b"", b""
        self.zip = None
        self.packed = self._more() and self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        got = self.stream.read(min(BLOCK, self.left)) if self.left else b""
        self.left -= len(got)
        self.raw += got
        return bool(got)

    def fill(self) -> bool:
        """Add some bytes to those held; False at the end."""
        if not self.packed:
            if not self.raw and not self._more():
                return False
            self.held, self.raw = self.held + self.raw, b""
            return True
        while self.zip or self.raw or self._more():
            self.zip = self.zip or zlib.decompressobj(31)
            got = self.zip.decompress(self.raw, BLOCK)  # what exceeds the block waits inside, for empty input too
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if self.zip.eof:
                self.zip = None
            if got:
                self.held += got
                return True
            if self.zip and not self.raw and not self._more():
                raise ValueError("an archive file ends within a record")
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``; empty at the end."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > HEAD_BYTES:
                raise ValueError("no end of the named fields of a record")
            if not self.fill():
                if self.held.strip(b"\r\n"):
                    raise ValueError("an archive file ends within a record")
                return b""
        out, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.fill():
                raise ValueError("an archive file ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def skip(self, mark: bytes) -> None:
        if b"".join(self.take(len(mark))) != mark:
            raise ValueError("no mark at the end of a record")


def _even(pieces: Iterator[bytes], size: int) -> Iterator[tuple[bytes, bool]]:
    """Pieces of ``size`` bytes and whether each is the last; one empty piece if there is none."""
    held = b""
    for p in pieces:
        held += p
        while len(held) > size:
            yield held[:size], False
            held = held[size:]
    yield held, True


def _id_of(urn: str | None) -> str | None:
    urn = urn and urn.strip("<>").removeprefix(ID)
    return unquote(urn[3:]) if urn and urn.startswith("id:") else urn if urn and urn != "none" else None


def records(source: _Bytes, size: int) -> Iterator[tuple]:
    """(fields, chunk number, last, data) of all records but warcinfo."""
    while raw := source.until(END):
        lines = raw.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        n = int(named["content-length"])
        kind = named["warc-type"]
        if n and named.get("content-type", "").startswith("application/http"):
            n -= len(source.until(END))
        body = source.take(n)
        if kind == "warcinfo":
            for _ in body:
                pass
            source.skip(END)
            continue
        fields = (_id_of(named["warc-record-id"]), kind, named.get("warc-target-uri"), _id_of(named.get("warc-refers-to")),
                  named.get("warc-payload-digest", "").rpartition(":")[2] or None)
        for no, (data, last) in enumerate(_even(body, size)):
            yield fields, no, last, data
        source.skip(END)


def _reader(folder: str, size: int, with_data: bool):
    types = [pa.string()] * 5 + [pa.int32(), pa.bool_(), pa.int64(), pa.string()] + [pa.binary()] * with_data
    names = ["record_id", "record_type", "uri", "refers_to", "announced", "chunk_no", "last", "payload_bytes", "digest"] + ["data"] * with_data

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        rows, held = [], 0
        for b in frames:
            for name, start, end in zip(*[b.column(c).to_pylist() for c in ("file", "start", "end")]):
                with fs.open_input_file(f"{path}/{name}") as f:
                    f.seek(start)
                    now = Running()
                    for fields, no, last, data in records(_Bytes(f, end - start), size):
                        if no == 0:
                            now = Running()
                        now.add(data)
                        rows.append((*fields, no, last, now.size, now.digest(), *[data] * with_data))
                        held += len(data) * with_data + 200
                        if held > 4 << 20:
                            yield out(rows)
                            rows, held = [], 0
        yield out(rows)

    return run


def read_archive(spark: SparkSession, folder: str, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of an archive: record_id, record_type, uri, refers_to, announced (the digest the record names), chunk_no, last, payload_bytes and digest so far, data."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return manifest.select("file", "start", "end").repartition(parts).mapInArrow(_reader(f"{folder}/data", size, with_data), _FIELDS + _CHUNKS + ", data binary" * with_data)


def with_revisits(records: DataFrame, least: int = REVISIT_BYTES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Records (id, ..., payload) with payload_bytes, digest, record_type and refers_to (of equal payloads of ``least`` bytes, all but the smallest id revisit it)."""
    src = records.withColumns({"payload_bytes": F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long"), "digest": F.sha2(F.coalesce("payload", F.lit(b"")), 256)})
    rows = cut_lineage(src.where(F.col("payload_bytes") >= least).select("id", "digest"))
    # first ids per digest; only digests that occur more than once go on
    groups = cut_lineage(rows.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    repeats = cut_lineage(rows.join(groups, "digest").where("not id <=> refers_to").distinct())
    width = repeats.agg(F.coalesce(F.sum(F.octet_length("digest") + 2 * F.octet_length(F.col("id").cast("string")) + 48), F.lit(0))).first()[0]
    left, right = src.alias("l"), (F.broadcast(repeats) if (width or 0) <= sent_bytes else repeats).alias("r")
    joined = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest")), "left")
    return joined.select("l.*", F.when(F.col("r.digest").isNull(), "response").otherwise("revisit").alias("record_type"), "r.refers_to")


def archive(records: DataFrame, folder: str, **how) -> DataFrame:
    """Write records (id, uri, payload) as an archive; returns the manifest."""
    rows = with_revisits(records, **how)
    named = rows.select(F.col("id").cast("string").alias("record_id"), "record_type", F.col("uri").cast("string").alias("uri"), F.col("refers_to").cast("string").alias("refers_to"),
                        "digest", "payload_bytes", "payload")
    return write_archive(chunked(named), folder)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: record_id, record_type, refers_to, payload_bytes and payload_digest of the full payload, intact.

    A revisit has the length of the response it refers to, which must name the same digest.
    """
    ends = cut_lineage(chunks.where("last").select("record_id", "record_type", "refers_to", "announced", "payload_bytes", "digest"))
    asked = cut_lineage(ends.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id"), F.col("announced").alias("digest")).distinct())
    known = cut_lineage(ends.where("record_type = 'response'").join(asked, ["record_id", "digest"], "left_semi")
                        .groupBy(F.col("record_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes")))
    back = ends.where("record_type = 'revisit'").join(known, (F.col("refers_to") == F.col("_id")) & (F.col("announced") == F.col("_digest")), "left")
    return (ends.where("record_type <> 'revisit'").select("record_id", "record_type", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"),
                                                         F.col("digest").eqNullSafe(F.col("announced")).alias("intact"))
            .unionByName(back.select("record_id", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.col("announced").alias("payload_digest"),
                                     F.col("_id").isNotNull().alias("intact"))))


@query("op11_warc", f"""
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))""")
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    kind, place = pages.schema["page_id"].dataType, f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")), place)
    found = cut_lineage(records_of(read_archive(spark, place, with_data=False)))
    remove(spark, place)
    if damaged := found.where("not intact").count():
        raise ValueError(f"{damaged} records did not come back as they were written")
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
