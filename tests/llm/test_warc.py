import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gleanworks.llm import warc

BIG = "é<p>" * 100_000
ROWS = [(1, "http://a.test/", "x" * 200), (2, "http://a.test/\r\nEvil: 1", "x" * 200), (3, None, "x" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
        (8, "u", BIG), (9, "u", BIG), (10, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", "x" * 200), (None, "u", "n" * 100), (None, "u", "n" * 100), (11, "u", "y" * 100),
        (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99), (11, "u", "other" * 50), (15, "u", "other" * 50)]
SCHEMA = "page_id long, url string, html string, record_id string"


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 100 and bool(ids) and i != min(ids)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def test_query_equals_contract(spark, tmp_path):
    spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.op11_warc(spark, str(tmp_path)).collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_repeats_by_either_join(spark, sent):
    rows = spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA).select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    got = [(r.id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.with_revisits(rows, sent_bytes=sent).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_archive_holds_chunks_and_running_digests(spark, tmp_path):
    folder = str(tmp_path / "a")
    rows = spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA).select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    manifest = warc.archive(rows, folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS) + manifest.select("file").distinct().count()  # and a warcinfo record per file
    got = sorted((r for r in warc.read_archive(spark, folder, size=1000).collect() if r.record_id == "8"), key=lambda r: r.chunk_no)
    data, whole = b"", BIG.encode()
    for r in got:
        data += r.data
        assert len(r.data) <= 1000 and r.payload_bytes == len(data) and r.digest == hashlib.sha256(data).hexdigest()
    assert data == whole and [r.last for r in got] == [False] * (len(got) - 1) + [True]
    uris = {r.uri for r in warc.read_archive(spark, folder, with_data=False).collect()}
    assert "http://a.test/%0D%0AEvil:%201" in uris and None in uris


def test_files_are_plain_gzip_and_orphans_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, "u", b"p" * 300)], "id long, uri string, payload binary")
    name = warc.archive(rows, folder).first().file
    text = gzip.open(f"{folder}/data/{name}").read()
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"p" * 300 + b"\r\n\r\n") and b"Content-Length: %d\r\n" % (300 + len(warc.HTTP)) in text
    (tmp_path / "a/data/left-by-a-lost-task.warc.gz").write_bytes(b"torn")
    assert warc.read_archive(spark, folder).count() == 1
    # the same records unpacked
    (tmp_path / "a/data/plain.warc").write_bytes(text)
    spark.createDataFrame([("plain.warc", 0, len(text), 2)], warc.MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    r = warc.read_archive(spark, folder).first()
    assert (r.record_id, r.digest, r.announced) == ("1", *[hashlib.sha256(b"p" * 300).hexdigest()] * 2)
    spark.createDataFrame([("plain.warc", 0, len(text) - 50, 2)], warc.MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archive(spark, folder).collect()


def test_digests_of_chunk_rows_and_wrong_announcements(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"ab" * 5000), (2, None), (3, b"")], "id long, payload binary")
    chunks = warc.chunked(rows, size=777)
    got = {r.id: (r.payload_bytes, r.digest) for r in warc.digests(chunks).where("last").collect()}
    assert got == {i: (len(p), hashlib.sha256(p).hexdigest()) for i, p in ((1, b"ab" * 5000), (2, b""), (3, b""))}
    bad = chunks.selectExpr("string(id) record_id", "'response' record_type", "'u' uri", "string(null) refers_to", "'00' digest", "bigint(3) payload_bytes", "chunk_no", "last", "data")
    with pytest.raises(Exception, match="announced"):
        warc.write_archive(bad, str(tmp_path / "b"))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc(spark, str(tmp_path)).collect() == []
