import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from granary.llm import warc

BIG = "é" * 600


def pages():
    return [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", BIG), (4, "u\r\nx%", "small"), (5, None, "small"), (6, "http://a/6", None), (7, "http://a/7", ""), (8, "w", "WARC/1.1\r\n\r\n" * 300), (9, "l", "x" * 500000), (3, "http://a/3", BIG), (None, "n", BIG), (10, "urn:none", "x"), (11, "%75rn:none", "x")]


@pytest.mark.parametrize("most", [warc.BROADCAST_DIGESTS, -1])
def test_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(spark, df, folder)
    got = {}
    for r in warc.read_records(index, folder, payload=True).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(pages())
    for page_id, url, html in pages():
        data = (html or "").encode()
        for r in got[page_id]:
            revisit = len(data) >= 1000 and data == BIG.encode() and page_id != 3
            assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len(data), hashlib.sha1(data).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
            assert r["payload"] == (None if revisit else data)
    # any record can be read alone, by its index row
    one = warc.read_records(index.where("page_id = 8"), folder).collect()
    assert [r["page_id"] for r in one] == [8]
    # files are plain WARC: members of gzip in a row
    for name in os.listdir(tmp_path / "archives"):
        assert gzip.open(tmp_path / "archives" / name).read().startswith(b"WARC/1.1\r\n")


def test_ranges_are_coalesced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 2000)
    folder = f"file://{tmp_path}/archives"
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 300) as html").coalesce(1)
    index = warc.write_archives(spark, df, folder)
    assert warc.read_records(index, folder).count() == 200
    assert sorted(r[0] for r in warc.read_records(index.where("page_id % 7 = 0"), folder).select("page_id").collect()) == list(range(0, 200, 7))


def test_reads_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/archives"
    df = spark.range(300).selectExpr("id as page_id", "'u' as url", "sha2(cast(id as string), 512) as html").coalesce(1)
    index = warc.write_archives(spark, df, folder)
    monkeypatch.setattr(warc, "TASK_BYTES", index.agg(F.sum("length")).first()[0] // 10)
    assert warc.read_records(index, folder).rdd.getNumPartitions() in (10, 11)


def test_damage_is_noticed(spark, tmp_path):
    data = bytearray(warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False))
    data[data.rfind(b"payload")] = 0
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(bytes(data))


def test_no_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0
