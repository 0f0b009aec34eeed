import gzip
import hashlib
import io

import pytest

from martloom.llm import warc
from martloom.llm.queries import QUERIES
from martloom.llm.shared import scratch

SCHEMA = "page_id long, url string, html string"


def expected(pages, least=1000):
    groups = {}
    for page_id, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for data, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(data) >= least and i != last
            out.append((i, len(data), hashlib.sha1(data).hexdigest(),
                        "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def pages_back(spark, df):
    path = scratch(spark, "warc-test")
    warc.write_warc(warc.page_records(df), path)
    return path


def test_nulls_long_and_equal_pages(spark):
    pages = [
        (1, "http://a", "x" * 999), (2, "http://b", "x" * 999),
        (3, "http://c", "é" * 500), (4, "http://d", "é" * 500), (5, None, "é" * 500),
        (6, "http://e", None), (7, "http://f\r\nWARC-Type: x", ""), (None, "http://g", "y" * 1000),
        (8, "http://h", "y" * 1000), (9, "http://i", "\r\n\r\nWARC/1.1\r\n" * 300_000),
    ]
    path = pages_back(spark, spark.createDataFrame(pages, SCHEMA))
    rows = warc.read_warc(spark, path).select(
        warc.page_of("record_id").alias("page_id"), "payload_length", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"), "payload")
    found = rows.collect()
    assert sorted((tuple(r[:5]) for r in found), key=str) == expected(pages)
    texts = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert bytes(texts[9]).decode() == pages[-1][2] and bytes(texts[6]) == b""


def test_predicates_reach_the_source_and_payloads_are_left_out(spark):
    pages = [(k, f"http://{'a' if k % 2 else 'b'}/{k}", "z" * 2000 + str(k % 5)) for k in range(40)]
    path = pages_back(spark, spark.createDataFrame(pages, SCHEMA))
    revisits = warc.read_warc(spark, path, payload="false").where("record_type = 'revisit'")
    assert revisits.count() == 35
    assert revisits.where("payload IS NOT NULL").count() == 0
    some = warc.read_warc(spark, path).where("target_uri LIKE 'http://a%' AND record_type IN ('response')")
    assert {r.record_id for r in some.select("record_id").collect()} == {
        f"urn:page:{k}" for k in range(35, 40) if k % 2}
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert len([r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]) == 35


def test_several_files_and_partitions(spark):
    pages = [(k, f"http://{k}", f"{k} " * 3000) for k in range(60)]
    path = scratch(spark, "warc-test")
    warc.write_warc(warc.page_records(spark.createDataFrame(pages, SCHEMA)).coalesce(1), path,
                    file_bytes="20000", level="0")
    back = warc.read_warc(spark, path, partition_bytes="50000")
    assert back.rdd.getNumPartitions() > 3
    assert sorted(bytes(r.payload).decode() for r in back.collect()) == sorted(p[2] for p in pages)


def test_archives_of_other_writers(spark, tmp_path):
    def one(kind, uri, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\n"
        head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    all_records = [one("response", f"http://{k}", http + b"p" * (k * 70_000)) for k in range(4)]
    (tmp_path / "plain.warc").write_bytes(b"".join(all_records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in all_records))
    rows = warc.read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert sorted(r.payload_length for r in rows) == sorted([k * 70_000 for k in range(4)] * 2)
    slim = warc.read_warc(spark, str(tmp_path), payload="false").where("target_uri = 'http://3'").collect()
    assert [(r.payload_length, r.payload) for r in slim] == [(210_000, None)] * 2


def test_empty_table_and_extra_columns(spark):
    extra = f"{SCHEMA}, payload string, record_type string, n long, first_id long"
    empty = spark.createDataFrame([], extra)
    assert warc.read_warc(spark, pages_back(spark, empty)).count() == 0
    rows = spark.createDataFrame([(1, "http://a", "q" * 1000, "p", "r", 7, 8)], extra)
    assert warc.read_warc(spark, pages_back(spark, rows)).first().payload_length == 1000


def test_query_covers_all_pages(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = QUERIES["op9_warc_source"](spark, sf_dir).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(pages)


def test_long_http_headers_without_payload(spark, tmp_path):
    def one(uri, block):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\n"
        head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    long = lambda n: b"HTTP/1.1 200 OK\r\nX-A: " + b"a" * n + b"\r\n\r\n"
    blocks = [long(n) + b"p" * 50_000 for n in (10, 16_357, 16_358, 40_000, 200_000)] + [b"HTTP/1.1 200 OK\r\n" + b"x" * 40_000]
    records = [one(f"http://{k}", b) for k, b in enumerate(blocks)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    for payload in ("true", "false"):
        rows = warc.read_warc(spark, str(tmp_path), payload=payload).collect()
        assert sorted((r.target_uri, r.payload_length) for r in rows) == sorted(
            (f"http://{k}", 50_000 if k < 5 else 0) for k in range(6) for _ in range(2))


@pytest.mark.parametrize("offset", [-24, -2, -1, 0, 1])
@pytest.mark.parametrize("own", [True, False])
def test_members_that_begin_at_the_end_of_the_buffer(offset, own):
    def packed(k, payload):
        data = warc.record({"record_type": "response", "record_id": f"urn:page:{k}", "payload": payload,
                            "payload_length": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()})
        return warc.member(data, 0) if own else gzip.compress(data, 0)

    step = warc.Window(None).step
    size = step - 1000
    for _ in range(3):  # lengths written as text and stored blocks shift the end a little
        size += step + offset - len(packed(0, b"a" * size))
    first = packed(0, b"a" * size)
    assert len(first) == step + offset
    file = io.BytesIO(first + packed(1, b"b" * 2000) + packed(2, b""))
    found = list(warc.records(file, lambda row: True, True))
    assert [(r[1], r[-2], r[-1]) for r in found] == [
        ("urn:page:0", size, b"a" * size), ("urn:page:1", 2000, b"b" * 2000), ("urn:page:2", 0, b"")]
