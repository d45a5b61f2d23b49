import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import warc

PAGES = "page_id long, url string, html string, uri string"


def expected(rows, least=1000):
    top = {}
    for page, _, html, _ in rows:
        d = hashlib.sha1((html or "").encode()).hexdigest()
        if page is not None:
            top[d] = max(top.get(d, page), page)
    out = []
    for page, _, html, _ in rows:
        b = (html or "").encode()
        d = hashlib.sha1(b).hexdigest()
        copies = sum(hashlib.sha1((h or "").encode()).hexdigest() == d for _, _, h, _ in rows)
        revisit = len(b) >= least and copies > 1 and d in top and (page is None or page < top[d])
        out.append((page, len(b), d, "revisit" if revisit else "response", top[d] if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted([tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, PAGES), **options).collect()], key=str)


def test_round_trip_with_chunks_copies_nulls_and_record_marks(spark):
    mark = warc.BETWEEN
    long = "é日本\r\n" * 700
    rows = [
        (1, "http://a/ü x", long, "u"), (2, None, long, "u"), (3, "http://c", None, None), (4, "http://d", "", "u"), (5, "http://e", "short", "u"), (6, "http://f", "short", "u"),
        (7, "http://g", "a" + mark + "b" + mark, "u"), (8, "http://h", "WARC/1.1\r\nWARC-Type: x\r\n\r\nbody", "u"), (9, "http://i", "ends " + mark[:-2], "u"), (None, "n", long, "u"), (5, "http://e", "short", "u"),
        (10, "http://j", "\r\n\r\n" * 40 + mark * 3, "u"),
    ]
    assert run(spark, rows, chunk_bytes=101) == expected(rows)
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_chunks_carry_running_digests_and_stay_small(spark, tmp_path):
    html = "ñ" * 5000
    pages = spark.createDataFrame([(1, "u", html, "x")], PAGES)
    warc.write_archive(pages, str(tmp_path / "w"), chunk_bytes=999)
    chunks = warc.read_archive(spark, str(tmp_path / "w")).orderBy("chunk_no").collect()
    assert len(chunks) == 11 and max(len(c.chunk) for c in chunks) == 999
    assert b"".join(bytes(c.chunk) for c in chunks) == html.encode()
    assert chunks[3].prefix_digest == hashlib.sha1(html.encode()[: 4 * 999]).hexdigest()


def test_altered_chunk_is_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 500, "x")], PAGES), str(tmp_path / "w"), chunk_bytes=100)
    chunks = warc.read_archive(spark, str(tmp_path / "w")).withColumn("chunk", F.when(F.col("chunk_no") == 2, F.lit(b"y" * 100)).otherwise(F.col("chunk")))
    try:
        warc.records(chunks).collect()
    except Exception as e:
        assert "differs from its digest" in str(e)
    else:
        raise AssertionError


def test_archives_of_other_writers_and_missing_chunks(spark, tmp_path):
    def record(*lines, body=b"", version="WARC/1.0"):
        head = "\r\n".join([version, *lines, f"content-length: {len(body)}", "", ""])
        return gzip.compress(head.encode() + body + b"\r\n\r\n")

    html = b"<p>\xff\x00 bytes\r\n\r\nof any kind</p>"
    parts = [
        record("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>", body=b"software: x"),
        record("warc-type: response", "warc-record-id: <urn:uuid:1>", "WARC-Target-URI:http://a", body=html),
        record("WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Segment-Number: 1", body=html, version="WARC/1.1"),
        record("WARC-Type: continuation", "WARC-Record-ID: <urn:uuid:3>", "WARC-Segment-Origin-ID: <urn:uuid:2>", "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(html) + 4}", body=b"tail", version="WARC/1.1"),
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(parts))
    got = sorted(tuple(r) for r in warc.records(warc.read_archive(spark, str(tmp_path / "other.warc.gz"))).select("payload_bytes", "payload_digest", "record_type").collect())
    of = lambda body, kind: (len(body), hashlib.sha1(body).hexdigest(), kind)
    assert got == sorted([of(b"software: x", "warcinfo"), of(html, "response"), of(html + b"tail", "response")])
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(parts[:3]))
    (tmp_path / "short.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nab\r\n\r\n"))
    for name, says in (("cut", "last chunk is missing"), ("short", "as long as its header says")):
        with pytest.raises(Exception, match=says):
            warc.records(warc.read_archive(spark, str(tmp_path / f"{name}.warc.gz"))).collect()


def test_records_carry_the_fields_that_the_format_asks_for(spark, tmp_path):
    rows = [(1, "http://a", "x" * 3000, "u"), (2, "http://b", "x" * 3000, "u"), (3, None, "y" * 12, "u")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), chunk_bytes=1000)
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((tmp_path / "w").glob("*.gz")))
    heads = [dict(line.split(": ", 1) for line in part.split("\r\n\r\n")[0].split("\r\n")[1:]) for part in text.split("WARC/1.")[1:]]
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= h.keys() for h in heads)
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) == 5
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    assert revisit["WARC-Refers-To-Target-URI"] == "http://b" and revisit["WARC-Profile"] == warc.PROFILE and revisit["Content-Length"] == "0"
    assert sorted(h["WARC-Segment-Number"] for h in heads if "WARC-Segment-Number" in h) == ["1", "2", "3"]
    assert [h["WARC-Segment-Total-Length"] for h in heads if "WARC-Segment-Total-Length" in h] == ["3000"]


def test_extra_columns_with_clashing_names_and_repeated_rows(spark):
    names = "page_id long, url string, html string, place string, payload_digest string, refers_to string, record_id string"
    rows = [(i % 3 if i % 4 else None, None, "z" * (2000 if i % 2 else 50), "p", "d", "r", "i") for i in range(24)]
    got = sorted([tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, names)).collect()], key=str)
    assert got == expected([r[:4] for r in rows])


def test_cutting_time_grows_with_the_payload(spark):
    import time

    def seconds(n):
        page = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.lit("0123456789abcdef"), F.lit(n // 16)).alias("html"))
        start = time.perf_counter()
        chunks = warc.segments(page)[1].select("chunk_no", F.length("chunk").alias("n"), "prefix_digest").collect()
        assert sum(r.n for r in chunks) == n and max(chunks, key=lambda r: r.chunk_no).prefix_digest == hashlib.sha1(b"0123456789abcdef" * (n // 16)).hexdigest()
        return time.perf_counter() - start

    seconds(1 << 20)
    assert seconds(64 << 20) < 4 + 16 * seconds(8 << 20)
