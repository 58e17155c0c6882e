import hashlib

import pytest
from grainlake.llm import queries, warc
from grainlake.llm.common import new_path

import duckdb


def test_query_against_sql(spark, sf):
    got = sorted(map(tuple, queries.op1_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(con.sql(queries.OP1_SQL).fetchall())


def test_segments_revisits_and_odd_rows(spark):
    long, odd = "é\r\n\r\nWARC/1.1\r\n" * 30000, "\r\n\r\n0\r\n\r\n"
    rows = [(1, "http://a/", long, "x"), (2, None, long, "x"), (3, "http://b/\r\nX: y", "z" * 1000, None), (9, "u", "z" * 1000, None), (9, "u", "z" * 1000, None), (4, "u", "z" * 999, "x"), (5, "u", "z" * 999, "x"), (6, "u", None, "x"), (7, "u", "", "x"), (None, "u", odd, "x"), (None, "u", "z" * 1000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    path = new_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=5000, records_per_file=7)
    kept = warc.read_warc(spark, path).collect()
    assert len(kept) == len(rows) and max(r.segment or 0 for r in warc.read_records(spark, path).collect()) > 80
    for r in kept:
        want = [(x[2] or "").encode() for x in rows if x[0] == r.row_id]
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) in want)
        assert r.payload_digest in {hashlib.sha1(w).hexdigest() for w in want}
    kinds = sorted((str(r.row_id), r.record_type, r.refers_to_row_id) for r in kept if r.record_type == "revisit")
    assert kinds == [("1", "revisit", 2), ("3", "revisit", 9), ("None", "revisit", 9)]
    assert warc.round_trip(df.limit(0), new_path(spark, "warc")).count() == 0


def test_lost_segments_are_told(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "z" * 20000)], "page_id long, url string, html string"), path, segment_bytes=3000)
    records = warc.read_records(spark, path)
    for lost in ("segment = 1", "segment = 3", "total_length is not null"):
        with pytest.raises(Exception, match="segments don't add up"):
            warc.reassemble(records.where(f"not ({lost})")).collect()
    with pytest.raises(Exception, match="segments don't add up"):
        warc.reassemble(records.unionByName(records.where("segment = 2"))).collect()


def test_transfer_framing():
    assert warc.dechunk(b"4;x=y\r\nWiki\r\n5\r\npedia\r\n0\r\nT: v\r\n\r\n") == b"Wikipedia"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nWiki\r\n0\r\n\r\n")
