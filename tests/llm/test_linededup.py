from collections import Counter, defaultdict

import duckdb
from grainlake.llm import queries
from grainlake.llm.linededup import drop_boilerplate, host_of
from odd import ROWS, empty, odd
from pyspark.sql import functions as F


def brute(rows, ratio, least):
    pages, lines = Counter(), defaultdict(Counter)
    for host, text in rows:
        pages[host] += 1
        lines[host].update({x for x in (text or "").split("\n") if x.strip(" ")})
    bad = {h: {x for x, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in lines.items()}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad.get(h, ())) for h, t in rows]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(map(tuple, queries.op8_line_dedup(spark, sf).collect()))
    assert got == sorted(con.sql(queries.OP8_SQL).fetchall()) and any(r[3] for r in got)


def test_against_brute_force(spark):
    rows = [(f"h{k % 3}" if k % 5 else None, "\n".join(["menu", "menu", "", f"own {k}", *(["rare"] if k % 9 == 0 else []), *(["footer"] if k % 2 else [])])) for k in range(100)]
    df = spark.createDataFrame([(k, h, t) for k, (h, t) in enumerate(rows)], "id long, host string, text string").repartition(4)
    for ratio, least in ((0.1, 3), (0.1, 1), (0.3, 5), (0.5, 27), (0.9, 1)):
        got = [r.text for r in drop_boilerplate(df, F.col("host"), max_ratio=ratio, least_pages=least).orderBy("id").collect()]
        assert got == brute(rows, ratio, least)


def test_odd_rows(spark):
    got = drop_boilerplate(odd(spark), F.col("source"), max_ratio=0.3, least_pages=2)
    assert got.columns == odd(spark).columns
    want = brute([(r[3], r[1]) for r in ROWS], 0.3, 2)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r[0]), str(w)) for r, w in zip(ROWS, want))
    assert drop_boilerplate(empty(spark), F.col("source")).count() == 0


def test_hosts(spark):
    urls = ["http://A.b/c?d=//e", "https://user:pw@h.org:80/x", "ftp://x", "no url", None, "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in df.collect()] == ["a.b", "h.org", "x", "", "", ""]


def test_small_hosts_and_clashing_names(spark):
    # Five pages of one host: the menu goes; two pages of another, a copy each, stay.
    rows = [(k, "h", f"menu\nown {k}", "a", "b") for k in range(5)] + [(k, "g", "same\ntext", "a", "b") for k in (8, 9)]
    df = spark.createDataFrame(rows, "id long, host string, text string, _host_key string, _Boilerplate string")
    got = drop_boilerplate(df, F.col("host")).orderBy("id").collect()
    assert [r.text for r in got] == [f"own {k}" for k in range(5)] + ["same\ntext"] * 2
    assert {(r._host_key, r._Boilerplate) for r in got} == {("a", "b")} and drop_boilerplate(df, F.col("host")).columns == df.columns
