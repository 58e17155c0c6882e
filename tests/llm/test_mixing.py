from collections import defaultdict

import duckdb
import pytest
from grainlake.llm import queries
from grainlake.llm.common import word_count
from grainlake.llm.mixing import mix
from odd import ROWS, empty, odd
from pyspark.sql import functions as F


def fill(sizes, weights, cap=3):
    """Water-filling by rounds: clamp what is above its cap, share the rest again."""
    total, fixed, free = sum(sizes.values()), {}, dict(weights)
    while free:
        level = (total - sum(fixed.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * w for s, w in free.items()}
        for s in over:
            fixed[s] = cap * sizes[s]
            del free[s]
    return fixed


def check(rows):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.whole * r.size + r.part
        targets[r.source] = r.target
        assert 0 <= r.whole * r.size + r.part <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], abs=1)
        assert next(r.source_size for r in rows if r.source == s) == sizes[s]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, queries.op7_mixing(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()))
    want = sorted(con.sql(queries.OP7_SQL).fetchall())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_against_rounds_of_clamping(spark):
    for seed in range(3):
        rows = [(k, f"s{k * k % (7 + seed)}" if k % 11 else None, (k * 37 + seed) % (3 if k % (7 + seed) == 1 else 200)) for k in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(3)
        first = mix(df, F.col("n"), seed=seed).collect()
        check(first)
        assert sorted(map(str, first)) == sorted(map(str, mix(df.repartition(5), F.col("n"), seed=seed).collect()))


def test_odd_rows(spark):
    got = mix(odd(spark), word_count(F.col("text"))).collect()
    assert len(got) == len(ROWS)
    check(got)
    assert mix(empty(spark), word_count(F.col("text"))).count() == 0
    assert all(r.whole == 0 and r.part == 0 for r in mix(odd(spark), F.lit(None).cast("long")).collect())
