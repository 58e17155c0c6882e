"""Every registered query of the library itself against its SQL."""

import functools
import os

import duckdb
import pytest

from grainlake.plans import queries
from grainlake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def once():
    """Labels and topology are made once for all tests of this module."""
    patch = pytest.MonkeyPatch()
    for name in ("_labels", "_units", "_built"):
        made = getattr(queries, name)
        kept = (lambda f: lambda spark, sf_dir: queries.materialise(f(spark, sf_dir), "shared"))(made) if name != "_built" else made
        patch.setattr(queries, name, functools.cache(kept))
    yield
    patch.undo()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


def rows(names, table):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(plain(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [list(r) for r in got.collect()]) == rows(names, found.fetchall())


def test_vectors_at_half_and_empty(spark, tmp_path):
    """Halves of 32-bit products, empty vectors and missing ones."""
    vectors = [(1, [0.035, 0.005, -0.045]), (2, []), (3, None), (4, [float("inf"), 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["vector_ops"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["vector_ops"])
    assert rows(got.columns, [list(r) for r in got.collect()]) == rows([d[0] for d in found.description], found.fetchall())


def test_queries_without_sql_have_rows(spark):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, SF).count() > 0
