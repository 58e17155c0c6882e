import hashlib
import re
import struct

import pytest
import xxhash

from grainlake.llm import fingerprint as fp
from grainlake.llm import queries
from odd import ROWS, empty, odd


def units(text):
    # Java's look-behind split; blank pieces have no digest
    return {u for u in re.split(r"\n+|(?<=[.!?]) +", text) if u}


def jaccard(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def check(got, rows):
    rows = sorted(rows)
    assert len(got) == len(rows)
    got = {r.doc_id: r for r in got}
    prints = {}
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new, g = edited(text, after), got[key]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert g.near_edited == pytest.approx(jaccard(text, new)) and g.near_next == pytest.approx(jaccard(text, after))
        for t, f in ((text, g.fingerprint), (new, g.edited_fingerprint)):
            assert prints.setdefault(t, f) == f


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.op2_fingerprints(spark, sf).collect(), rows)


def test_small_buckets_wrap_around(spark):
    rows = [(k * k - 50, f"line {k % 7}.\nsame\nline {k}. tail {k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.with_next(df, "doc_id", "text", per_bucket=3).collect()
    want = dict(zip([r[0] for r in rows], [r[1] for r in [*rows[1:], rows[0]]])) if rows == sorted(rows) else None
    order = sorted(rows)
    want = {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert len({r.bucket for r in got}) > 5 and {r.doc_id: r.next_text for r in got} == want


def test_failed_pairs_are_tried_larger(spark, monkeypatch):
    # Too few rounds and cells for the first attempts.
    monkeypatch.setattr(fp, "ROUNDS", 1)
    df = spark.createDataFrame([(k, "\n".join(f"p{j}" for j in range(k, 3 * k))) for k in range(1, 9)], "doc_id long, text string")
    cells = fp.subtract(df.selectExpr("doc_id", "transform(sequence(1L, doc_id * 9), x -> xxhash64(x)) a", "transform(sequence(5L, 5 + doc_id * 9), x -> xxhash64(x)) b"), ["doc_id"], 0)
    first = {r.doc_id: r for r in fp.peel(cells, ["doc_id"], 0, rounds=1).collect()}
    full = {r.doc_id: r for r in fp.peel(cells, ["doc_id"], 0, rounds=9).collect()}
    assert any(r.failed for r in first.values())
    assert all(full[k].failed or full[k].differing == len({*range(1, 9 * k + 1)} ^ {*range(5, 6 + 9 * k)}) for k in full)


def test_odd_rows(spark):
    got = fp.compare_versions(odd(spark)).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 2).n_chars == 0
    assert fp.compare_versions(empty(spark)).count() == 0
    one = fp.compare_versions(odd(spark).where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def spark_hash(key, number):
    """Spark's xxhash64 of a long and an int."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", number), first)))[0]


def decode(a, b):
    """The differing digests of two fingerprints, by subtracting and peeling what they show; None if some are left."""
    signed = lambda x: struct.unpack("<q", struct.pack("<Q", int(x, 16)))[0]
    read = lambda f: {int(c): (int(n), signed(k), signed(s)) for c, n, k, s in (x.split(":") for x in f.split("/")[2].split(",") if x)}
    a, b, found = read(a), read(b), set()
    cells = {c: [x - y for x, y in zip(a.get(c, (0, 0, 0))[:1], b.get(c, (0, 0, 0))[:1])] + [x ^ y for x, y in zip(a.get(c, (0, 0, 0))[1:], b.get(c, (0, 0, 0))[1:])] for c in range(3 * fp.WIDTH)}
    while pure := [v for v in cells.values() if abs(v[0]) == 1 and spark_hash(v[1], 97) == v[2]]:
        n, key, check = pure[0]
        found.add(key)
        for r in range(3):
            cell = cells[spark_hash(key, r) % fp.WIDTH + r * fp.WIDTH]
            cell[0], cell[1], cell[2] = cell[0] - n, cell[1] ^ key, cell[2] ^ check
    return None if any(any(v) for v in cells.values()) else found


def test_likeness_is_that_of_the_fingerprints(spark, sf):
    got = fp.compare_versions(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("doc_id").collect()
    size = lambda f: int(f.split("/")[1])
    small = 0
    for k, r in enumerate(got):
        for other, near in ((r.edited_fingerprint, r.near_edited), (got[(k + 1) % len(got)].fingerprint, r.near_next)):
            found, n = decode(r.fingerprint, other), size(r.fingerprint) + size(other)
            if found is not None and len(found) <= 20:
                small += 1
                assert near == pytest.approx((n - len(found)) / (n + len(found)) if n else 1.0)
    assert small > len(got) / 4


def test_ids_of_other_types(spark):
    rows = [("b", "One. Two. Three."), ("a", "One. Two. Four."), (None, "Five."), ("c", None)]
    got = {r.doc_id: r for r in fp.compare_versions(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = [None, "a", "b", "c"]
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % 4]]
        assert got[i].near_next == pytest.approx(jaccard(texts[i], after)) and got[i].edited == hashlib.sha256(edited(texts[i], after).encode()).hexdigest()
    nameless = spark.createDataFrame([(None, "One."), (None, "Two.")], "doc_id date, text string")
    assert [r.near_next for r in fp.compare_versions(nameless).collect()] == [0.0, 0.0]
