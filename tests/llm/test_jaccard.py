import random
from fractions import Fraction

import duckdb
import numpy as np
from grainlake.llm import jaccard, queries
from odd import ROWS, empty, odd


def shingles(text, words=3):
    w = [p for p in bytes(text or "", "utf-8").lower().split()]
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def brute(rows, words=3, least=Fraction(9, 10)):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    group = {}
    for k, (i, _) in enumerate(rows):
        group.setdefault(find(k), []).append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted((str(rows[k][0]), len(sets[k]), low(group[find(k)]) if sets[k] else rows[k][0]) for k in range(len(rows)))


def listed(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def varied(seed, n, changes):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.randint(8, 160))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, changes)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((k * 3 + 1, " ".join(words)))
    return rows


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted((str(a), b, c) for a, b, c in con.sql(queries.OP6_SQL).fetchall())
    assert listed(queries.op6_jaccard_join(spark, sf)) == want


def test_blocks_lose_no_link(spark):
    rows = varied(1, 150, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 8
    assert listed(jaccard.jaccard_components(df)) == want
    # A few documents a block: families go over many blocks, and pairs of blocks are compared.
    assert listed(jaccard.jaccard_components(df, block_shingles=600)) == want


def test_five_words_and_four_fifths(spark):
    rows = varied(2, 80, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(jaccard.jaccard_components(df, words=5, least=Fraction(8, 10))) == brute(rows, 5, Fraction(8, 10))


def test_odd_rows(spark):
    assert listed(jaccard.jaccard_components(odd(spark))) == brute([(r[0], r[1]) for r in ROWS])
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_keys_and_classes_at_every_size():
    # Sets at the very threshold share a part, whichever shingles differ.
    rng = np.random.default_rng(0)
    for n in [*range(1, 60), 97, 200, 1001]:
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for _ in range(4):
            drop = len(a) // 10  # the smaller set has 0.9 of the larger
            b = np.sort(rng.permutation(a)[drop:])
            assert set(jaccard.part_keys(a, Fraction(9, 10), {})) & set(jaccard.part_keys(b, Fraction(9, 10), {}))
            kept = np.sort(rng.permutation(a)[len(a) // 5 :])
            assert set(jaccard.part_keys(a, Fraction(4, 5), {})) & set(jaccard.part_keys(kept, Fraction(4, 5), {}))


def test_trees_prune_and_find_every_component():
    rows = varied(3, 200, 5)
    sets = [np.unique(np.array([hash(s) & (2**63 - 1) for s in shingles(t)], np.uint64)) for _, t in rows]
    forest = jaccard.Forest(sets, Fraction(9, 10))
    forest.within(forest.build(np.arange(len(sets))))
    want = {a: c for a, _, c in brute(rows)}
    for i in range(len(rows)):
        for j in range(i):
            assert (forest.find(i) == forest.find(j)) == (want[str(rows[i][0])] == want[str(rows[j][0])])


def passages(seed, n):
    """Documents of few passages that many of them share, some words of their own, and near copies of them."""
    r = random.Random(seed)
    shared = [[f"p{k}w{j}" for j in range(30)] for k in range(12)]
    rows = []
    for k in range(n):
        words = [w for p in r.sample(shared, r.randint(1, 4)) for w in p] + [f"own{k}x{j}" for j in range(r.randint(0, 80))]
        for copy in range(r.choice([1, 1, 1, 4])):
            changed = list(words)
            for _ in range(r.randint(0, 3) if copy else 0):
                changed[r.randrange(len(changed))] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    return rows


def test_shared_passages_lose_no_link(spark):
    rows = passages(4, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words, least in ((3, Fraction(9, 10)), (5, Fraction(8, 10)), (2, Fraction(1, 2))):
        want = brute(rows, words, least)
        assert listed(jaccard.jaccard_components(df, words=words, least=least)) == want and len({c for _, _, c in want}) < len(rows)


def test_parts_of_shared_passages_are_left_out(spark):
    # Nothing here is linked, though all share a passage: so nothing is a family.
    rows = [(k, " ".join([f"p{j}" for j in range(40)] + [f"own{k}x{j}" for j in range(80)])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    packed = jaccard.materialise(jaccard.packs(df, 5, Fraction(8, 10)), "packs")
    assert jaccard.shared_parts(packed).where("node <> least").count() == 0


def test_every_link(spark):
    rows = varied(5, 90, 2) + [(1000, "a b c d e"), (1001, "a b c d e"), (1002, ""), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    for size in (10**9, 500):
        pairs, members = jaccard.jaccard_links(df, block_shingles=size)
        of = {r.doc_id: r.class_id for r in members.collect()}
        assert of[1000] == of[1001] and of[1002] is None is of[1003]
        want = {tuple(sorted((of[i], of[j]))) for i in sets for j in sets if i < j and sets[i] and sets[j] and sets[i] != sets[j] and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}
        assert {(r.class_a, r.class_b) for r in pairs.collect()} == want and len(want) > 15
