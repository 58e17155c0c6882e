import math
import re
import zlib
from collections import Counter

import numpy as np
from grainlake.llm import queries, toxicity
from odd import ROWS, empty, odd
from pyspark.sql import functions as F


def test_thresholds_share_weights_and_gradients_are_right():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 3))
    grades = np.clip((x @ np.array([3, 1, 0]) + rng.logistic(0, 0.4, 400)).round().astype(int) - 1, 0, 2)
    rows = [np.flatnonzero(r) for r in x]
    w, cuts = toxicity.fit_grades(rows, [np.ones(len(r)) for r in rows], grades, 3, ridge=0)
    assert cuts[0] < cuts[1] and w[0] > w[1] > abs(w[2])
    # Each threshold is met about as often as the model says.
    model = toxicity.Model({0: w[0], 1: w[1], 2: w[2]}, tuple(cuts))
    assert np.allclose(model.above(x @ w).mean(0), [(grades > 0).mean(), (grades > 1).mean()], atol=0.03)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs.join(labels.where(held), "doc_id"), model).select("toxic", "p_toxic", "severity").toPandas()
    says = got.p_toxic > 0.5
    assert (says & (got.toxic == 1)).sum() / (got.toxic == 1).sum() > 0.85
    assert (says & (got.toxic == 0)).sum() / (got.toxic == 0).sum() < 0.02
    assert got.severity.between(0, 2).all() and (got.severity >= got.p_toxic).all()


def test_query_is_the_same_on_each_run(spark, sf):
    one, two = (sorted(map(tuple, queries.op9_toxicity(spark, sf).collect())) for _ in range(2))
    assert one == two and len(one) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (8, 1), (None, 1), (9, None), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels)
    got = toxicity.score(odd(spark).withColumn("severity", F.lit("old")), model)
    assert got.count() == len(ROWS) and got.columns == [*odd(spark).columns, "severity", "p_toxic"]
    assert toxicity.score(empty(spark), model).count() == 0
    for same in (labels.where("toxic = 1"), labels.limit(0)):
        none = toxicity.fit(odd(spark), same)
        assert {r.p_toxic for r in toxicity.score(odd(spark), none).collect()} == {0.0}


def brute_features(text):
    """Buckets of a text's features and how often each occurs, word by word."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for key in [word + "$"] + [word[:k] for k in (4, 5, 6, 7) if k < len(word)]:
            out[zlib.crc32(key.encode()) % toxicity.BUCKETS] += 1
    return out


def brute_above(model, text):
    total = sum(model.weights.get(f, 0.0) * (1 + math.log(n)) for f, n in brute_features(text).items())
    return [1 / (1 + math.exp(cut - total)) for cut in model.thresholds]


def test_query_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.thresholds) == 2 and model.weights
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    for r in docs.collect():
        above = brute_above(model, r.text)
        assert abs(got[r.doc_id].p_toxic - above[0]) < 1e-9 and abs(got[r.doc_id].severity - sum(above)) < 1e-9
        assert got[r.doc_id].toxic == (got[r.doc_id].p_toxic > 0.5)


def test_no_change_of_a_whole_fit_is_more_likely(spark):
    # A fit by fit(), held against the likelihood of its sample, summed up row by row.
    rng = np.random.default_rng(3)
    mild, harsh, plain = [["bother", "grumpy", "rude"], ["awful", "hateful", "vile"], ["tree", "river", "stone", "cloud", "bread"]]
    rows = []
    for k in range(240):
        grade = k % 3
        words = list(rng.choice(plain, 12)) + (list(rng.choice(mild, 2)) if grade and rng.random() < 0.9 else []) + (list(rng.choice(harsh, 2)) if grade == 2 and rng.random() < 0.8 else [])
        rows.append((k, " ".join(rng.permutation(words)), int(grade if rng.random() < 0.9 else rng.integers(3))))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    ridge = 5e-5

    def loss(weights, cuts):
        total = 0.0
        for _, text, grade in rows:
            above = [1.0, *brute_above(toxicity.Model(weights, cuts), text), 0.0]
            total -= math.log(above[grade] - above[grade + 1])
        return total / len(rows) + ridge * sum(w * w for w in weights.values()) / 2

    best = loss(model.weights, model.thresholds)
    assert model.thresholds[0] < model.thresholds[1] and best < math.log(3)
    for f in model.weights:
        for step in (0.03, -0.03):
            assert loss(model.weights | {f: model.weights[f] + step}, model.thresholds) >= best - 1e-9
    for k in range(2):
        for step in (0.03, -0.03):
            assert loss(model.weights, tuple(c + step * (j == k) for j, c in enumerate(model.thresholds))) >= best - 1e-9


def test_a_rows_grade_is_learnt_from_other_rows():
    # Each toxic row has a feature of its own, which nothing else could have taught: none is graded up for it.
    keys = [np.array([k]) for k in range(50)] + [np.array([60])] * 50
    toxic = np.arange(100) < 50
    assert set(toxicity.out_of_fold_grades(keys, [np.ones(1, int)] * 100, toxic)[:50]) == {1}


def test_conflicting_labels_and_repeated_ids(spark):
    docs = spark.createDataFrame([(k // 2, f"{'vile' if k // 2 % 2 else 'tree'} word{k % 7}") for k in range(400)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(200)] + [(k, 0) for k in range(200)], "doc_id long, toxic int")
    one, two = (toxicity.fit(docs.repartition(n), labels.repartition(n), max_labelled=120) for n in (2, 7))
    assert one == two and one.weights
