from collections import Counter

import corpus_pipeline as cp


def test_rows_without_id_count_for_themselves(spark, sf):
    # By weights 1, 2 and 3 source a is taken for less than its size, c for more.
    rows = [(None, f"a{k} " * 10, "a") for k in range(12)] + [(None, f"b{k} " * 10, "b") for k in range(12)] + [(None, f"c{k} " * 10, "c") for k in range(12)]
    rows += [(k, f"n{k} " * 10, "abc"[k % 3]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    words = Counter()
    for r in cp.mix_sources(spark, docs, sf).collect():
        words[r.source] += len(r.text.split())
    assert words == {"a": 80, "b": 160, "c": 240}


def test_an_id_of_two_sources_counts_by_source(spark, sf):
    rows = [(k, f"{s}{k} " * 10, s) for k in range(12) for s in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    words = Counter()
    for r in cp.mix_sources(spark, docs, sf).collect():
        words[r.source] += len(r.text.split())
    assert words == {"a": 60, "b": 120, "c": 180}


def test_rows_that_repeat_an_id_count_by_their_texts(spark, sf):
    rows = [(k // 4, f"{s}{k} " * 10, s, "y") for k in range(12) for s in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix string").repartition(3)
    words = Counter()
    got = cp.mix_sources(spark, docs, sf)
    for r in got.collect():
        words[r.source] += len(r.text.split())
    assert words == {"a": 60, "b": 120, "c": 180} and got.columns == docs.columns
