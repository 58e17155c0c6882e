import re

import pytest

from grainlake.llm import fingerprint as fp
from grainlake.llm import queries


def units(text):
    return {u for u in re.split(r"\n+|(?<=[.!?]) +", text) if u}


def jaccard(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_an_edit_loses_a_sentence_and_not_its_line(spark):
    text = " ".join(f"Sentence {k} of a line." for k in range(20))
    assert len(text) < 1000
    rows = [(1, text), (2, "Other words stand here. " * 15)]
    got = {r.doc_id: r for r in fp.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    half = len(text) // 2
    want = jaccard(text, text[: len(text) - half] + rows[1][1][:half])
    assert want > 0.4 and got[1].near_edited == pytest.approx(want)


def test_query_counts_sentences_of_all_lines(spark, sf):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, sf).collect()}
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        assert got[key].near_edited == pytest.approx(jaccard(text, text[: len(text) - half] + after[:half]))
        assert got[key].near_next == pytest.approx(jaccard(text, after))
