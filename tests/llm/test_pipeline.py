from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from grainlake.llm.common import materialise
from grainlake.llm.toxicity import fit, score
from odd import SCHEMA, empty, odd
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_linededup import brute as lines
from test_mixing import fill
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = materialise(cp.drop_toxic(spark, docs, sf), "t1")
    p = {r.doc_id: r.p_toxic for r in score(docs, fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, v in p.items() if v <= 0.5} and len(p) > len(kept.collect())

    cut = materialise(cp.drop_site_lines(spark, kept, sf), "t2")
    before, after = ({r.doc_id: r for r in x.collect()} for x in (kept, cut))
    rows = sorted(before.values())
    want = lines([(r.source, r.text) for r in rows], 0.1, 3)
    assert [after[r.doc_id].text for r in rows] == want and all(r.n_chars == len(r.text) for r in after.values())

    one = materialise(cp.keep_one_of_each_group(spark, cut, sf), "t3")
    found = components(sorted((r.doc_id, r.text) for r in after.values()), cp.WORDS, cp.SIMILARITY)
    stay = {int(i) for i, _, c in found if str(c) == i}
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for i, r in after.items() if i in stay) and len(stay) < len(after)

    mixed = materialise(cp.mix_sources(spark, one, sf), "t4")
    size = {r.doc_id: len((r.text or "").encode().split()) for r in one.collect()}
    source = {r.doc_id: r.source for r in one.collect()}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    targets = fill(dict(sums), {s: k % 3 + 1 for k, s in enumerate(sorted(sums))})
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) <= 3
    for s, target in targets.items():
        took = sum(times[i] * size[i] for i in source if source[i] == s)
        assert abs(took - target) <= max(size[i] for i in source if source[i] == s)

    pieces = cp.pack(spark, mixed, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    flat = np.concatenate([np.frombuffer(x.ids, "<u4") for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset))])
    want_ids = Counter(tuple([*library.encode(r.text, add_special_tokens=False).ids, 0]) for r in mixed.collect())
    ends = np.flatnonzero(flat == 0)
    assert sum(len(k) * n for k, n in want_ids.items()) == len(flat) and flat[-1] == 0 and len(ends) >= len(mixed.collect())
    assert Counter(x.doc_id for x in pieces if not x.continued) == times


def test_run_is_the_stages_in_turn(spark, sf):
    assert [s for s, _ in cp.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    assert cp.ORACLE_SQL is None and cp.run(spark, sf).count() > 0


def test_odd_rows(spark, sf):
    for docs in (odd(spark), empty(spark)):
        for _, stage in cp.STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf), "odd")
            assert docs.columns == SCHEMA.names
        assert cp.pack(spark, docs, sf).count() >= 0
    kept = cp.keep_one_of_each_group(spark, odd(spark), sf)
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[5] == 0 and ids[2] == 1 and max(ids.values()) == 1
    assert kept.where(F.col("text").isNull()).count() == 1


def test_rows_are_themselves_whatever_their_id(spark, sf):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one, "s", "x"), (1, two, "s", "x"), (None, "u v w x y z", "s", "x"), (None, two, "s", "x"), (7, "q q q", "s", "x"), (7, "q q q", "s", "x"), (8, None, "s", "x"), (8, None, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string").repartition(3)
    kept = sorted(map(str, (tuple(r) for r in cp.keep_one_of_each_group(spark, docs, sf).collect())))
    # Both texts of id 1 stay, the copy without an id goes, rows alike throughout are one; those without words all stay.
    assert kept == sorted(map(str, [rows[0], rows[1], rows[2], rows[4], rows[6], rows[7]]))
