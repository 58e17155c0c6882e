import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from grainlake.llm import packing, queries, tokencount
from odd import ROWS, empty, odd
from tokenizers import Tokenizer

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
STRANGE = ["", None, "<|endoftext|>a <|startoftext|><|endoftext|>b's aaaaaaaaaaaaa ABC\x1cdéf\x85x　y  z", "é é ́x İstanbul ΣΑΣ ſ K", "a" * 3001, "日本語テキスト １２３ ٣٤ 👍🏽👨‍👩‍👧 \U0010ffff", "  lead\n\n  trail \n ", "﻿x​᠎y", "<|ENDOFTEXT|> <|endoftext|", "\x00\x01 don't WE'LL I'M"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    letters = "ab AB'sStT \n\t\x0b\x1c\x1f \xa0é́İΣ日12٣²½ªǅß<|endoftext|>ﬁ"
    return [*STRANGE, *("".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1500))]


def test_merging_counts_as_the_library_does(texts):
    library, counter = Tokenizer.from_file(WORDS), tokencount.Counter(WORDS, remember=500)
    assert counter.ascii
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert counter.count(some) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in some]


def test_encoder_gives_the_librarys_ids(texts):
    library, encoder = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    assert encoder.fast is not None and encoder.dtype.itemsize == 2
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_encoder_on_a_million_strings():
    # Latin text takes another way than the library's own; a million short strings of what can meet in it agree.
    library, encoder, rng = Tokenizer.from_file(BYTES), packing.Encoder(BYTES), np.random.default_rng(7)
    letters = [*"etaoin shrdlu", *"ETAOIN", *"0123456789", *" \t\n\r\x0b\x0c\x1c\x85\xa0", *".,;:!?'\"()-_/&<>|@#", *"éèüßñçøåžšćđłőÆŒªº²½µ", *"‘’“”–—…‰€⁄", *"'s't're've'm'll'd"]
    words = [" the", "ing ", "<|endoftext|>", "\r\n", "  ", "don't", "I'LL", "http://", "1999", "naïve"]
    parts = np.array(letters + words, dtype=object)
    assert all(map(packing._FAMILIAR.fullmatch, parts))
    for _ in range(20):
        picked, size = rng.integers(0, len(parts), 600_000), rng.integers(0, 24, 50_000)
        ends = np.cumsum(size) % 600_000
        texts = ["".join(parts[picked[max(0, e - n) : e]]) for e, n in zip(ends.tolist(), size.tolist())]
        wanted = library.encode_batch_fast(texts, add_special_tokens=False)
        assert all(a.tolist() == b.ids for a, b in zip(encoder.encode(texts), wanted))


def test_token_counts_query(spark):
    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in queries.op3_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(got[r.doc_id])[:4] == (r.doc_id, len((r.text or "").encode()), n, n > 2048)
    odd_rows = tokencount.count_tokens(odd(spark), WORDS).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in odd_rows) == sorted((str(x[0]), len((x[1] or "").encode())) for x in ROWS)
    assert tokencount.count_tokens(empty(spark), WORDS).count() == 0


def unpacked(pieces, rows, window=1024):
    """Put the pieces together again: gapless sequences, gapless documents, the library's ids."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(str(p.doc_id), []).append(p)
    last = max(by_sequence, default=-1)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, ps in by_sequence.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert sum(p.length for p in ps) == window or s == last
    library = Tokenizer.from_file(BYTES)
    for key in {str(i) for i, _ in rows}:
        want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if str(i) == key)
        ps = sorted(by_doc[key], key=lambda p: (p.sequence_id, p.offset))
        got, current = [], []
        for p in ps:
            assert p.start == len(current) and p.continued == (p.start > 0) and p.continues == (p.start + p.length < p.doc_tokens)
            current += np.frombuffer(p.ids, "<u4").tolist()
            if not p.continues:
                assert len(current) == p.doc_tokens
                got, current = [*got, current], []
        assert sorted(got) == want and not current


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.concatenate_and_cut(docs.repartition(5), BYTES).collect()
    unpacked(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    for p, r in zip(sorted(map(tuple, queries.op10_packing(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())), sorted(packing.concatenate_and_cut(docs, BYTES).collect(), key=lambda p: (p.doc_id, p.start))):
        assert p == (r.doc_id, r.start, r.length, zlib.crc32(r.ids))


def test_packing_odd_rows(spark):
    for window in (1, 7, 1024):
        unpacked(packing.concatenate_and_cut(odd(spark).where("coalesce(doc_id, 0) <> 9"), BYTES, window=window).collect(), [(r[0], r[1]) for r in ROWS if r[0] != 9], window)
    unpacked(packing.concatenate_and_cut(odd(spark), BYTES).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.concatenate_and_cut(empty(spark), BYTES).count() == 0
