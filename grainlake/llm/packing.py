"""Packing by concatenate and cut.

Pass one tokenises each partition once, keeps every document's ids and its start within the partition,
and totals each partition. A prefix sum over those totals (one number a partition, on the driver) gives
each partition's place in the one long row of all ids. Pass two is row by row: a document's place is known,
so its cuts at multiples of the window are too. Documents that a window's border cuts give boundary records,
pieces marked as continuing to or from the neighbouring sequence.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches

#: Letters, marks and punctuation of Latin text, of which every Unicode version says the same.
_FAMILIAR = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE in a ``tokenizers`` file, as ``encode(add_special_tokens=False)`` gives them.

    Familiar (Latin) text goes through tiktoken's merge loop with that file's own vocabulary, which is
    several times as fast. Any other text goes through the library itself, as does everything where the
    file isn't a plain byte-level BPE whose ids follow its merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = self._fast(json.load(open(path, encoding="utf-8")))
        self.dtype = np.dtype("<u2") if self.exact.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        odd = spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not plain or odd or model.get("ignore_merges"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {a["content"]: a["id"] for a in spec["added_tokens"] if a["special"]}
        if len(special) < len(spec["added_tokens"]) or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            return None
        ranks = {bytes(back[c] for c in word): k for word, k in model["vocab"].items() if word not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(p)] for p in pairs]
        if made != sorted(set(made)):
            return None
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, self.dtype)
            elif self.fast is not None and _FAMILIAR.fullmatch(text):
                out[k] = self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype)
            else:
                rest.append(k)
        if rest:
            for k, got in zip(rest, self.exact.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = np.asarray(got.ids, self.dtype)
        return out


def tokenise(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """``part``, ``start`` (ids before the document in its partition), ``doc_id``, ``n_ids`` and ``ids``
    (little-endian, two bytes each for vocabularies up to 65,536), the end id included."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(df.sparkSession, 500)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), rows.schema["doc_id"], T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        encoder, part, start = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [x.tobytes() + end for x in encoder.encode(batch.column(1).to_pylist())]
            sizes = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column(0), pa.array(sizes), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def concatenate_and_cut(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack whole texts into sequences of ``window`` ids; one row a piece.

    ``doc_id, start, length, doc_tokens, sequence_id, offset, continued, continues, ids``: ``start`` counts the
    document's ids before the piece, ``ids`` is the piece as little-endian unsigned 32-bit numbers, ``continued``
    and ``continues`` mark boundary records. Every sequence but the last is full. Documents follow one another as
    the input's partitions hold them.

    Null and empty texts are the end id alone. Null or repeated ids are packed like any others, each row by
    itself. No input, no rows. Other columns are ignored, whatever their names.
    """
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16
    ids = materialise(tokenise(df, id_col, text_col, tokenizer_path, end_id), "token-ids")
    # One row for each partition of the input, so as many as it has splits.
    totals = dict(ids.groupBy("part").agg(F.max(F.col("start") + F.col("n_ids"))).collect())
    before, place = {}, 0
    for part in sorted(totals):
        before[part] = place
        place += totals[part]
    key = T.StructField("doc_id", ids.schema["doc_id"].dataType)
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    flags = [T.StructField(n, T.BooleanType()) for n in ("continued", "continues")]
    schema = T.StructType([key, *longs("start", "length", "doc_tokens", "sequence_id", "offset"), *flags, T.StructField("ids", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part, start, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            first = start + np.array([before[p] for p in part], np.int64)
            pieces = (first + size - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(size)), pieces)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // window + rank
            begin = np.maximum(first[row], sequence * window)
            stop = np.minimum(first[row] + size[row], (sequence + 1) * window)
            inside, length = begin - first[row], stop - begin
            wide_ids = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4") for x in batch.column(4).to_pylist()]
            cuts = [wide_ids[r][a : a + n].tobytes() for r, a, n in zip(row, inside, length)]
            doc = batch.column(2).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (inside, length, size[row], sequence, begin - sequence * window, inside > 0, inside + length < size[row])), pa.array(cuts, pa.binary())], names=schema.names)

    return ids.mapInArrow(cut, schema)
