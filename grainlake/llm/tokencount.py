"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens lie in one flat array of symbol ids with their offsets (a ragged array). Each round
looks up the rank of every neighbouring pair, finds the lowest rank of each pre-token, and merges that pair
wherever it stands in it, for all pre-tokens of the batch at once. What is left when no pair has a rank are tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: White space of Unicode; Python also counts four separators, which str.split() and \s take.
_SPACE, _ODD = re.compile(r"[^\S\x1c-\x1f]+"), re.compile(r"[\x1c-\x1f]")
#: Pre-tokens of the file's own pattern, for lower-case printable ASCII.
_ASCII_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class MergeTable:
    """Merges of a byte-level BPE file with word ends, as arrays sorted by pair."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only plain BPE files are supported")
        self.base, self.suffix = 1 + max(vocab.values()), model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = {c: k for c in vocab if len(c) == 1 for k in [ord(c)]}
        self.inner, self.final = np.full(1 + max(letters.values()), -1, np.int64), np.full(1 + max(letters.values()), -1, np.int64)
        for c, k in letters.items():
            self.inner[k], self.final[k] = vocab[c], vocab.get(c + self.suffix, -1)
        self.special = [a["content"] for a in spec["added_tokens"]]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """How many symbols survive in each non-empty pre-token."""
        if not tokens:
            return np.zeros(0, np.int64)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        letters = np.frombuffer("".join(tokens).encode("utf-32-le"), "<u4")
        flat, ends = self.inner[letters], np.cumsum(length) - 1
        flat[ends] = self.final[letters[ends]]  # the last byte letter of a pre-token carries the word end
        owner = np.repeat(np.arange(len(tokens)), length)
        left, none = length.copy(), np.iinfo(np.int64).max
        while len(flat) > 1:
            pair = flat[:-1] * self.base + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[at], none)
            # Pre-tokens lie one after another, so the lowest rank of each is a reduction over its stretch.
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            busy = np.repeat(lowest, np.diff(np.r_[starts, len(flat)]))
            hit = known & (rank == busy[:-1])
            if not hit.any():
                break
            # Of touching hits (a pair of like symbols) every second is used up by the one before.
            k = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(k) > 1]
            k = k[(np.arange(len(k)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            flat[k] = self.made[at[k]]
            left -= np.bincount(owner[k], minlength=len(left))
            keep = busy < none  # what has no pair left is done
            keep[k + 1] = False
            flat, owner = flat[keep], owner[keep]
        return left


class Counter:
    """Tokens of texts, counted as the library for the file counts them with its defaults and without added tokens.

    White space only separates here, so a text falls into chunks, and equal chunks count alike. Normalising and
    pre-tokenising of new chunks is the library's own; merging is ``MergeTable``'s.
    """

    def __init__(self, path: str, remember: int = 300_000):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.table, self.normalise, self.split = MergeTable(path), library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")") if self.table.special else None
        spec = json.load(open(path, encoding="utf-8"))
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.ascii = json.dumps(_ASCII_PATTERN) in steps and steps.count('"type": "') == 7 and '"Lowercase"' in steps
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.remember = remember

    def _parts(self, chunk: str) -> tuple[int, list[str]]:
        """Special tokens in a chunk, and the pre-tokens of the rest."""
        if self.ascii and chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return 0, _ASCII.findall(chunk.lower())
        cuts = self.special.split(chunk) if self.special and "<" in chunk else [chunk]
        return len(cuts) // 2, [p for c in cuts[::2] if c for p, _ in self.split(self.normalise(c)) if p]

    def count(self, texts: list[str | None]) -> list[int]:
        chunks = [() if not t else [c for c in _SPACE.split(t) if c] if _ODD.search(t) else t.split() for t in texts]
        for limit in (self.known, self.pieces):
            if len(limit) > self.remember:
                limit.clear()
        new = {c for cs in chunks for c in cs if c not in self.known}
        parts = {c: self._parts(c) for c in new}
        fresh = list({p for _, ps in parts.values() for p in ps if p not in self.pieces})
        self.pieces |= zip(fresh, self.table.counts(fresh).tolist())
        self.known |= {c: n + sum(map(self.pieces.__getitem__, ps)) for c, (n, ps) in parts.items()}
        return [sum(map(self.known.__getitem__, cs)) for cs in chunks]


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, row by row and without a shuffle.

    Null texts count as empty: 0 bytes, 0 tokens. Null and repeated ids are kept as they are. No rows, no rows.
    Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(df.sparkSession, 500)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        counter = Counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter.count(texts), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
