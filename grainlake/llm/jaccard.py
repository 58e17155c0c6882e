"""N-gram Jaccard join by signature trees.

Which documents can be linked at all follows from the pigeonhole principle: sets a and b (a the smaller) with
Jaccard of at least t differ in at most |a| (1/t - 1) shingles, so of that many parts of the hash space and some
spare ones more they hold the same shingles in more than the spare ones. So each set may leave out as many of its parts
as there are spare ones, if all leave out by the same order: linked sets still share one that is left. The order is by
how many sets have the part, so what goes are the parts of passages that many documents share. Documents that share a
part that is left are a family; families lose no link. Within a family a signature tree is built: its nodes hold the OR
of their documents' bitmaps and their range of sizes. A dual traversal of trees drops pairs of nodes whose largest
possible overlap is too small for a link, and pairs that are linked throughout already; what is left is verified
shingle by shingle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grainlake.operators.components import connected_components

from .common import discard, materialise, small_batches

#: Bits of a signature, documents of a leaf, children of a node.
BITS, LEAF, FANOUT = 2048, 16, 8
#: Shingles that a block of a family holds, about (eight bytes each); larger families are cut into blocks.
BLOCK_SHINGLES = 12_000_000
#: Keys of parts that are sorted where texts are read, and that one task sorts after they are dealt out, about.
PACK_KEYS, BUCKET_KEYS = 1_500_000, 4_000_000
#: Bits of a key that count: so few of different keys are equal by chance, and then only a family is larger.
KEY_BITS = 48
#: Smallest sizes of successive size classes are about this far apart.
CLASS_RATIO = 1.4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of hashed word n-grams: A-Z in lower case, words between spaces and U+0009 to U+000D, sorted 64-bit hashes."""

    def __init__(self, words: int, remember: int = 400_000):
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes know ASCII alone
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in set(parts):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        n = min(self.words, len(h))  # a text of fewer words is one shingle, whose length is part of its hash
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _M1 + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def size_classes(n: int, least: Fraction, ratio: float = CLASS_RATIO) -> list[tuple[int, int, int]]:
    """(class, parts, spare) of a set of ``n`` shingles: of its own class, and of each one before if a set of that
    class can be a smaller partner. Two sets that can be linked share the class of the smaller one."""
    low, c, found = 1, 0, []
    while True:
        high = max(low + 1, int(low * ratio))  # the class's sizes are low to high - 1
        if high - 1 >= n * least or n < high:
            found.append((c, *_parts(high - 1, least)))
        if n < high:
            return found[::-1]
        low, c = high, c + 1


def _parts(largest: int, least: Fraction) -> tuple[int, int]:
    """Parts for sets of which the smaller has up to ``largest`` shingles, and how many more they are than needed: one
    more than such sets can differ in would be enough for one equal part, ``spare`` more give as many more."""
    differ = int(largest * (1 / least - 1))
    spare = -(-differ // 2)
    return differ + 1 + spare, spare


def parts_of(shingles: np.ndarray, least: Fraction, known: dict) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each size class of a set: a key for each part, from the class, the part and the shingles that fall into it;
    which parts hold any; and how many parts are spare. Linked sets have over ``spare`` equal parts in a class."""
    out, n = [], len(shingles)
    if n not in known:
        known[n] = size_classes(n, least)
    for c, parts, spare in known[n]:
        at = (shingles % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, _mix(shingles * _M1))
        tags = np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)
        keys = _mix(_mix(tags * _M1) + sums * _M2) >> np.uint64(65 - KEY_BITS)
        out.append((keys, np.bincount(at, minlength=parts) > 0, spare))
    return out


def part_keys(shingles: np.ndarray, least: Fraction, known: dict) -> np.ndarray:
    """The keys of all parts of a set that hold any shingle; of all parts, where more than the spare ones are empty."""
    return np.concatenate([k if (~held).sum() > spare else k[held] for k, held, spare in parts_of(shingles, least, known)])


def overlap_needed(a, b, least: Fraction):
    """The fewest common shingles with which sets of a and b of them are linked, in whole numbers."""
    p, q = least.numerator, least.denominator
    return -((-p * (a + b)) // (p + q))


class Node:
    __slots__ = ("rows", "children", "bits", "low", "high", "slack", "same")

    def __init__(self, rows, children, bits, low, high, slack):
        self.rows, self.children, self.bits, self.low, self.high, self.slack, self.same = rows, children, bits, low, high, slack, False


class Forest:
    """Signature trees over the sets of some documents, and which of them are known to be linked.

    ``sets`` are sorted hashes; ``group`` holds equal numbers for documents that are connected already. Pairs that are
    connected aren't looked at again, unless ``every`` link is asked for.
    """

    def __init__(self, sets: list[np.ndarray], least: Fraction, group: np.ndarray | None = None, every: bool = False):
        self.sets, self.least, self.every = sets, least, every
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for row, s in zip(bits, sets):
            spot = _mix(s) % np.uint64(BITS)
            np.bitwise_or.at(row, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        self.bits = bits
        # How many shingles of a document share a bit with another one of its own.
        self.slack = self.size - np.bitwise_count(bits).sum(1).astype(np.int64)
        if group is not None:
            first: dict[int, int] = {}
            for k, g in enumerate(group):
                self.parent[k] = first.setdefault(g, k)

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def build(self, rows: np.ndarray) -> Node:
        """A tree of ``rows``: sorted by size and smallest hashes, so that leaves hold documents that are alike."""
        lead = np.array([self.sets[k][:2].tolist() + [0] * (2 - len(self.sets[k][:2])) for k in rows], np.uint64)
        rows = rows[np.lexsort((lead[:, 1], lead[:, 0], np.log(self.size[rows]) // 0.1))]
        nodes = [self._leaf(rows[k : k + LEAF]) for k in range(0, len(rows), LEAF)]
        while len(nodes) > 1:
            nodes = [self._join(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)]
        return nodes[0]

    def _leaf(self, rows: np.ndarray) -> Node:
        return Node(rows, [], np.bitwise_or.reduce(self.bits[rows], 0), self.size[rows].min(), self.size[rows].max(), self.slack[rows].max())

    @staticmethod
    def _join(nodes: list[Node]) -> Node:
        if len(nodes) == 1:
            return nodes[0]
        return Node(nodes[0].rows[:1], nodes, np.bitwise_or.reduce([n.bits for n in nodes], 0), min(n.low for n in nodes), max(n.high for n in nodes), max(n.slack for n in nodes))

    def uniform(self, node: Node) -> bool:
        """Whether all documents under a node are connected; once they are they stay so."""
        if self.every:
            return False
        if not node.same:
            if node.children:
                node.same = all(map(self.uniform, node.children)) and len({self.find(c.rows[0]) for c in node.children}) == 1
            else:
                node.same = len({self.find(k) for k in node.rows}) == 1
        return node.same

    def apart(self, x: Node, y: Node) -> bool:
        """Whether no document of x can be linked with one of y: by size, or by the largest possible overlap."""
        p, q = self.least.numerator, self.least.denominator
        if q * x.high < p * y.low or q * y.high < p * x.low:
            return True
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        return min(most, x.high, y.high) < overlap_needed(x.low, y.low, self.least)

    def within(self, node: Node) -> None:
        """Link all documents of a tree among themselves."""
        if self.uniform(node):
            return
        if not node.children:
            self._verify(node.rows, node.rows, True)
            return
        for child in node.children:
            self.within(child)
        for k, x in enumerate(node.children):
            for y in node.children[k + 1 :]:
                self.between(x, y)

    def between(self, x: Node, y: Node) -> None:
        """Link the documents of one tree with those of another."""
        if self.apart(x, y) or self.uniform(x) and self.uniform(y) and self.find(x.rows[0]) == self.find(y.rows[0]):
            return
        if not x.children and not y.children:
            self._verify(x.rows, y.rows, False)
        elif y.children and (not x.children or x.high + x.slack < y.high + y.slack or len(y.children) > len(x.children)):
            for child in y.children:
                self.between(x, child)
        else:
            for child in x.children:
                self.between(child, y)

    def _verify(self, xs: np.ndarray, ys: np.ndarray, same: bool) -> None:
        a, b = self.size[xs][:, None], self.size[ys][None, :]
        need = overlap_needed(a, b, self.least)
        most = np.bitwise_count(self.bits[xs][:, None, :] & self.bits[ys][None, :, :]).sum(2).astype(np.int64)
        most = np.minimum(most + np.minimum(self.slack[xs][:, None], self.slack[ys][None, :]), np.minimum(a, b))
        could = most >= need
        if same:
            could &= np.arange(len(xs))[:, None] < np.arange(len(ys))[None, :]
        for i, j in np.argwhere(could):
            k, m = xs[i], ys[j]
            r, s = self.find(k), self.find(m)
            if (r != s or self.every) and self._common(k, m) >= need[i, j]:
                self.parent[max(r, s)] = min(r, s)
                self.links.append((k, m))

    def _common(self, k: int, m: int) -> int:
        x, y = self.sets[k], self.sets[m]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _node(s: np.ndarray) -> int:
    """A 64-bit hash of a set: rows with equal sets are one node of the graph."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the smallest node of each, and pairs of every other node of a key with it."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    least = nodes[new][np.cumsum(new) - 1]
    other = nodes != least
    pairs = np.unique(np.stack([nodes[other], least[other]], 1), axis=0)
    return keys[new], nodes[new], pairs


def _split(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as their upper 16 bits, which compress to next to nothing, and their lower 32."""
    return (keys >> np.uint64(32)).astype("<u2").tobytes(), keys.astype("<u4").tobytes()


def _node_keys(nodes: np.ndarray) -> np.ndarray:
    """A key for each node, to count in how many packs it is: the upper half of all keys, which parts don't have."""
    return (_mix(nodes.astype(np.uint64) * _M2) >> np.uint64(65 - KEY_BITS)) | np.uint64(1 << (KEY_BITS - 1))


def _whole(high: bytes, low: bytes) -> np.ndarray:
    return (np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)) | np.frombuffer(low, "<u4")


class Pack:
    """Some documents, their sets' sizes and nodes, and the sorted keys of their parts.

    A group is a set in one of its size classes; ``owners`` are the groups of the keys. A set's copies have no part
    in it again. Empty parts come last in every order of parts, by their keys: ``rare`` are the keys of those that a
    group can't leave out, and ``drop`` is how many of its other parts it leaves out.
    """

    def __init__(self, least: Fraction):
        self.least, self.classes, self.held = least, {}, 0
        self.ids, self.sizes, self.nodes, self.known = [], [], [], set()
        self.keys, self.owners, self.group_nodes, self.drop, self.rare, self.rare_owners = [], [], [], [], [], []

    def add(self, key, shingles: np.ndarray) -> None:
        node = _node(shingles)
        self.ids.append(key)
        self.sizes.append(len(shingles))
        self.nodes.append(node)
        if not len(shingles) or node in self.known:
            return
        self.known.add(node)
        for keys, held, spare in parts_of(shingles, self.least, self.classes):
            group, empty = len(self.drop), np.sort(keys[~held])
            self.group_nodes.append(node)
            self.drop.append(max(0, spare - len(empty)))
            self.keys.append(keys[held])
            self.owners.append(np.full(len(self.keys[-1]), group, np.uint32))
            self.held += len(self.keys[-1])
            for k in empty[: max(0, len(empty) - spare)]:
                self.rare.append(k)
                self.rare_owners.append(group)

    def row(self, number: int) -> tuple:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        owners = np.concatenate(self.owners) if self.owners else np.zeros(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        small = "<u2" if len(self.drop) <= 1 << 16 else "<u4"
        packed = [np.array(x, t).tobytes() for x, t in ((self.group_nodes, "<i8"), (self.drop, "<i4"), (self.rare, "<u8"), (self.rare_owners, "<u4"))]
        return number, self.ids, self.sizes, self.nodes, self.held, *_split(keys[order]), owners[order].astype(small).tobytes(), *packed


_PACKED = ["pack", "ids", "sizes", "nodes", "n_keys", "high", "low", "owners", "group_nodes", "drop", "rare", "rare_owners"]


def packs(rows: DataFrame, words: int, least: Fraction, at_once: int = PACK_KEYS) -> DataFrame:
    """``Pack``s of ``rows(id, text)``, of about ``at_once`` keys each: the only pass over all texts."""
    small_batches(rows.sparkSession)
    kind = T.StructField("id", rows.schema["id"].dataType)
    arrow = to_arrow_schema(T.StructType([T.StructField("ids", T.ArrayType(kind.dataType))])).field(0).type
    longs, binary = T.ArrayType(T.LongType()), T.BinaryType()
    schema = T.StructType([T.StructField(n, t) for n, t in zip(_PACKED, (T.LongType(), T.ArrayType(kind.dataType), longs, longs, T.LongType(), *[binary] * 7))])
    types = [pa.int64(), arrow, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 7]

    def run(batches):
        shingler, number, pack = Shingler(words), TaskContext.get().partitionId() << 32, Pack(least)

        def made():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(pack.row(number), types)], names=_PACKED)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack.add(key, shingler(text))
                if pack.held >= at_once or len(pack.ids) >= at_once:
                    yield made()
                    number, pack = number + 1, Pack(least)
        if pack.ids:
            yield made()

    return rows.mapInArrow(run, schema)


def repeated_keys(packed: DataFrame, bits: int) -> DataFrame:
    """``pack, high, low, n``: the keys of each pack that several sets have, in this pack or in all, and how many do;
    the same of its nodes, of which each pack holds one copy.

    A pack counts its keys before they are dealt out by their first ``bits``, so a key of very many sets is one number
    a pack. Keys go in sorted pieces, six bytes each.
    """

    def deal(batches):
        for batch in batches:
            for number, high, low, nodes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                named = _node_keys(np.unique(np.frombuffer(nodes, "<i8")))
                keys, n = np.unique(np.concatenate([_whole(high, low), np.unique(named)]), return_counts=True)
                bucket = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
                rows = []
                for a, b in zip(begin, [*begin[1:], len(keys)]):
                    counts = n[a:b].astype("<u4").tobytes() if (n[a:b] > 1).any() else b""  # mostly each is one
                    rows.append((int(bucket[a]), number, *_split(keys[a:b]), counts))
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024]), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "pack", "high", "low", "n"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_whole(h, w) for h, w in zip(pdf["high"], pdf["low"])]
        n = np.concatenate([np.frombuffer(c, "<u4") if c else np.ones(len(k), "<u4") for k, c in zip(each, pdf["n"])])
        every = np.concatenate(each)
        order = np.argsort(every, kind="stable")
        new = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        sums = np.add.reduceat(n[order].astype(np.int64), new)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(sums, np.diff(np.r_[new, len(every)]))
        out, at = [], 0
        for number, keys in zip(pdf["pack"], each):
            mine = total[at : at + len(keys)]
            at += len(keys)
            often = mine > 1
            if often.any():
                out.append((number, *_split(keys[often]), np.minimum(mine[often], (1 << 32) - 1).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["pack", "high", "low", "n"])

    dealt = packed.select("pack", "high", "low", "group_nodes").mapInArrow(deal, "bucket long, pack long, high binary, low binary, n binary")
    return dealt.groupBy("bucket").applyInPandas(count, "pack long, high binary, low binary, n binary")


def kept_parts(packed: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """``bucket, keys, nodes, places``: of each pack the parts that its sets don't leave out and that others have too.

    A set that has copies in several packs counts as often; parts that no more sets have than that are its own.
    Nodes that meet in a pack are linked there, a row without keys, and one of them goes on for each key. The others
    are dealt out by the first ``bits`` of their keys, packed.
    """

    def keep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for pack in left.itertuples(index=False):
            keys, group_nodes = _whole(pack.high, pack.low), np.frombuffer(pack.group_nodes, "<i8")
            owners = np.frombuffer(pack.owners, "<u2" if len(group_nodes) <= 1 << 16 else "<u4").astype(np.int64)
            often = np.concatenate([_whole(h, w) for h, w in zip(right["high"], right["low"])]) if len(right) else np.zeros(0, np.uint64)
            if len(often):
                n = np.concatenate([np.frombuffer(c, "<u4") for c in right["n"]])
                order = np.argsort(often)
                often, n = often[order], n[order]

                def times(wanted: np.ndarray, often=often, n=n) -> np.ndarray:
                    at = np.minimum(np.searchsorted(often, wanted), len(often) - 1)
                    return np.where(often[at] == wanted, n[at], 1).astype(np.int64)

                n = times(keys)
                # No part is had less often than its set.
                fewest = np.full(len(group_nodes), 1 << 32)
                np.minimum.at(fewest, owners, n)
                shared = n > np.minimum(times(_node_keys(group_nodes)), fewest)[owners]
                keys, owners, n = keys[shared], owners[shared], n[shared]
                # Of each group, in the order of how many sets have the part, all but the last ones.
                order = np.lexsort((keys, n, owners))
                keys, owners = keys[order], owners[order]
                have = np.bincount(owners, minlength=len(group_nodes))
                rank = np.arange(len(owners)) - (np.cumsum(have) - have)[owners]
                stay = rank < (have - np.frombuffer(pack.drop, "<i4"))[owners]
                keys, owners = keys[stay], owners[stay]
            else:
                keys, owners = keys[:0], owners[:0]
            keys = np.concatenate([keys, np.frombuffer(pack.rare, "<u8")])
            owners = np.concatenate([owners, np.frombuffer(pack.rare_owners, "<u4").astype(np.int64)])
            key, node, pairs = _stars(keys, group_nodes[owners])
            bucket = (key >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(begin, [*begin[1:], len(key)]):
                own, place = np.unique(node[a:b], return_inverse=True)
                rows.append((int(bucket[a]), key[a:b].tobytes(), own.tobytes(), place.astype(np.uint32).tobytes()))
            for at in range(0, len(pairs), 100_000):
                rows.append((int(pairs[at, 0] % (1 << bits)), b"", pairs[at : at + 100_000].tobytes(), b""))
        return pd.DataFrame(rows, columns=["bucket", "keys", "nodes", "places"])

    mine = packed.select("pack", "high", "low", "owners", "group_nodes", "drop", "rare", "rare_owners")
    return mine.groupBy("pack").cogroup(repeated.groupBy("pack")).applyInPandas(keep, "bucket long, keys binary, nodes binary, places binary")


def shared_parts(packed: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``node, least`` for ``packed``: each node that shares a part that is left with others, and the smallest node of
    those.

    As many buckets of keys as keep ``bucket_keys`` in each: what a task sorts doesn't grow with the table.
    """
    total = packed.agg(F.sum("n_keys")).first()[0] or 0
    bits = 1 + max(4, int(np.ceil(np.log2(max(1.0, total / bucket_keys)))))  # parts have the lower half of all keys

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, pairs = [], [], []
        for key, node, place in zip(pdf["keys"], pdf["nodes"], pdf["places"]):
            own = np.frombuffer(node, np.int64)
            if key:
                keys.append(np.frombuffer(key, np.uint64))
                nodes.append(own[np.frombuffer(place, np.uint32)])
            else:
                pairs.append(own.reshape(-1, 2))
        if keys:
            pairs.append(_stars(np.concatenate(keys), np.concatenate(nodes))[2])
        found = np.unique(np.concatenate(pairs), axis=0)
        return pd.DataFrame({"node": found[:, 0], "least": found[:, 1]})

    kept = kept_parts(packed, repeated_keys(packed, bits), bits)
    return kept.groupBy("bucket").applyInPandas(meet, "node long, least long")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """``n, node, hashes`` of each row of ``texts(text)``."""
    small_batches(texts.sparkSession)

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            nodes, sizes = np.array([_node(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "node", "hashes"])

    return texts.mapInArrow(run, "n long, node long, hashes binary")


def _traverse(pdf: pd.DataFrame, least: Fraction, every: bool) -> pd.DataFrame:
    """Links among the documents of a group, in blocks 0 and, for a pair of blocks, 1: those that connect them, or
    ``every`` one."""
    forest = Forest([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], least, None if every else pdf["group"].to_numpy(), every)
    side = pdf["side"].to_numpy()
    if side.any():
        forest.between(forest.build(np.flatnonzero(side == 0)), forest.build(np.flatnonzero(side == 1)))
    else:
        forest.within(forest.build(np.arange(len(pdf))))
    node = pdf["node"].to_numpy()
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"src": node[pairs[:, 0]], "dst": node[pairs[:, 1]]})


def _linked(rows: DataFrame, key: list[str], least: Fraction, every: bool) -> DataFrame:
    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        return _traverse(pdf, least, every)

    return rows.groupBy(*key).applyInPandas(linked, "src long, dst long")


def _sets_and_links(df: DataFrame, id_col: str, text_col: str, words: int, least: Fraction, block_shingles: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """``id, n, node`` of every row, and links between nodes; tables that are still read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = materialise(packs(rows, words, least), "packs")
    sets = materialise(packed.select(F.explode(F.arrays_zip("ids", "sizes", "nodes")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.sizes").alias("n"), F.col("x.nodes").alias("node")), "shingle-sets")
    families = connected_components(shared_parts(packed), "node", "least")
    discard(packed)
    links = _family_links(rows, sets, families.select(F.col("id").alias("node"), F.col("label").alias("family")), words, least, block_shingles, every)
    discard(families)
    return sets, links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: Fraction = Fraction(9, 10), block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set of word n-grams, and the smallest id of
    the rows that it reaches by links, pairs with a Jaccard of at least ``least``.

    Rows with equal sets are one node of the graph from the start. Families of over ``block_shingles`` are cut into
    blocks by a hash; blocks are linked within, then with the next one, then, only where a family still isn't one
    component, with every other whose documents aren't all of the same component.

    Null and empty texts, and texts of white space, have no shingles and link with nothing; their component is their
    own id. A null id is never the smallest; rows that repeat an id are rows of their own. No rows, no rows. Other
    columns are ignored, whatever their names. Ids may be of any type that has an order.
    """
    sets, links = _sets_and_links(df, id_col, text_col, words, least, block_shingles, False)
    labels = connected_components(links)
    groups = labels.select(F.col("id").alias("node"), F.col("label").alias("group"))
    # Tables on both sides, as only sides that come straight from their exchanges let the rows of a hot group be split.
    nodes = materialise(sets.join(groups, "node", "left").withColumn("top", F.coalesce("group", "node")).drop("group", "node"), "grouped")
    discard(sets, links, labels)
    tops = materialise(nodes.where("n > 0").groupBy("top").agg(F.min("id").alias("first")), "groups")
    found = nodes.join(tops, "top", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: Fraction = Fraction(9, 10), block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Every link, as pairs of classes and their members: ``class_a, class_b`` of each two different sets that are
    linked, the smaller class first, and ``doc_id, n_shingles, class_id`` of every row; equal sets are one class.

    A class is a number. Copies aren't expanded into pairs, but the number of pairs within a group of sets that are
    all alike grows with its square. Odd rows: as in ``jaccard_components``; sets without shingles have no class.
    """
    sets, links = _sets_and_links(df, id_col, text_col, words, least, block_shingles, True)
    pairs = links.select(F.least("src", "dst").alias("class_a"), F.greatest("src", "dst").alias("class_b")).distinct()
    return pairs, sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("class_id"))


def _family_links(rows: DataFrame, sets: DataFrame, families: DataFrame, words: int, least: Fraction, block_shingles: int, every: bool) -> DataFrame:
    """Links between nodes of the same family, enough to connect all that are linked, or ``every`` one."""
    # Copies are one row before the join, so that a hot node is one.
    reps = sets.where("n > 0").groupBy("node", "n").agg(F.min("id").alias("id")).join(families, "node")
    reps = materialise(reps, "family-reps")
    total = reps.groupBy("family").agg(F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") / block_shingles)
    placed = reps.join(total, "family").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("blocks", blocks.cast("int"))
    placed = materialise(placed.select("node", "family", "n", F.col("id").alias("rep"), "block", "blocks"), "family-nodes")
    # Only texts whose rows stand for a node of a family are read into sets. Their ids grow with the table, so they are
    # dealt out with the texts at every size.
    ids = materialise(placed.select("rep").distinct(), "family-ids")
    texts = rows.join(ids.hint("merge"), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    hashes = _hashed(texts, words).dropDuplicates(["node"])
    full = materialise(hashes.join(placed.select("node", "family", "block", "blocks"), "node"), "family-sets")
    own = F.lit(0).alias("side")
    alone = full.withColumn("group", F.col("node"))
    links = materialise(_linked(alone.select("node", "hashes", "group", own, "family", "block"), ["family", "block"], least, every), "links")
    discard(reps, ids)
    many = placed.where("blocks > 1").select("node", "family", "block", "blocks")
    steps = 0 if many.isEmpty() else 1 if every else 2
    for step in range(steps):
        known = many.withColumn("group", F.col("node"))
        if not every:
            labels = connected_components(links)
            groups = labels.select(F.col("id").alias("node"), F.col("label").alias("group"))
            known = many.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
        known = materialise(known, "groups")
        if not every:
            discard(labels)
        # A block all of one component has that as its only one; a family of one component is done.
        each = known.groupBy("family", "block", "blocks").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        if not every:
            open_ = each.groupBy("family").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("family")
            each = each.join(open_, "family", "left_semi")
        other = each.select(*(F.col(c).alias(f"{c}_2") for c in ("family", "block", "low", "high")))
        # First each block with the next one, the last with the first; then the pairs that are left.
        gap = F.col("block_2") - F.col("block")
        beside = (gap == 1) | ((gap == F.col("blocks") - 1) & (gap > 1))
        after = (gap > 0) & (F.lit(True) if every else beside if step == 0 else ~beside)
        done = F.lit(False) if every else (F.col("low") == F.col("high")) & (F.col("low_2") == F.col("high_2")) & (F.col("low") == F.col("low_2"))
        pairs = each.join(other, (F.col("family") == F.col("family_2")) & after).where(~done)
        sides = F.array(F.struct(F.col("block").alias("own"), F.lit(0).alias("side")), F.struct(F.col("block_2").alias("own"), F.lit(1).alias("side")))
        pairs = materialise(pairs.select("family", "block", "block_2", F.inline(sides)).withColumnsRenamed({"block": "one", "block_2": "two", "own": "block"}), "block-pairs")
        if not pairs.isEmpty():
            shipped = full.select("node", "hashes").join(known, "node").join(pairs, ["family", "block"])
            more = _linked(shipped.select("node", "hashes", "group", "side", "family", "one", "two"), ["family", "one", "two"], least, every)
            before, links = links, materialise(links.unionByName(more), "links")
            discard(before)
        discard(known, pairs)
    discard(placed, full)
    return links
