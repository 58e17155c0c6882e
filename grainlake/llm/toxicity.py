"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 very toxic. P(grade > k) is the logistic function of one weighted sum of the
text's features less a threshold that grows with k; the weights are shared by all thresholds, and the expected
severity is the sum of these probabilities.

Labels of more than two values are grades themselves. Labels that say toxic or not leave open how toxic a row is; there a
toxic row's grade is 2 where it has more features that mark toxic rows, repeats counted, than the median toxic row,
and what marks toxic rows is learnt from the other folds of the sample, never from the row itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainlake.operators.optimum import Stop, bfgs

from .common import small_batches

#: Labelled rows that a fit takes at most, in the order of a hash of their ids; buckets of features; features kept.
MAX_LABELLED, BUCKETS, KEPT = 8_000, 1 << 20, 512
#: Features count if their log odds in toxic and other rows, and their G statistic, are above these.
MIN_ODDS, MIN_G = 1.5, 18.0
#: Folds of the sample, and the log odds from which a feature marks toxic rows.
FOLDS, MARKING = 5, 2.0
_WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[int]:
    """Buckets of a word: itself, and its beginnings of four to seven letters, as stems of longer words."""
    keys = [word + "$", *(word[:k] for k in range(4, min(8, len(word))))]
    return [zlib.crc32(k.encode()) % BUCKETS for k in keys]


def _count(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _value(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


@dataclass
class Model:
    """Weights of the features kept, by bucket, and the ordered thresholds; without labels of both kinds, neither."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - sums[:, None], -50, 50)))

    def scorer(self):
        """A function of texts to weighted sums, that remembers which features kept a word has."""
        known: dict[str, tuple[int, ...]] = {}

        def sums(texts: list[str | None]) -> np.ndarray:
            if len(known) > 1_000_000:
                known.clear()
            out = np.zeros(len(texts))
            for k, text in enumerate(texts):
                counts: dict[int, int] = {}
                for word, n in _count(text).items():
                    hits = known.get(word)
                    if hits is None:
                        hits = known[word] = tuple(f for f in _features(word) if f in self.weights)
                    for f in hits:
                        counts[f] = counts.get(f, 0) + n
                out[k] = sum(self.weights[f] * (1 + np.log(n)) for f, n in counts.items())
            return out

        return sums


def fit_grades(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, size: int, ridge: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by the likelihood of all rows of the sample.

    ``rows[i]`` are the features of row i below ``size`` and ``values[i]`` their values. Thresholds are a first one
    and positive steps, so their order holds.
    """
    length = np.array([len(r) for r in rows])
    owner, index, value = np.repeat(np.arange(len(rows)), length), np.concatenate(rows).astype(np.int64), np.concatenate(values)
    links, n = max(1, int(grades.max())), len(rows)
    upper, lower, top, bottom = np.minimum(grades, links - 1), np.maximum(grades - 1, 0), grades == links, grades == 0
    below = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    split = lambda params: params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1 :]))])

    def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = params[:size], split(params)
        sums = np.bincount(owner, w[index] * value, n)
        # A grade's probability is the logistic function's rise between the thresholds on either side of it.
        high, low = np.where(top, 1.0, below(cuts[upper] - sums)), np.where(bottom, 0.0, below(cuts[lower] - sums))
        rise = np.maximum(high - low, 1e-12)
        g = np.empty_like(params)
        g[:size] = np.bincount(index, ((1 - high - low) / n)[owner] * value, size) + ridge * w
        by_cut = np.bincount(lower, low * (1 - low) / rise / n, links) - np.bincount(upper, high * (1 - high) / rise / n, links)
        g[size], g[size + 1 :] = by_cut.sum(), np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(params[size + 1 :])
        return float(ridge * (w @ w) / 2 - np.log(rise).mean()), g

    # Thresholds start where each is met as often as in the sample, without any feature.
    met = np.clip([(grades > k).mean() for k in range(links)], 1e-4, 1 - 1e-4)
    start = np.log((1 - met) / met)
    begin = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    params = bfgs(loss, begin, Stop(gradient=1e-6, step=1e-7, rounds=200))
    return params[:size], split(params)


def _telling(every: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of a feature in toxic and other rows, and the G statistic of its table with the label: 0 for
    what is weak or may be chance, which would only spread the weights."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((every - bad + 0.5) / (n - n_bad + 1))
    told = np.zeros(len(every))
    for seen, mean in ((bad, every * n_bad / n), (every - bad, every * (n - n_bad) / n), (n_bad - bad, (n - every) * n_bad / n), (n - n_bad - every + bad, (n - every) * (n - n_bad) / n)):
        told += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(mean, 1e-9)), 0)
    return odds, np.where((np.abs(odds) > MIN_ODDS) & (told > MIN_G), told, 0)


def _tables(keys: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each feature is, and in how many toxic ones."""
    every, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, marked in zip(keys, toxic):
        every[k] += 1
        bad[k] += marked
    return every, bad


def out_of_fold_grades(keys: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 of rows that are toxic or not, by marking features of the folds that a row isn't in."""
    every, bad = _tables(keys, toxic)
    fold, amount = np.arange(len(keys)) % FOLDS, np.zeros(len(keys))
    for f in range(FOLDS):
        mine = np.flatnonzero(fold == f)
        own, own_bad = _tables([keys[k] for k in mine], toxic[mine])
        n, n_bad = len(keys) - len(mine), int(toxic.sum() - toxic[mine].sum())
        if not 0 < n_bad < n:
            continue
        odds, told = _telling(every - own, bad - own_bad, n, n_bad)
        marking = (odds > MARKING) & (told > 0)
        amount[mine] = [counts[k][marking[keys[k]]].sum() for k in mine]
    return toxic.astype(np.int64) + (toxic & (amount > np.median(amount[toxic])))


def fit_rows(keys: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on rows given as features, how often each occurs, and labels: the lowest is clean, others are toxic."""
    levels, grades = np.unique(labels, return_inverse=True)
    if len(levels) < 2:
        return Model()
    toxic = grades > 0
    odds, told = _telling(*_tables(keys, toxic), len(keys), int(toxic.sum()))
    chosen_keys = np.sort(np.argsort(-told, kind="stable")[:KEPT])
    chosen_keys = chosen_keys[told[chosen_keys] > 0]
    if not len(chosen_keys):
        return Model()
    if len(levels) == 2:
        grades = out_of_fold_grades(keys, counts, toxic)
    place = np.full(BUCKETS, -1)
    place[chosen_keys] = np.arange(len(chosen_keys))
    kept = [place[k] >= 0 for k in keys]
    rows, values = [place[k[m]] for k, m in zip(keys, kept)], [_value(c[m]) for c, m in zip(counts, kept)]
    weights, cuts = fit_grades(rows, values, grades, len(chosen_keys))
    return Model({int(k): float(w) for k, w in zip(chosen_keys, weights) if w}, tuple(map(float, cuts)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled rows, the first in the order of a hash of their ids.

    Executors turn texts into counts of features; the driver gets those of the sample. Rows without a label, an id
    or a text are left out. Of several labels of an id the highest counts, of several texts the smallest, so that the
    bound holds and runs agree. If all labels are alike the model rejects nothing.
    """
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    # At most max_labelled ids and labels, so a few hundred KB.
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").select("label", "text")
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [])
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                for word, n in _count(text).items():
                    for f in _features(word):
                        counts[f] += n
                keys = sorted(counts)
                out[0].append(np.array(keys, "<i4").tobytes())
                out[1].append(np.array([counts[k] for k in keys], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["label", "keys", "counts"])

    got = chosen.mapInArrow(count, "label int, keys binary, counts binary").toArrow()
    ints = lambda name: [np.frombuffer(x.as_py(), "<i4") for x in got[name]]
    return fit_rows(ints("keys"), ints("counts"), np.array(got["label"].to_pylist(), np.int64))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``severity``, the expected grade, and ``p_toxic``, the probability of a grade above 0.

    Columns of these names are replaced. Null and empty texts have no features, so the sum 0. Row by row, whole
    texts, no shuffle; no rows, no rows.
    """
    rest = df.select(*(c for c in df.columns if c not in ("severity", "p_toxic")))
    schema = T.StructType([*rest.schema, T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    text_at = rest.columns.index(text_col)
    small_batches(df.sparkSession)

    def run(batches):
        sums = model.scorer()
        for batch in batches:
            if model.thresholds:
                above = model.above(sums(batch.column(text_at).to_pylist()))
            else:
                above = np.zeros((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(above[:, 0])], names=schema.names)

    return rest.mapInArrow(run, schema)
