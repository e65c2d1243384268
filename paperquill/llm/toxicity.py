"""Counterfactual-regularised toxicity classifier.

Logistic regression over word, prefix and suffix features. Beside the log loss, training has a penalty on the squared
change of a sentence's logit when its identity terms are swapped for others of the same list, so that the mention of a
group as such can't carry the score. The model is fitted on a bounded sample of labelled rows: at most MAX_ROWS of
each label, those of the smallest hash. Scoring reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, added_schema, small_batches, texts, trim, with_column

MAX_ROWS, MAX_FEATURES, MIN_DOCS, MIN_Z = 10_000, 4_096, 3, 3.0
L2, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 400
THRESHOLD = 0.3
REMEMBERED = 150_000
#: Lists of identity terms: a swap puts another term of the same list in the place of each. A parameter.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
_TO_SPACE = bytes(i if i >= 128 or chr(i).isalnum() or i == 39 else 32 for i in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z only is lowered): runs of letters, digits, apostrophes and what is not ASCII."""
    return text.lower().translate(_TO_SPACE).split()


def word_features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    out = ["=" + w]
    for n in (4, 5, 6):
        if len(w) > n:
            out += ["^" + w[:n], w[-n:] + "$"]
    return out


def swaps(identity) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for group in identity for a, b in zip(group, [*group[1:], group[0]])}


@dataclass
class Model:
    """rows: labelled texts that it was fitted on; swapped: those of them that hold an identity term to swap. Without any,
    it is a plain logistic regression."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float
    rows: int = 0
    swapped: int = 0

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def ids(self, word: bytes):
        got = self.known.get(word, 0)
        if got == 0:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = tuple(i for f in word_features(word) if (i := self.model.features.get(f)) is not None) or None
        return got

    def document(self, text: bytes) -> list[int]:
        """Sorted numbers of the features that a text has."""
        return self.of(set(words(text)))

    def of(self, distinct: set[bytes]) -> list[int]:
        return sorted({i for t in filter(None, map(self.ids, distinct)) for i in t})

    def score(self, text: bytes) -> float:
        logit = self.model.bias + float(self.model.weights[self.document(text)].sum())
        return 1 / (1 + np.exp(-logit)) if logit > -700 else 0.0


def train_numpy(rows: list[list[int]], labels: np.ndarray, swapped: list[tuple[int, list[int]]], n: int, prior: float, l2: float, counterfactual: float) -> tuple[np.ndarray, float]:
    """train() of lists: the features of each row; swapped: (row, features after the swap)."""
    entries = lambda lists: (np.array([i for r in lists for i in r], np.int64), np.repeat(np.arange(len(lists)), [len(r) for r in lists]).astype(np.int64))
    return train(entries(rows), labels, entries([r for _, r in swapped]), entries([rows[k] for k, _ in swapped]), len(swapped), n, prior, l2, counterfactual)


def train(features, labels: np.ndarray, gained, lost, swaps_: int, n: int, prior: float, l2: float, counterfactual: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows. features: (feature, its row); gained and lost: (feature, its swap), what the
    swaps add and take away. prior: log odds to add."""
    flat, row = features
    # a swap's change of logit: +1 for features gained, -1 for those lost
    s_flat, s_row = (np.concatenate(x) for x in zip(gained, lost))
    s_sign = np.repeat([1.0, -1.0], [len(gained[0]), len(lost[0])])
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for step in range(1, STEPS + 1):
        w = theta[:n]
        logit = theta[n] + np.bincount(row, w[flat], len(labels))
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        grad = np.append(np.bincount(flat, err[row], n) + l2 * w, err.sum())
        if swaps_:
            change = np.bincount(s_row, s_sign * w[s_flat], swaps_)
            grad[:n] += np.bincount(s_flat, (2 * counterfactual / swaps_) * change[s_row] * s_sign, n)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * 0.5 * (1 + np.cos(np.pi * step / STEPS)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:n], float(theta[n] + prior)


def _counts(batches, of):
    """Per task, how often each key is in label-1 and label-0 rows; flushed where there are many keys."""
    one, zero = Counter(), Counter()

    def flush():
        keys = list(one.keys() | zero.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([one[k] for k in keys], pa.int64()), pa.array([zero[k] for k in keys], pa.int64())], names=["key", "d1", "d0"])
        one.clear()
        zero.clear()
        return out

    for b in batches:
        of(b, one, zero)
        if len(one) + len(zero) > 500_000:
            yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", identity=IDENTITY, max_rows: int = MAX_ROWS, l2: float = L2, counterfactual: float = COUNTERFACTUAL, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> Model:
    """Learn from the labelled rows given. Rows with a null id or label are passed over; a null text has no features.

    Repeated texts of one label count once, so repeated ids do no harm; at most max_rows texts of each label are used,
    those of the smallest hash. Features are the max_features that tell the labels apart best, of those in min_docs texts or
    more whose log odds differ by min_z standard errors or more. Without rows of both labels, the score of every text is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(doc_id).alias("_id"), (F.col(label) != 0).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    n = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return Model({}, np.zeros(0), -1e9)
    order = F.xxhash64("_id"), F.col("_id")
    picked = usable.filter("_y = 1").orderBy(*order).limit(max_rows).unionByName(usable.filter("_y = 0").orderBy(*order).limit(max_rows))
    taken = {y: min(n[y], max_rows) for y in n}
    # at most 2 * max_rows rows of two numbers
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")
    sample = scratch.save(joined.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["_h", "_y"]), "sample")
    total = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    for y in (0, 1):
        if total.get(y, 0) > max_rows:  # ids that repeat have several texts
            first = scratch.save(sample.filter(F.col("_y") == y).select("_h", "_y").orderBy("_h").limit(max_rows), "first")
            sample = scratch.save(sample.filter(F.col("_y") != y).unionByName(sample.join(F.broadcast(first), ["_h", "_y"], "left_semi")), "sample")
            total[y] = max_rows
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not (n1 and n0):
        return Model({}, np.zeros(0), -1e9)

    def per_text(b, one, zero):
        for t, y in zip(texts(b, "text"), b.column("_y").to_pylist()):
            (one if y else zero).update(set(words(t)))

    def per_word(b, one, zero):
        for w, a, c in zip(b.column("key").to_pylist(), b.column("d1").to_pylist(), b.column("d0").to_pylist()):
            for f in word_features(w):
                k = f.encode()
                one[k] += a
                zero[k] += c

    schema = "key binary, d1 long, d0 long"
    summed = lambda df: df.groupBy("key").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
    by_word = summed(sample.select("text", "_y").mapInArrow(lambda it: _counts(it, per_text), schema))
    by_feature = summed(by_word.mapInArrow(lambda it: _counts(it, per_word), schema)).filter(F.col("d1") + F.col("d0") >= min_docs)
    odds = lambda d, m: F.log((F.least(d, F.lit(m)) + 0.5) / (m - F.least(d, F.lit(m)) + 0.5))
    z = (odds(F.col("d1"), n1) - odds(F.col("d0"), n0)) / F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))
    best = by_feature.withColumn("z", F.abs(z)).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "key").limit(max_features).select("key").collect()
    model = Model({bytes(r[0]).decode("utf-8", "replace"): i for i, r in enumerate(best)}, np.zeros(len(best)), 0.0)
    swap = swaps(identity)

    def featurise(batches):
        scorer = model.scorer()
        for b in batches:
            ids, gained, lost = [], [], []
            for t in texts(b, "text"):
                distinct = set(words(t))
                ids.append(scorer.of(distinct))
                found = distinct & swap.keys()
                other = set(scorer.of((distinct - found) | {swap[w] for w in found})) if found else set(ids[-1])
                gained.append(sorted(other.difference(ids[-1])))
                lost.append(sorted(set(ids[-1]) - other))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_y"), *[pa.array(x, kind) for x in (ids, gained, lost)]], names=["h", "y", "ids", "gained", "lost"])

    got = sample.select("_h", "_y", "text").mapInArrow(featurise, "h string, y int, ids array<int>, gained array<int>, lost array<int>").toArrow()  # at most 2 * max_rows rows
    got = got.sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()

    def entries(name: str):
        lists = got.column(name).chunk(0) if got.num_rows else pa.array([], pa.list_(pa.int32()))
        return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())

    features, gains, losses = entries("ids"), entries("gained"), entries("lost")
    of_swap, spot = np.unique(np.concatenate([gains[1], losses[1]]), return_inverse=True)
    model.rows, model.swapped = got.num_rows, len(of_swap)
    gains, losses = (gains[0], spot[: len(gains[1])]), (losses[0], spot[len(gains[1]) :])
    y = got.column("y").to_numpy().astype(float)
    del got
    prior = np.log((n[1] / n[0]) / (taken[1] / taken[0]))
    model.weights, model.bias = train(features, y, gains, losses, model.swapped, len(best), prior, l2, counterfactual)
    scratch.drop(sample)
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column, the probability that a text is toxic; null and empty texts get that of no features."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value.scorer()
        for b in batches:
            yield with_column(b, out, pa.array([scorer.score(t) for t in texts(b, text)], pa.float64()))
        scorer.known.clear()
        trim()

    return docs.mapInArrow(run, added_schema(docs, (out, "double")))
