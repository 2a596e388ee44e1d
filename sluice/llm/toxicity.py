"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words learns from documents confirmed toxic (P) and unlabelled ones
(U), among which a share `prior` is toxic. With loss l and score f, the risk of the clean class cannot be measured
on clean documents; U holds both, so it is E_U[l(-f)] - prior * E_P[l(-f)]. A flexible model can push that estimate
below zero by overfitting P, so where it does, training steps undo it instead of following it (non-negative risk).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grouped, sliced
from .sampling import fold, smallest, texts_of

#: Bounds of the training sample: confirmed toxic documents, unlabelled ones, and labelled rows that set the prior. The
#: README has figures of the effect that the second one has.
POSITIVES, UNLABELLED, LABELLED = 4000, 12000, 200_000
#: More than ever pass the test for a feature; some hundred do.
FEATURES = 1 << 16
FOLDS = 5


def word_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct words of each text, as 64-bit hashes; words are runs of letters, ASCII ones lower-cased."""
    words = Words([d.translate(_LETTERS) for d in docs])
    feature = words.hashes().view(np.int64)
    order = np.lexsort((feature, words.doc))
    doc, feature = words.doc[order], feature[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])))[: len(doc)]
    return doc[new], feature[new]


#: Bytes that are no letters become spaces; those of characters beyond ASCII stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() and chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


class Model:
    """score(document) = sigmoid(bias + sum of the weights of the features present). Features are sorted."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, bias: float):
        self.feature, self.weight, self.bias = feature, weight, bias

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, given by (document, feature) with repeats or without."""
        at = np.minimum(np.searchsorted(self.feature, feature), len(self.feature) - 1) if len(self.feature) else np.zeros(0, np.int64)
        hit = np.flatnonzero(self.feature[at] == feature) if len(at) else at
        pairs = np.unique(doc[hit].astype(np.int64) * (len(self.feature) + 1) + at[hit])
        return np.bincount(pairs // (len(self.feature) + 1), self.weight[pairs % (len(self.feature) + 1)], n) + self.bias

    def scores(self, docs: list[bytes]) -> np.ndarray:
        """One probability a document; long texts go in parts, of which only the model's own features are kept."""
        seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for index, some in grouped(docs):
            words = Words([d.translate(_LETTERS) for d in some])
            feature = words.hashes().view(np.int64)
            own = np.flatnonzero(np.isin(feature, self.feature))
            seen.append((np.array(index, np.int64)[words.doc[own]], feature[own]))
        doc, feature = (np.concatenate(x) for x in zip(*seen))
        return 1 / (1 + np.exp(-np.clip(self.logits(doc, feature, len(docs)), -30, 30)))


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int = FEATURES, least: int = 5) -> np.ndarray:
    """The features whose share of P differs most clearly from that of U (two-proportion z), in `least` documents of P at least."""
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    feature, side = np.unique(np.concatenate([*positive, *unlabelled, np.zeros(0, np.int64)]), return_inverse=True)
    split = sum(map(len, positive))
    p, u = (np.bincount(x, minlength=len(feature)) for x in (side[:split], side[split:]))
    both = (p + u) / (n + m)
    z = np.abs(p / n - u / m) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / m))
    z[p < least] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return feature[np.sort(best[z[best] > 4])]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 800, rate: float = 0.1, decay: float = 1e-6) -> Model:
    """Full-batch training on the features of P and U. With no positive example, every score is the prior."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    feature = choose_features(positive, unlabelled)
    if not positive or not unlabelled or not len(feature):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))

    def dense(rows):
        x = np.zeros((len(rows), len(feature) + 1), np.float32)
        for k, r in enumerate(rows):
            x[k, np.searchsorted(feature, r[np.isin(r, feature)])] = 1
        x[:, -1] = 1
        return x

    xp, xu = dense(positive), dense(unlabelled)
    # weights are held back the more, the fewer confirmed documents speak for them
    held = decay * len(xp) / np.maximum(xp[:, :-1].sum(axis=0), 0.5)
    w = np.zeros(len(feature) + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fp, fu = xp @ w, xu @ w
        # logistic loss: l(f) = log(1 + exp(-f)), l'(f) = -sigmoid(-f)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        clean_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        toxic = prior * (xp.T @ (sp - 1)) / len(xp)
        clean = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        gradient = toxic + clean if clean_risk >= 0 else -clean
        gradient[:-1] += held * w[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(feature, w[:-1].astype(np.float32), float(w[-1]))


def _features(batches):
    for batch in sliced(batches):
        doc, feature = word_features([t.encode() for t in batch.column("text").to_pylist()])
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.record_batch([batch.column("toxic"), pa.ListArray.from_arrays(bounds, pa.array(feature))], names=["toxic", "features"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, labelled: int = LABELLED) -> Model:
    """Train on rows outside the held-out fold. Only word features of the bounded sample reach the driver.

    P: up to `positives` documents labelled toxic. U: up to `unlabelled` documents, whatever their labels say. The
    prior is the toxic share of up to `labelled` labelled rows. Null ids, null labels and texts of more than
    sampling.LONGEST bytes are left out; a null text is empty. Without any, every score is the prior.
    """
    known = labels.where(fold("doc_id", FOLDS) != 0).where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = smallest(known, labelled).agg(F.avg("toxic").alias("p")).first()["p"] or 0.0
    p = smallest(known.where("toxic = 1"), positives)
    u = smallest(docs.where(fold("doc_id", FOLDS) != 0).select(F.col("doc_id").cast("long").alias("doc_id")), unlabelled).withColumn("toxic", F.lit(None).cast("int"))
    rows = texts_of(docs, p.unionByName(u)).select("toxic", "text").mapInArrow(_features, "toxic int, features array<bigint>").toArrow()
    toxic = rows.column("toxic").to_pylist()
    found = [np.array(x.values, np.int64) if (x := v) is not None else np.zeros(0, np.int64) for c in rows.column("features").chunks for v in c]
    # rows come in any order; training must not depend on it
    order = sorted(range(len(found)), key=lambda k: (toxic[k] is None, len(found[k]), found[k].tobytes()))
    return train([found[k] for k in order if toxic[k] == 1], [found[k] for k in order if toxic[k] is None], float(share))


def _scored(batches, model: Model):
    for batch in sliced(batches):
        score = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
        yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its text alone; a null text counts as empty.

    A null doc_id is not held out. Repeated rows score alike. Very long texts are scored whole, part by part. Other
    columns are not read. An empty table gives no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = given.mapInArrow(partial(_scored, model=model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
