"""Quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. Each byte becomes a learned vector, next to a flag
that says whether the bytes here repeat those shortly before (a word said again and again). Learned filters slide over
the chunk, their responses are rectified and max-pooled, and a linear layer turns them into the chunk's logit. The
document's probability combines the mean and the smallest chunk logit.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .sampling import fold, smallest, texts_of

CHUNK, STEP = 256, 192
WIDTH, STRIDE, FILTERS, VECTOR = 6, 2, 16, 8
#: How far back a repetition is looked for, and how many bytes have to agree.
LAGS, AGREE = range(3, 19), 8
#: Bound of the training sample: labelled documents.
LABELLED = 6000
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7


def repeats(data: np.ndarray) -> np.ndarray:
    """Per byte, whether it and the AGREE - 1 after it equal those some LAGS before."""
    out = np.zeros(len(data), bool)
    for lag in LAGS:
        m = data[lag:] == data[:-lag]
        for step in (1, 2, 4):
            m = m[:-step] & m[step:] if len(m) > step else m[:0]
        out[lag : lag + len(m)] |= m
    return out


def chunks(doc: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) bytes and repetition flags; the last is padded with spaces, an empty text is one chunk of them."""
    n = 1 + max(0, -(-(len(doc) - CHUNK) // STEP))
    data = np.full((n - 1) * STEP + CHUNK, 32, np.uint8)
    data[: len(doc)] = np.frombuffer(doc, np.uint8)
    flag = np.zeros(len(data), bool)
    flag[: len(doc)] = repeats(data[: len(doc)])
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, CHUNK)[::STEP]
    return view(data), view(flag)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (256, VECTOR)),
            "filter": rng.normal(0, 0.25, (WIDTH, VECTOR + 1, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": rng.normal(0, 0.3, FILTERS),
            "bias": np.zeros(1),
            "mean": np.ones(1),
            "least": np.zeros(1),
            "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def responses(self, data: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """(chunks, places, FILTERS) before rectifying. Each tap of a filter is a table over bytes."""
        taps = np.einsum("bv,wvf->wbf", self.p["embed"], self.p["filter"][:, :VECTOR]).astype(np.float32)
        places = (CHUNK - WIDTH) // STRIDE + 1
        out = np.broadcast_to(self.p["shift"], (len(data), places, FILTERS)).copy()
        for w in range(WIDTH):
            at = slice(w, w + STRIDE * places - STRIDE + 1, STRIDE)
            out += taps[w][data[:, at]]
            if flag.any():
                out += flag[:, at, None] * self.p["filter"][w, VECTOR]
        return out

    def chunk_logits(self, data: np.ndarray, flag: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(data, flag).max(axis=1), 0)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def combine(self, logits: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Document probabilities from the logits of their chunks; `first` marks where each document's begin."""
        size = np.diff(np.append(first, len(logits)))
        mean, least = np.add.reduceat(logits, first) / size, np.minimum.reduceat(logits, first)
        z = self.p["mean"][0] * mean + self.p["least"][0] * least + self.p["base"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, docs: list[bytes]) -> np.ndarray:
        """One probability a document. Chunks of several documents go through the filters together."""
        logits, first, at, held, size = [], [], 0, [], 0
        for doc in docs:
            data, flag = chunks(doc)
            first.append(at)
            at += len(data)
            for k in range(0, len(data), 256):
                held.append((data[k : k + 256], flag[k : k + 256]))
                size += len(held[-1][0])
                if size >= 256:
                    logits.append(self.chunk_logits(*(np.concatenate(x) for x in zip(*held))))
                    held, size = [], 0
        if held:
            logits.append(self.chunk_logits(*(np.concatenate(x) for x in zip(*held))))
        return self.combine(np.concatenate(logits), np.array(first)) if docs else np.zeros(0)

    def gradients(self, data: np.ndarray, flag: np.ndarray, good: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss over chunks; only the place that won the maximum passes it on."""
        r = self.responses(data, flag)
        best = r.argmax(axis=1)
        top = np.take_along_axis(r, best[:, None], 1)[:, 0]
        pooled = np.maximum(top, 0)
        error = (1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["bias"][0]))) - good) * weight
        g = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        back = error[:, None] * self.p["out"] * (top > 0)
        g["shift"] = back.sum(axis=0)
        g["embed"], g["filter"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["filter"])
        for w in range(WIDTH):
            byte = np.take_along_axis(data, best * STRIDE + w, 1)
            x = self.p["embed"][byte]
            g["filter"][w, :VECTOR] = np.einsum("cfv,cf->vf", x, back)
            g["filter"][w, VECTOR] = (np.take_along_axis(flag, best * STRIDE + w, 1) * back).sum(axis=0)
            np.add.at(g["embed"], byte, back[:, :, None] * self.p["filter"][w, :VECTOR].T)
        return g


def train(docs: list[bytes], good: np.ndarray, passes: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Chunks learn their document's label, classes weighted alike; then the combination is fitted on whole documents."""
    net = Network(seed)
    if not docs or good.min() == good.max():
        net.p["mean"][:] = 0
        net.p["base"][:] = 0 if not docs else (3 if good.max() else -3)
        return net
    rng = np.random.default_rng(seed)
    share = good.mean()
    cut = [chunks(d) for d in docs]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for round_ in range(passes):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            pick = [rng.integers(len(cut[k][0])) for k in own]
            data = np.stack([cut[k][0][c] for k, c in zip(own, pick)])
            flag = np.stack([cut[k][1][c] for k, c in zip(own, pick)])
            y = good[own].astype(np.float32)
            g = net.gradients(data, flag, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(own))
            step += 1
            pace = rate * (1 - round_ / passes)
            for k, v in g.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                net.p[k] -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # plain logistic regression on (mean, least) with the true class shares
    logits = [net.chunk_logits(*c) for c in cut]
    x = np.array([[v.mean(), v.min(), 1] for v in logits], np.float64)
    w = np.array([0.5, 0.5, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - good) + 1e-2 * w)
    net.p["mean"], net.p["least"], net.p["base"] = (np.array([v], np.float32) for v in w)
    return net


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Network:
    """Train on up to `labelled` labelled documents outside the held-out fold.

    Null ids, null labels and texts of more than sampling.LONGEST bytes are left out, so the sample has a bound in bytes;
    a null text is empty. Without any labelled document, every score is a half.
    """
    known = labels.where(fold("doc_id", FOLDS) != HELD_OUT).where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = texts_of(docs, smallest(known, labelled)).select("doc_id", "quality", "text").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    return train([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.int64))


def _scored(batches, model: Network):
    for batch in sliced(batches):
        score = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
        yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text; a null text counts as empty.

    A null doc_id is not held out. Repeated rows score alike. Very long texts are scored whole, some chunks at a time.
    Other columns are not read. An empty table gives no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = given.mapInArrow(partial(_scored, model=model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def _accepted(batches, model: Network):
    for batch in sliced(batches):
        score = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
        yield batch.take(pa.array(np.flatnonzero(score >= ACCEPT)))


def accepted(docs: DataFrame, model: Network) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores ACCEPT or more.

    A null text counts as empty, and an empty one is scored like any other. Columns may have any names. An empty table
    stays empty.
    """
    return docs.mapInArrow(partial(_accepted, model=model), docs.schema)
