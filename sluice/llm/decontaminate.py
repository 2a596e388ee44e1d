"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words are counted over all documents.
2. The benchmark's items are cut into passages with TF-IDF weights (square root of the count): a sparse matrix A, a row a passage. A randomised
   SVD, spread over the cluster, finds its leading right singular vectors: Z = A'(A G) for a random G is summed over
   tasks, an orthonormal basis Q of Z is taken, and the small matrix (AQ)'(AQ) is summed and decomposed.
3. Every document is cut into overlapping passages. Each is projected onto the singular vectors and compared with the
   items' latent vectors by cosine. Most passages need no projection: their cosine cannot exceed the share of their
   length that lies in words of the benchmark. The singular vectors leave a part of passages and items out, more of it
   the larger the benchmark; where the product of what is left could lift a cosine to the threshold, the cosine
   is taken on all words. Items whose words stand in a document one after another are candidates at any cosine.
4. Candidates are verified on the words: the longest common subsequence of item and passage, and whether the item's
   answer, its last sentence, is there too. Paraphrases keep the order of most words; unlike texts do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Words, grouped, sliced, texts

HASH_BITS, RANK, EXTRA, SEED = 18, 256, 8, 11
#: Words a passage, and from one to the next.
PASSAGE, STEP = 40, 20
COSINE = 0.3
#: Shares of an item's words, in order: enough alone, and enough where the answer is found as well.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.6, 0.5, 0.8
#: Items that are searched for at once, and bytes of theirs; larger benchmarks take several passes.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: Features that the singular vectors run over: the benchmark's heaviest. What the others hold counts as outside the space.
SPACE = 1 << 15

#: Letters and digits are word characters, and so are the bytes of other than ASCII characters.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _words(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in a row, and where each text's begin (with the end)."""
    words = Words([d.lower().encode().translate(_PLAIN) for d in docs])
    return words.hashes(), words.first


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def passage_starts(n: int) -> np.ndarray:
    """First words of a text's passages; the last passage ends with the text."""
    if n <= PASSAGE:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - PASSAGE, STEP), n - PASSAGE)


def _frequencies(batches):
    total = np.zeros(1 << HASH_BITS, np.int64)
    for batch in sliced(batches):
        hashes, first = _words(texts(batch))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        pairs = np.unique((doc << HASH_BITS) | _feature(hashes))
        total += np.bincount(pairs & ((1 << HASH_BITS) - 1), minlength=1 << HASH_BITS)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["feature", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 of each hashed word; 2**HASH_BITS values, whatever the corpus holds."""
    n = docs.count()
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << HASH_BITS)
    df[rows.column("feature").to_numpy()] = rows.column("df").to_numpy()
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def vectors(docs: list[str], idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, features, weights) of each passage of each text; weights have length 1."""
    hashes, first = _words(docs)
    feature = _feature(hashes)
    for k in range(len(docs)):
        own = feature[first[k] : first[k + 1]]
        for at in passage_starts(len(own)):
            f, times = np.unique(own[at : at + PASSAGE], return_counts=True)
            w = np.sqrt(times) * idf[f]
            yield k, f, w / np.linalg.norm(w)


def _gauss(feature: np.ndarray, columns: int) -> np.ndarray:
    return np.stack([np.random.default_rng((SEED, int(f))).standard_normal(columns) for f in feature]) if len(feature) else np.zeros((0, columns))


def _weights(batches, idf: np.ndarray):
    """How much of all passages' squared length each feature holds."""
    total = np.zeros(1 << HASH_BITS)
    for batch in sliced(batches):
        for _, f, w in vectors(texts(batch), idf):
            total[f] += w.astype(np.float64) ** 2
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["feature", "weight"])


def _sketch(batches, idf: np.ndarray, columns: int, row_of: np.ndarray, most: int):
    """This task's part of A'(A G): a row (feature, column, value) for each feature of the space it has met."""
    total: dict[int, np.ndarray] = {}
    gauss: dict[int, np.ndarray] = {}
    for batch in sliced(batches):
        for _, f, w in vectors(texts(batch), idf):
            inside = row_of[f] <= most
            f, w = f[inside], w[inside]
            if not len(f):
                continue
            for x in f.tolist():
                if x not in gauss:
                    gauss[x] = _gauss(np.array([x]), columns)[0]
            y = w @ np.stack([gauss[x] for x in f.tolist()])
            for x, v in zip(f.tolist(), w):
                total[x] = total.get(x, 0) + v * y
    for x, v in total.items():
        yield pa.record_batch([pa.array(np.full(columns, x, np.int32)), pa.array(np.arange(columns, dtype=np.int32)), pa.array(v.astype(np.float32))], names=["feature", "place", "value"])


def _gram(batches, space: Space):
    total = np.zeros((space.basis.shape[1],) * 2)
    for batch in sliced(batches):
        for _, f, w in vectors(texts(batch), space.idf):
            y = w @ space.vectors(space.row_of[f])
            total += np.outer(y, y)
    yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["gram"])


class Space:
    """Right singular vectors over the benchmark's heaviest features.

    row_of: a row from 1 on for each feature that the benchmark has, 0 for all others. The heaviest come first; basis
    has their rows, and those of the others are zero.
    """

    def __init__(self, idf: np.ndarray, feature: np.ndarray, basis: np.ndarray):
        self.idf = idf
        self.row_of = np.zeros(1 << HASH_BITS, np.int32)
        self.row_of[feature] = np.arange(1, len(feature) + 1)
        self.rows = len(feature) + 1
        self.basis = np.concatenate([np.zeros((1, basis.shape[1])), basis]).astype(np.float32)

    def vectors(self, row: np.ndarray) -> np.ndarray:
        return self.basis[np.where(row < len(self.basis), row, 0)]


def singular_space(benchmark: DataFrame, idf: np.ndarray, rank: int = RANK) -> Space:
    """The randomised SVD of the benchmark's passages; what is gathered is at most SPACE x (rank + EXTRA) values of 12 bytes (104 MB)."""
    given = benchmark.select(F.col("text").cast("string").alias("text"))
    columns = max(1, min(rank, 2 * benchmark.count()) + EXTRA)
    held = given.mapInArrow(partial(_weights, idf=idf), "feature int, weight double").groupBy("feature").agg(F.round(F.sum("weight"), 6).alias("weight")).toArrow()
    feature = held.column("feature").to_numpy()
    if not len(feature):
        return Space(idf, np.zeros(0, np.int64), np.zeros((0, 1)))
    feature = feature[np.lexsort((feature, -held.column("weight").to_numpy()))]
    most = min(SPACE, len(feature))
    feature[:most].sort()
    space = Space(idf, feature, np.zeros((most, columns)))
    z = given.mapInArrow(partial(_sketch, idf=idf, columns=columns, row_of=space.row_of, most=most), "feature int, place int, value float").groupBy("feature", "place").agg(F.sum("value").cast("float").alias("value")).toArrow()
    sums = np.zeros((most, columns))
    sums[space.row_of[z.column("feature").to_numpy()] - 1, z.column("place").to_numpy()] = z.column("value").to_numpy()
    del z
    q, _ = np.linalg.qr(sums)
    q = np.pad(q, ((0, 0), (0, 1 if q.shape[1] == 0 else 0)))
    space = Space(idf, feature, q)
    grams = given.coalesce(64).mapInArrow(partial(_gram, space=space), "gram array<double>").collect()
    value, vector = np.linalg.eigh(sum(np.array(r["gram"]) for r in grams).reshape((q.shape[1],) * 2))
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-8 * value.max()]
    return Space(idf, feature, q @ vector[:, keep])


class Items:
    """The items of one pass: latent vectors of their passages, and their words for the checks.

    norm, rest: length of each passage in the space and outside. post, held, share: for each row of the space, where
    its passages begin, the passages and their weights. anchors: each item's rarest word, by which runs of its very words are found.
    """

    def __init__(self, rows: list[tuple[int, str]], space: Space):
        self.ids = [i for i, _ in rows]
        docs = [t or "" for _, t in rows]
        hashes, first = _words(docs)
        self.words = [hashes[a:b] for a, b in zip(first, first[1:])]
        self.answers = [_words([_answer(t or "")])[0] for _, t in rows]
        item, latent, rows, weights = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for k, f, w in vectors(docs, space.idf):
            item.append(k)
            latent.append(w @ space.vectors(space.row_of[f]))
            rows.append(space.row_of[f])
            weights.append(w)
        self.item = np.array(item, np.int64)
        whole = np.array(latent, np.float64).reshape(len(item), space.basis.shape[1])
        self.norm = np.linalg.norm(whole, axis=1)
        self.rest = np.sqrt(np.maximum(0, 1 - self.norm**2))
        self.latent = np.where(self.norm[:, None] > 1e-6, whole / np.maximum(self.norm, 1e-6)[:, None], 0).astype(np.float32)
        row, passage = np.concatenate(rows), np.repeat(np.arange(len(item)), [len(x) for x in rows[1:]])
        order = np.argsort(row, kind="stable")
        self.post = np.searchsorted(row[order], np.arange(space.rows + 1))
        self.held, self.share = passage[order], np.concatenate(weights)[order]
        worded = np.flatnonzero(np.diff(first))
        rare = np.array([np.argmax(space.idf[_feature(self.words[k])]) for k in worded], np.int64)
        order = np.argsort(hashes[first[worded] + rare], kind="stable")
        self.run, self.offset, self.size = worded[order], rare[order], np.diff(first)[worded[order]]
        self.runs = Rolling(hashes).of(first[self.run], first[self.run + 1])
        self.anchors, self.group = np.unique(hashes[first[self.run] + self.offset], return_index=True)
        self.group = np.append(self.group, len(worded))

    def full(self, passage: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first passage, products with all items' passages) of n passages, some at a time; their entries come sorted."""
        size, step = self.post[row + 1] - self.post[row], max(1, (1 << 18) // max(1, len(self.item)))
        for at in range(0, n, step):
            a, b = np.searchsorted(passage, [at, at + step])
            own, many = size[a:b], min(step, n - at)
            place = np.repeat(self.post[row[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            cell = np.repeat((passage[a:b] - at) * len(self.item), own) + self.held[place]
            yield at, np.bincount(cell, np.repeat(weight[a:b], own) * self.share[place], many * len(self.item)).reshape(many, -1)

    def copies(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of each run of words that is all of an item."""
        if not len(self.anchors):
            return
        kind = np.minimum(np.searchsorted(self.anchors, hashes), len(self.anchors) - 1)
        hit = np.flatnonzero(self.anchors[kind] == hashes)
        low, many = self.group[kind[hit]], self.group[kind[hit] + 1] - self.group[kind[hit]]
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        start = np.repeat(hit, many) - self.offset[entry]
        end, doc = start + self.size[entry], np.repeat(np.searchsorted(first, hit, "right") - 1, many)
        inside = np.flatnonzero((start >= first[doc]) & (end <= first[doc + 1]))
        start, end, doc, entry = start[inside], end[inside], doc[inside], entry[inside]
        same = np.flatnonzero(Rolling(hashes).of(start, end) == self.runs[entry])
        yield from zip(doc[same].tolist(), self.run[entry[same]].tolist(), start[same].tolist(), end[same].tolist())


def _answer(text: str) -> str:
    """An item's last sentence of three words or more, or all of it."""
    said = [s for s in re.split(r"[.?!\n]+", text) if len(s.split()) >= 3]
    return said[-1] if said else text


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over a."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def matches(docs: list[str], space: Space, items: Items) -> list[tuple[int, int, float, float, float]]:
    """(text, item index, cosine, LCS share, answer share) of every verified leak; vectorised up to the candidates."""
    hashes, first = _words(docs)
    feature = _feature(hashes)
    if not len(feature) or not len(items.item):
        return []
    n = np.diff(first)
    count = np.where(n > PASSAGE, -(-(n - PASSAGE) // STEP) + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(docs)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + np.minimum(k * STEP, np.maximum(n[doc] - PASSAGE, 0))
    end = np.minimum(start + PASSAGE, first[1:][doc])
    # a word m times in a passage weighs sqrt(m) * idf, so squared lengths are sums over occurrences
    square = space.idf[feature].astype(np.float64) ** 2
    inside = np.concatenate(([0], np.cumsum(np.where(space.row_of[feature] > 0, square, 0))))
    total = np.concatenate(([0], np.cumsum(square)))
    part, whole = inside[end] - inside[start], total[end] - total[start]
    near = np.flatnonzero(part >= COSINE**2 * whole)
    found: dict[tuple[int, int], list] = {}
    for d, item, a, b in items.copies(hashes, first):
        found.setdefault((d, item), []).append((a, b, 0.0))
    step = max(64, min(2048, (1 << 22) // len(items.item)))
    for at in range(0, len(near), step):
        own = near[at : at + step]
        size = end[own] - start[own]
        passage = np.repeat(np.arange(len(own)), size)
        word = np.repeat(start[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pair, times = np.unique((passage << HASH_BITS) | feature[word], return_counts=True)
        passage, f = pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)
        weight = np.sqrt(times) * space.idf[f]
        length = np.sqrt(np.bincount(passage, weight.astype(np.float64) ** 2, len(own)))
        row = space.row_of[f]
        known = np.flatnonzero(row)
        row, weight = row[known], weight[known].astype(np.float32)
        passage = passage[known]
        bounds = np.searchsorted(passage, np.arange(len(own) + 1)).tolist()
        latent = np.zeros((len(own), space.basis.shape[1]), np.float32)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):  # small dense products beat one large sparse one here
            if b > a:
                latent[k] = weight[a:b] @ space.vectors(row[a:b])
        length = np.maximum(length, 1e-9)
        cosine = latent @ items.latent.T / length[:, None]
        # of a full cosine, the space has one part, and the lengths outside bound the other
        rest = np.sqrt(np.maximum(0, np.bincount(passage, weight.astype(np.float64) ** 2, len(own)) - np.linalg.norm(latent, axis=1) ** 2)) / length
        reach = np.flatnonzero((cosine * items.norm.astype(np.float32) + np.outer(rest, items.rest).astype(np.float32) >= COSINE - 1e-3).any(1))
        rank = np.full(len(own), -1)
        rank[reach] = np.arange(len(reach))
        entry = np.flatnonzero(rank[passage] >= 0)
        for low, product in items.full(rank[passage[entry]], row[entry], weight[entry], len(reach)):
            some = reach[low : low + len(product)]
            cosine[some] = np.maximum(cosine[some], product / length[some, None])
        for p, b in zip(*np.nonzero(cosine >= COSINE)):
            place = own[p]
            found.setdefault((int(doc[place]), int(items.item[b])), []).append((int(start[place]), int(end[place]), float(cosine[p, b])))
    out = []
    for (d, item), places in found.items():
        words, answer, best = items.words[item], items.answers[item], None
        for a, b, c in places:
            reach = max(len(words), STEP)
            lo, hi = max(int(first[d]), a - reach // 2), min(int(first[d + 1]), b + reach // 2)
            share = lcs(words, hashes[lo:hi]) / len(words)
            said = lcs(answer, hashes[lo:hi]) / max(1, len(answer))
            if share >= LCS_ALONE or (share >= LCS_WITH_ANSWER and said >= ANSWER):
                best = max(best or (0.0, 0.0, 0.0), (share, said, c))
        if best:
            out.append((d, item, best[2], best[0], best[1]))
    return sorted(out)


def whole_matches(docs: list[str], space: Space, items: Items) -> list[tuple[int, int, float, float, float]]:
    """As matches; very long texts go in parts that overlap by more than an item, and their best matches count."""
    if max(map(len, docs), default=0) <= SLICE_BYTES // 4:
        return matches(docs, space, items)
    overlap = 4 * (PASSAGE + int(max(map(len, items.words), default=0)))
    best: dict[tuple[int, int], tuple] = {}
    for index, some in grouped((d.encode() for d in docs), overlap):
        for d, item, c, share, said in matches([x.decode() for x in some], space, items):
            best[index[d], item] = max(best.get((index[d], item), (0.0, 0.0, 0.0)), (share, said, c))
    return sorted((d, item, c, share, said) for (d, item), (share, said, c) in best.items())


def _passes(benchmark: DataFrame, space: Space, size: int = ITEMS) -> Iterator[Items]:
    held: list[tuple[int, str]] = []
    held_bytes = 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and (len(held) == size or held_bytes + len(row["text"]) > ITEM_BYTES):
            yield Items(held, space)
            held, held_bytes = [], 0
        held.append((row["item_id"], row["text"]))
        held_bytes += len(row["text"])
    if held:
        yield Items(held, space)


def _leaks(batches, space, items):
    space, items = space.value, items.value
    for batch in sliced(batches):
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[d], items.ids[i], c, s, a) for d, i, c, s, a in whole_matches(texts(batch), space, items)]
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): a row for each document and item that leaks into it.

    Null or empty texts leak nothing, and null item_ids are reported as such. Repeated documents are reported each;
    repeated items each as well. Documents without words, or empty tables on either side, give no rows. cosine is the
    larger of the latent and the full one, and 0 where the item's very words are there but no passage reaches COSINE.
    Very long texts are searched whole, in overlapping parts. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    space = singular_space(benchmark, inverse_frequencies(docs))
    shared = sc.broadcast(space)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _passes(benchmark, space):
        found = given.mapInArrow(partial(_leaks, space=shared, items=sc.broadcast(items)), "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")


def _clean(batches, space, items):
    space, items = space.value, items.value
    for batch in sliced(batches):
        bad = {m[0] for m in whole_matches(texts(batch), space, items)}
        yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in bad], pa.int64()))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks; null and empty texts, and an empty table, stay as they are.

    Each row is judged by its own text, so null and repeated doc_ids make no difference. Columns may have any names.
    """
    sc = docs.sparkSession.sparkContext
    space = singular_space(benchmark, inverse_frequencies(docs))
    shared = sc.broadcast(space)
    for items in _passes(benchmark, space):
        docs = docs.mapInArrow(partial(_clean, space=shared, items=sc.broadcast(items)), docs.schema)
    return docs
