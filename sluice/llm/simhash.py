"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints at a distance of 4 bits or fewer agree on one of any 5 disjoint blocks of bits at least, on two of any
6, and so on: rows that share such bits meet in a bucket. Buckets are compared bit-sliced: plane b holds bit b of
64 fingerprints in one word, so that one XOR compares 64 pairs in that bit. Carry-save counters add the planes up,
and words whose 64 pairs have all passed the radius are abandoned every few planes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_by, fresh, hot_keys, materialise, parts, sliced, spread_join
from .components import components
from .tiles import deal, forest

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Rows of a bucket that are compared in one go; larger buckets are dealt out as pairs of parts.
TILE = 1024
#: Small buckets are compared together until so many rows are there.
BATCH_ROWS = 512


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's 4-word shingles; zero without words. ASCII letters count as lower case."""
    n, ones = 0, np.zeros(64, np.int64)
    for part in parts(text, SHINGLE - 1):
        words = part.lower().split()
        if len(words) < SHINGLE:  # of the whole text, as longer ones have no such part
            return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        n += len(stops)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
        for byte in range(8):
            seen = np.bincount((h >> np.uint64(8 * byte)).astype(np.uint8), minlength=256)
            ones[8 * byte : 8 * byte + 8] += seen @ _BITS
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _fingerprints(batches):
    for batch in sliced(batches):
        found = [fingerprint((t or "").encode()) for t in batch.column("text").to_pylist()]
        bits = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.record_batch([batch.column("doc_id"), bits, batch.column("hash")], names=["doc_id", "bits", "hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits long, hash long) for every row; a null text counts as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("hash")).mapInArrow(_fingerprints, "doc_id long, bits long, hash long")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def planes(values: np.ndarray) -> np.ndarray:
    """(64, n/64) words: bit k of word w in plane b is bit b of value 64w + k. Missing values are zero."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry bits of three words, lane by lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius (7 at most)."""
    more, equal = over.copy(), ~over
    for weight, bit in ((4, fours), (2, twos), (1, ones)):
        if radius & weight:
            equal &= bit
        else:
            more |= equal & bit
            equal &= ~bit
    return more


def near_pairs(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with values[i] and values[j] at most `radius` bits apart (7 at most)."""
    sliced_bits, n = planes(values), len(values)
    words = sliced_bits.shape[1]
    rows, lanes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, 512):
        query, word = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + 512, n)), np.arange(at // 64, words), indexing="ij"))
        ones, twos, fours, over = (np.zeros(len(query), np.uint64) for _ in range(4))
        beyond = over
        for b in range(0, 64, 4):
            own = values[query] >> np.uint64(b)
            d = [sliced_bits[b + k][word] ^ (np.uint64(0) - ((own >> np.uint64(k)) & np.uint64(1))) for k in range(4)]
            ones, carry = _add(ones, d[0], d[1])
            ones, other = _add(ones, d[2], d[3])
            twos, carry = _add(twos, carry, other)
            over = over | (fours & carry)
            fours = fours ^ carry
            if b % 8 == 4:
                beyond = _beyond(ones, twos, fours, over, radius)
                live = beyond != ~np.uint64(0)
                if not live.all():
                    query, word, ones, twos, fours, over, beyond = (x[live] for x in (query, word, ones, twos, fours, over, beyond))
        hit, bit = np.nonzero(np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = query[hit], word[hit] * 64 + bit
        keep = (j > i) & (j < n)
        rows.append(i[keep])
        lanes.append(j[keep])
    return np.concatenate(rows), np.concatenate(lanes)


def _tile_links(values: np.ndarray) -> pa.RecordBatch:
    values = np.unique(values)
    i, j = near_pairs(values)
    label = forest(len(values), i, j)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return pa.record_batch([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], names=["a", "b"])


def _bucket_links(batches):
    """Rows come sorted by bucket; whole buckets are compared, small ones together, as any pair found is a link."""
    held, keys = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
    for batch in batches:
        held = np.concatenate((held, batch.column("bits").to_numpy().view(np.uint64)))
        keys = np.concatenate((keys, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("plan", "shared", "part", "other")], 1)))
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        at = 0
        for k, edge in enumerate(edges):  # the last bucket may go on in the next batch
            if edge - at >= BATCH_ROWS or (k + 1 < len(edges) and edges[k + 1] - at > 2 * BATCH_ROWS):
                yield _tile_links(held[at:edge])
                at = edge
        held, keys = held[at:], keys[at:]
    if len(held):
        yield _tile_links(held)


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits that pairs may share, as signed 64-bit masks: all choices of blocks - radius of the blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    found = [sum(c) for c in itertools.combinations(whole, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(bits: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """(a, b) links that join up all distinct fingerprints within the radius; not every pair has its own row.

    n: the number of fingerprints; decides how many blocks there are, and so how large a bucket of unlike ones
    becomes, never which links are found. Buckets above `tile` rows are dealt to tasks as pairs of their parts.
    """
    blocks = next(b for b in range(RADIUS + 1, 17) if b == 16 or n <= 1024 << int(64 * (b - RADIUS) / b))
    shared = F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in masks(blocks)])).alias("plan", "shared")
    rows = bits.select("bits", shared)
    dealt = deal(rows, ["plan", "shared"], "bits", tile)
    key = ["plan", "shared", "part", "other"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_links, "a long, b long")


def _labelled(marked: DataFrame, *chosen) -> DataFrame:
    """(bits, label and what is chosen of its rows) for each distinct fingerprint; a component's fingerprints share a label."""
    kinds = materialise(marked.groupBy("bits").agg(F.count("*").alias("__n"), *chosen), "kinds")
    found = components(links(kinds.select("bits"), kinds.count()))
    return kinds.join(found.withColumnRenamed("node", "bits"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: component_id is the smallest doc_id of those linked.

    Fingerprints link at RADIUS or fewer differing bits. A null or empty text has fingerprint zero and links like any
    other. Rows with a null doc_id get a component through their text; a component of nulls only has id null.
    Repeated rows give repeated rows. Very long texts are hashed in parts. Only doc_id and text are read, so other
    columns may have any names. An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs).drop("hash"), "fingerprints")
    labelled = materialise(_labelled(marked, F.min("doc_id").alias("id")), "labelled")
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    # one component, or one fingerprint's copies, may be a third of all rows: such keys are dealt to several tasks
    classes = spread_join(labelled, least, ["label"], hot=hot_keys(count_by(labelled, ["label"]), labelled.count())).select("bits", "component_id")
    return spread_join(marked, classes, ["bits"], hot=hot_keys(labelled.select("bits", "__n"), marked.count())).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of its smallest doc_id.

    Rows without a doc_id stand for components that have no other. Rows are told apart by doc_id and a hash of the
    text: of several texts under the smallest doc_id the one of smallest hash stays, and of equal rows one. A null text
    counts as an empty one for the fingerprint. Columns of docs may have any names. An empty table gives no rows.
    """
    key = none, row_id, row_hash = [fresh(docs, c) for c in ("__no_id", "__id", "__hash")]
    own = (F.col("doc_id").isNull().alias(none), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias(row_id))
    marked = materialise(fingerprints(docs).select(*own, F.col("hash").alias(row_hash), "bits"), "fingerprints")
    kept = materialise(_labelled(marked, F.min(F.struct(*key)).alias("row")).groupBy("label").agg(F.min("row").alias("row")).select("row.*"), "kept")
    counts = materialise(count_by(marked, key).where("__n > 1"), "repeated")  # rows given more than once
    # the list of rows that stay grows with the corpus: merged with the texts at every size, never broadcast
    out = spread_join(docs.select("*", *own, text_hash().alias(row_hash)), kept, key, "left_semi", hot_keys(counts, marked.count()))
    if not counts.join(kept, key, "left_semi").isEmpty():
        out = out.dropDuplicates(key)
    return out.drop(*key)
