"""MinHash fingerprints of documents, their likeness to edited texts, and near-duplicate classes by bands.

A text's fingerprint holds, for each of many random universal permutations x -> a*x + b (modulo 2**32, a odd), the
smallest image of its 5-word shingles, cut to 16 bits. The share of places where two fingerprints agree estimates
the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, concluded, grouped, hot_keys, materialise, mixed, sliced, spread_join
from .components import components
from .tiles import deal, forest, groups, shuffled

PERMUTATIONS, SHINGLE, THRESHOLD = 128, 5, 0.8
#: Bands for near-duplicate classes, and signature rows in each.
BANDS, ROWS = 20, 4
#: Bits of the map that says which kinds' shingles are wanted; 4 MB for any input.
WANTED = 1 << 25
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingles(docs: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all documents' shingles in order, and where each document's begin (with the end)."""
    words = Words(docs)
    n = np.diff(words.first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(docs)), count)
    start = words.first[:-1][doc] + np.arange(len(doc)) - bounds[:-1][doc]
    return Rolling(words.hashes()).of(start, np.minimum(start + size, words.first[1:][doc])), bounds


def _lower(least: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> None:
    """Takes each document's shingles into its row of smallest images; doc is ascending."""
    x = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        images = x[at : at + 2048, None] * _A + _B
        own = doc[at : at + 2048]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        least[own[first]] = np.minimum(least[own[first]], np.minimum.reduceat(images, first, axis=0))


def _unsigned(docs: list[bytes]) -> np.ndarray:
    return np.full((len(docs), PERMUTATIONS), 0xFFFFFFFF, np.uint32)


def signatures(docs: list[bytes]) -> np.ndarray:
    """(documents, PERMUTATIONS) of uint32; documents without words have the largest value everywhere."""
    out = _unsigned(docs)
    for index, some in grouped(docs, SHINGLE - 1):
        hashes, bounds = shingles(some)
        _lower(out, hashes, np.repeat(np.array(index, np.int64), np.diff(bounds)))
    return out


def shingle_sets(docs: list[bytes], least: np.ndarray | None = None) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted; their images go into `least`, as in `signatures`, on the way."""
    found: list[list[np.ndarray]] = [[] for _ in docs]
    for index, some in grouped(docs, SHINGLE - 1):
        hashes, bounds = shingles(some)
        own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        for i, x in zip(index, own):
            found[i].append(x)
        if least is not None:
            _lower(least, np.concatenate(own), np.repeat(np.array(index, np.int64), [len(x) for x in own]))
    return [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in found]


def kind_of(own: np.ndarray) -> int:
    """One 64-bit value for a set of shingle hashes; 0 for none."""
    return int(Rolling(own).of(np.array([0]), np.array([len(own)])).view(np.int64)[0]) if len(own) else 0


def fingerprints(docs: list[bytes]) -> np.ndarray:
    return signatures(docs).astype(np.uint16)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _bucket(doc_id: int | None, bounds: list[int]) -> int:
    return 0 if doc_id is None else bisect.bisect_right(bounds, doc_id)


def _first_ids(batches, bounds: list[int]):
    """The smallest doc_id of each bucket in each batch; null counts as smallest."""
    for batch in batches:
        least: dict[int, tuple] = {}
        for i in set(batch.column("doc_id").to_pylist()):
            b, key = _bucket(i, bounds), (i is not None, i or 0)
            least[b] = min(least.get(b, key), key)
        rows = sorted(least.items())
        yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([k[0] for _, k in rows], pa.bool_()), pa.array([k[1] for _, k in rows], pa.int64())], names=["bucket", "has", "doc_id"])


def _dealt(batches, bounds: list[int], heads: dict):
    """Rows with the bucket they belong to; a bucket's first document also goes to the bucket before, as its last next one."""
    press = zstandard.ZstdCompressor(level=6)
    for batch in sliced(batches):
        rows = []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = (t or "").encode()
            z = press.compress(data)
            rows.append((_bucket(i, bounds), 0, i, len(data), z, None, None))
            rows += [(b, 1, i, len(data), z, None, None) for b in heads.get(i, ())]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _PLACED.values())], names=list(_PLACED))


def _marked(batches, bounds: list[int]):
    """A row for each document whose class another one names; it goes where the document's text goes, and before it."""
    for batch in batches:
        ids, kinds, found = (batch.column(k).to_pylist() for k in ("doc_id", "kind", "class_id"))
        n = len(ids)
        columns = ([_bucket(i, bounds) for i in ids], [0] * n, ids, [0] * n, [None] * n, kinds, found)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, _PLACED.values())], names=list(_PLACED))


_PLACED = {"bucket": pa.int32(), "next": pa.int32(), "doc_id": pa.int64(), "size": pa.int64(), "z": pa.binary(), "kind": pa.int64(), "class_id": pa.int64()}
_PLACED_SCHEMA = "bucket int, next int, doc_id long, size long, z binary, kind long, class_id long"


def _compared(batches):
    """Rows come sorted by bucket; each document meets the one after it, and is held until that has come."""
    unpack, held, open_bucket = zstandard.ZstdDecompressor(), None, None
    marks: dict = {}  # kind -> class_id, of the documents with the last doc_id that had marks
    marked = None
    for batch in sliced(batches, "size"):  # unpacked
        rows = list(zip(*(batch.column(k).to_pylist() for k in _PLACED)))
        chain, pairs = [held] if held else [], []
        for bucket, extra, i, _, z, kind, named in rows:
            if z is None:
                if (bucket, i) != marked:
                    marked, marks = (bucket, i), {}
                marks[kind] = named
                continue
            if extra and open_bucket != bucket:  # ties of the next bucket's first doc_id; the first one was it
                continue
            text, own = unpack.decompress(z), i
            if marks and not extra and (bucket, i) == marked:
                own = marks.get(kind_of(shingle_sets([text])[0]), i)
            chain.append((i, text, own))
            if open_bucket == bucket:
                pairs.append(len(chain) - 2)
            open_bucket = None if extra else bucket
        held = chain[-1] if chain and open_bucket is not None else None
        if not pairs:
            continue
        own = fingerprints([c[1] for c in chain])
        edited, lengths = [], []
        for k in pairs:
            text, after = chain[k][1].decode(), chain[k + 1][1].decode()
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
            lengths.append(len(text))
        changed, at = fingerprints(edited), np.array(pairs)
        yield pa.record_batch(
            [pa.array([chain[k][0] for k in pairs], pa.int64()), pa.array(lengths, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(_hex(own[at])), pa.array(_hex(changed)), pa.array(_likeness(own[at], changed)), pa.array(_likeness(own[at], own[at + 1])), pa.array([chain[k][2] for k in pairs], pa.int64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
        )


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every document's fingerprint, its likeness to its edited text's and to the next document's, and its class.

    The next document is the one after it in ascending doc_id (null first; ties in an order of their texts), after the
    last the first; a lone document follows itself. The edited text has its last floor(n/2) code points replaced by
    the next document's first as many. Null texts are empty; texts without words are alike, and unlike all others.
    class_id is that of `near_duplicates`; where it is not the document's own id, it travels with the texts.
    Documents are dealt to buckets of doc_ids, several for each shuffle partition; what reaches the driver is the
    bounds and the first doc_id of each bucket. Very long texts are hashed in parts. Only doc_id and text are read, so
    other columns may have any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    given = _given(docs)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets) if buckets > 1 else F.array()
    bounds = sorted(set(given.agg(cuts.alias("cuts")).first()["cuts"] or ()))
    firsts = given.select("doc_id").mapInArrow(partial(_first_ids, bounds=bounds), "bucket int, has boolean, doc_id long")
    firsts = sorted(firsts.groupBy("bucket").agg(F.min(F.struct("has", "doc_id")).alias("least")).collect())
    heads: dict = {}
    for k, row in enumerate(firsts):
        heads.setdefault(row["least"]["doc_id"] if row["least"]["has"] else None, []).append(firsts[k - 1]["bucket"])
    named = concluded(spark, lambda: _classes(given).where("not doc_id <=> class_id"), "classes")
    # a bucket's own rows come before the next bucket's first one, and marks (without text) before their document's
    dealt = given.mapInArrow(partial(_dealt, bounds=bounds, heads=heads), _PLACED_SCHEMA).unionByName(named.mapInArrow(partial(_marked, bounds=bounds), _PLACED_SCHEMA))
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "next", F.col("doc_id").asc_nulls_first(), F.col("z").asc_nulls_first())
    return placed.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _keyed(batches, bands: int):
    """Each text's kind (a hash of its shingles' set) and a 64-bit key for each band of its signature; null without words."""
    for batch in sliced(batches, limit=1 << 20):
        docs = _encoded(batch)
        rows, least = [], _unsigned(docs)
        for i, pick, own, marks in zip(batch.column("doc_id").to_pylist(), batch.column("pick").to_pylist(), shingle_sets(docs, least), least):
            cut = marks[: bands * ROWS].reshape(bands, ROWS)
            keys = [int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8, salt=k.to_bytes(2, "little")).digest(), "little", signed=True) for k, p in enumerate(cut)]
            rows.append((i, pick, kind_of(own), keys if len(own) else None))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["doc_id", "pick", "kind", "keys"])


def _wanted(rows: DataFrame, column: str) -> np.ndarray:
    """A bit for each residue of the column's hashes: WANTED bits, however many rows there are."""
    at = rows.select(F.col(column).bitwiseAND(F.lit(WANTED - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(WANTED >> 6, np.int64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return out


def _passed(batches, bands: list[int], wanted):
    """(kind, key) of the bands' keys whose bit is set."""
    bits = wanted.value
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if not len(kind):
            continue
        keys = np.array(batch.column("keys").to_pylist(), np.int64)[:, bands]
        at = keys & (WANTED - 1)
        row, band = np.nonzero(bits[at >> 6] >> (at & 63) & 1)
        yield pa.record_batch([pa.array(kind[row]), pa.array(keys[row, band])], names=["kind", "key"])


def _shingled(batches, wanted):
    """(kind, shingles) of the rows whose pick's bit is set, each kind once a task; of each hash the upper 32 bits."""
    bits, seen = wanted.value, set()
    picked = (b.filter(pa.array(bits[at >> 6] >> (at & 63) & 1 == 1)) for b in batches for at in [b.column("pick").to_numpy() & (WANTED - 1)])
    for batch in sliced(picked, limit=1 << 20):
        rows = []
        for own in shingle_sets(_encoded(batch)):
            kind = kind_of(own)
            if len(own) and kind not in seen:
                seen.add(kind)
                rows.append((kind, np.unique((own >> np.uint64(32)).astype(np.uint32)).view(np.int32)))
        if rows:
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int32()))], names=["kind", "shingles"])


def _similar(shingles: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of shingle sets whose Jaccard similarity reaches the threshold; shared shingles are counted block by block."""
    n, size = len(shingles), np.array([len(x) for x in shingles])
    _, place = np.unique(np.concatenate(shingles), return_inverse=True)
    row, order = np.repeat(np.arange(n), size), np.argsort(place, kind="stable")
    row, place, both = row[order], place[order], np.zeros((n, n), np.float64)
    for low in range(0, int(place[-1]) + 1, 16384):
        own = slice(*np.searchsorted(place, [low, low + 16384]))
        there = np.zeros((n, 16384), np.float32)
        there[row[own], place[own] - low] = 1
        both += there @ there.T
    i, j = np.nonzero(np.triu(both >= threshold * (size[:, None] + size - both), 1))
    return i, j


def _verified(batches, threshold: float):
    for bucket in groups(batches, ["key", "part", "other"]):
        kind = bucket.column("kind").to_numpy()
        if kind.min() == kind.max():
            continue
        i, j = _similar([np.array(x, np.int64) for x in bucket.column("shingles").to_pylist()], threshold)
        label = forest(len(kind), i, j)
        moved = np.flatnonzero(kind[label] != kind)
        yield pa.record_batch([pa.array(kind[moved]), pa.array(kind[label[moved]])], names=["a", "b"])


def _links(given: DataFrame, kinds: DataFrame, labels: DataFrame | None, bands: list[int], threshold: float, tile: int) -> DataFrame:
    """Links (a, b) between kinds that share one of the bands. Buckets whose kinds are of one class already are skipped.

    Keys that several kinds have reach the tasks as a bitmap of fixed size, too, so that few others are shuffled again.
    Without labels, a large bucket's kinds meet in two random splits into tiles only, which settles groups of near
    copies in linear time; with labels, all that share a bucket meet. Shingles are shuffled for kinds in such buckets:
    a bitmap of fixed size lets one row of each through to be hashed, and the join drops others that share a bit.
    """
    spark, n = given.sparkSession, kinds.count() * len(bands)
    known = kinds.withColumn("label", F.col("kind")) if labels is None else kinds.join(labels.withColumnRenamed("node", "kind"), "kind", "left").withColumn("label", F.coalesce("label", "kind"))
    banded = known.select("kind", "label", F.explode(F.array(*(F.col("keys")[k] for k in bands))).alias("key"))
    mixed_keys = materialise(banded.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("__n")).where("low < high").select("key", "__n"), "mixed")
    hot = hot_keys(mixed_keys, n)
    sent = spark.sparkContext.broadcast(_wanted(mixed_keys, "key"))
    passed = kinds.mapInArrow(partial(_passed, bands=bands, wanted=sent), "kind long, key long")
    own = materialise(spread_join(passed, mixed_keys.select("key"), ["key"], "left_semi", hot), "banded")
    # buckets with the very same kinds, as two texts that share several bands make, are compared once
    members = own.groupBy("key").agg(F.bit_xor("kind").alias("who"), F.bit_xor(F.xxhash64("kind")).alias("also"), F.count("*").alias("__n"))
    once = materialise(members.groupBy("who", "also", "__n").agg(F.min("key").alias("key")).select("key", "__n"), "once")
    own = materialise(spread_join(own, once.select("key"), ["key"], "left_semi", hot_keys(once, n)), "banded")
    dealt = materialise((shuffled if labels is None else deal)(own, ["key"], "kind", tile), "dealt")
    bits = _wanted(kinds.join(dealt.hint("merge"), "kind", "left_semi"), "pick")
    if not bits.any():
        return spark.createDataFrame([], "a long, b long")
    found = given.mapInArrow(partial(_shingled, wanted=spark.sparkContext.broadcast(bits)), "kind long, shingles array<int>")
    key = ["key", "part", "other"]
    full = dealt.join(found.hint("merge"), "kind").select(*key, "kind", "shingles")
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_verified, threshold=threshold), "a long, b long")


def _classes(given: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, tile: int = 128) -> DataFrame:
    """(doc_id, kind, class_id) of every row."""
    given = given.withColumn("pick", F.xxhash64("doc_id", "text"))
    keyed = materialise(given.mapInArrow(partial(_keyed, bands=bands), "doc_id long, pick long, kind long, keys array<long>"), "keyed")
    kinds = materialise(keyed.groupBy("kind").agg(F.min("doc_id").alias("id"), F.min("pick").alias("pick"), F.first("keys").alias("keys"), F.count("*").alias("__n")), "kinds")
    worded = kinds.where("keys is not null").select("kind", "pick", "keys")
    first = materialise(_links(given, worded, None, [0], threshold, tile), "near")
    labels = materialise(components(first), "labels")
    rest = materialise(_links(given, worded, labels, list(range(bands)), threshold, tile), "near")
    found = components(first.unionByName(rest))
    own = materialise(kinds.select("kind", "id").join(found.withColumnRenamed("node", "kind"), "kind", "left").select("kind", "id", F.coalesce("label", "kind").alias("label")), "own")
    named = own.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("__n"))
    classes = spread_join(own, named.select("label", "class_id"), ["label"], hot=hot_keys(named.select("label", "__n"), kinds.count())).select("kind", "class_id")
    counts = kinds.select("kind", "__n")
    hot = hot_keys(counts, keyed.count())
    return spread_join(keyed.select("doc_id", "kind"), classes, ["kind"], hot=hot).select("doc_id", "kind", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, tile: int = 128) -> DataFrame:
    """(doc_id, class_id): classes of texts whose 5-word shingles have a Jaccard similarity of `threshold` or more.

    Texts with the same shingles are one kind, and only kinds are compared: those that share a signature band, on
    their whole shingle sets (32 bits a shingle). A pair at 0.8 shares one of 20 bands of 4 rows with a probability
    above 0.9999. The first band settles large groups of near copies; then all bands are compared in buckets that
    still hold several classes. class_id is the smallest doc_id of a class; rows without words form one class. Null
    doc_ids get a class, and never name one. Only doc_id and text are read. An empty table gives no rows.
    """
    return _classes(_given(docs), threshold, bands, tile).select("doc_id", "class_id")
