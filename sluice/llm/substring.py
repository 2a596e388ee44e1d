"""Repeated passages by relative Lempel-Ziv parsing.

Every text is a reference for all that come after it. It is cut into reference blocks: for each window of `WINDOW`
words, the 4-word gram of smallest hash in it is the anchor, and neighbouring windows with one anchor form a block.
Blocks depend on their own words only, so a passage that is copied brings its inner blocks along, and the index of
all blocks, keyed by anchor, is spread over the cluster.

A document is factored greedily against it, from left to right. A block that stands in an earlier place as well is a
match with that place as its source; as long as the next block goes on where the source goes on, the factor grows,
else a new one begins. Where an anchor occurs with different blocks around it, a factor begins or ends inside: there
the windows are looked up one by one, and those found earlier extend factors or make new ones. A factor is (start,
length, source, start in the source); all of `WINDOW` words or more are duplicate spans.

Words, anchors, blocks and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, hot_keys, materialise, mixed, parts, sliced, spread_join

WINDOW, GRAM = 20, 4
#: Words of one text that are put into blocks at once; a block ends there, which the boundary check makes good.
PART = 1 << 20
_PLACE_BITS = np.uint64(24)

#: Different blocks of one anchor in one batch that the index takes; with more, they are checked without it.
KINDS = 16
#: What a row of blocks is: one for the index, a match within its batch, one to be checked, a sign that an anchor has many blocks.
INDEXED, MATCHED, ASKED, CROWDED = range(4)

_BLOCK = "anchor long, block long, shift int, n int, doc_id long, th int, at long, state int, src long, src_th int, src_at long"
_SPAN = "doc_id long, th int, at long, n int, anchor long, src long, src_th int, src_at long, sure boolean"


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word; long texts are cut at white space, to bound memory."""
    out, at = [], 0
    while at < len(text):
        end = at + (4 << 20)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(Words([text[at:end]]).hashes())
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def blocks(words: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The reference blocks of texts given as word hashes in a row, text k from first[k] to first[k + 1].

    at: index of the first window's first word. n: windows. shift: words from there to the anchor.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("at", "n", "shift", "doc", "anchor", "block")}
    if len(words) < WINDOW:
        return empty
    rolling = Rolling(words)
    gram = rolling.of(np.arange(len(words) - GRAM + 1), np.arange(GRAM, len(words) + 1))
    places = np.arange(len(gram), dtype=np.uint64)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    ranked = (mixed(gram) & ~low) | places  # of equal grams the first counts
    best = (_smallest(ranked, WINDOW - GRAM + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(best)]
    inside = np.arange(len(best)) + WINDOW <= first[1:][doc]
    window, best, doc = np.flatnonzero(inside), best[inside], doc[inside]
    if not len(window):
        return empty
    new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))))
    at, n = window[new], np.diff(np.append(new, len(window)))
    return {"at": at, "n": n, "shift": best[new] - at, "doc": doc[new], "anchor": gram[best[new]].view(np.int64), "block": rolling.of(at, at + n + WINDOW - 1).view(np.int64)}


def _mark(text: bytes) -> int:
    """Tells different texts of one doc_id apart."""
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def _order(doc_id: np.ndarray) -> np.ndarray:
    """Ranks that sort null (None) doc_ids before all others."""
    known = np.array([i is not None for i in doc_id])
    return np.where(known, np.searchsorted(np.unique([i for i in doc_id if i is not None]), [i or 0 for i in doc_id]) + 1, 0) if len(doc_id) else known


def _batch(ids: list, b: dict[str, np.ndarray], th: np.ndarray, state: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Rows of blocks; source: the row that each matched one has as its source."""
    ids = pa.array(ids, pa.int64())
    matched = pa.array(state == MATCHED)
    of = lambda x: pc.if_else(matched, x, pa.scalar(None, x.type))
    doc, at = ids.take(pa.array(b["doc"])), pa.array(b["at"].astype(np.int64))
    th = pa.array(th.astype(np.int32))
    rows = pa.array(source)
    return pa.record_batch(
        [pa.array(b["anchor"]), pa.array(b["block"]), pa.array(b["shift"].astype(np.int32)), pa.array(b["n"].astype(np.int32)), doc, th, at, pa.array(state.astype(np.int32)), of(doc.take(rows)), of(th.take(rows)), of(at.take(rows))],
        names=["anchor", "block", "shift", "n", "doc_id", "th", "at", "state", "src", "src_th", "src_at"],
    )


def _parsed(batches):
    """The blocks of each text. Those that stand earlier in the same batch are matched here, and are not indexed.

    Of an anchor with more than KINDS different blocks in the batch, all are to be checked at their windows, and one row
    says so to the index. So an anchor has KINDS rows a batch at most there, however many texts share it.
    """
    for batch in sliced(batches):
        ids = batch.column("doc_id").to_pylist()
        docs = [(t or "").encode() for t in batch.column("text").to_pylist()]
        marks = np.array([_mark(t) for t in docs])
        found = []
        if len(docs) == 1:
            words = word_hashes(docs[0])
            for at in range(0, max(len(words) - WINDOW + 1, 0), PART):
                part = blocks(words[at : at + PART + WINDOW - 1], np.array([0, min(PART + WINDOW - 1, len(words) - at)]))
                part["at"] = part["at"] + at
                found.append(part)
        else:
            every = Words(docs)
            part = blocks(every.hashes(), every.first)
            part["at"] = part["at"] - every.first[part["doc"]]
            found.append(part)
        if not found or not any(len(x["at"]) for x in found):
            continue
        b = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
        rank = _order(ids)[b["doc"]]
        th = marks[b["doc"]]
        order = np.lexsort((b["at"], th, rank, b["n"], b["shift"], b["block"], b["anchor"]))
        b, rank, th = {k: x[order] for k, x in b.items()}, rank[order], th[order]
        same, later, head = _repeats([b[k] for k in ("anchor", "block", "shift", "n")], [rank, th, b["at"]])
        first = np.flatnonzero(np.concatenate(([True], b["anchor"][1:] != b["anchor"][:-1])))
        crowded = np.add.reduceat((~same).astype(np.int64), first) > KINDS
        many = np.repeat(crowded, np.diff(np.append(first, len(same))))
        state = np.where(later, MATCHED, np.where(many, ASKED, INDEXED))
        keep = later | ~same  # a row given twice is indexed once
        kept = {k: x[keep] for k, x in b.items()}
        yield _batch(ids, kept, th[keep], state[keep], (np.cumsum(keep) - 1)[head[keep]])
        if crowded.any():
            at = first[crowded]
            yield _batch(ids, {k: x[at] for k, x in b.items()}, th[at], np.full(len(at), CROWDED), np.arange(len(at)))


def _repeats(key: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key, then place: which have the key of the row before; which have it at a later place than the key's first row; that row."""
    n = len(key[0])
    same = np.zeros(n, bool)
    same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in key]) if n else False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return same, same & np.logical_or.reduce([p != p[head] for p in place]), head


def _joined(batches):
    """Rows come sorted by anchor, signs first, then block and place. Gives spans: matches, and those to be checked window by window.

    What is kept from batch to batch is one row, the first of the last block, and whether its anchor has several blocks.
    """
    held, done, several = None, False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch])
        anchor, sign = rows.column("anchor").to_numpy(), rows.column("state").to_numpy() == CROWDED
        null = rows.column("doc_id").is_null().to_numpy()
        same, later, head = _repeats([anchor, sign, *(rows.column(k).to_numpy() for k in ("block", "shift", "n"))], [null, rows.column("doc_id").fill_null(0).to_numpy(), rows.column("th").to_numpy(), rows.column("at").to_numpy()])
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        mixed_ = (np.add.reduceat((~same & ~sign).astype(np.int64), first) > 1) | np.logical_or.reduceat(sign, first)
        if held is not None:
            mixed_[0] |= several
        check = ~same & ~sign & np.repeat(mixed_, np.diff(np.append(first, len(anchor))))
        if done:
            check[0] = False
        places = [rows.column(k).combine_chunks() for k in ("doc_id", "th", "at")]
        for mask, sure in ((later & ~sign, True), (check, False)):
            at = np.flatnonzero(mask)
            if len(at):
                take, source = pa.array(at), pa.array(head[at], mask=np.full(len(at), not sure))
                own = [rows.column(k).combine_chunks().take(take) for k in ("doc_id", "th", "at", "n", "anchor")]
                yield pa.record_batch([*own, *(p.take(source) for p in places), pa.array(np.full(len(at), sure))], names=["doc_id", "th", "at", "n", "anchor", "src", "src_th", "src_at", "sure"])
        last = int(head[-1])
        done = bool(check[last] | sign[last]) or (done and last == 0)
        several = bool(mixed_[-1])
        held = rows.slice(last, 1).combine_chunks().to_batches()[0]


def _pressed(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        docs = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array([_mark(t) for t in docs], pa.int32()), pa.array(list(map(len, docs)), pa.int64()), pa.array([press.compress(t) for t in docs], pa.binary())], names=["doc_id", "th", "size", "z"])


_PRESSED = "doc_id long, th int, size long, z binary"


def _windows(batches):
    """The hashes of all windows of the blocks asked for."""
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches, "size"):
        for doc_id, th, z, asked in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "th", "z", "asked"))):
            rolling = Rolling(word_hashes(unpack.decompress(z)))
            for low in range(0, len(asked), 1 << 15):
                at, n, anchor = (np.array([x[k] for x in asked[low : low + (1 << 15)]], np.int64) for k in ("at", "n", "anchor"))
                start = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = len(start)
                yield pa.record_batch([pa.array(np.repeat(anchor, n)), pa.array(rolling.of(start, start + WINDOW).view(np.int64)), pa.array([doc_id] * rows, pa.int64()), pa.array([th] * rows, pa.int32()), pa.array(start)], names=["anchor", "window", "doc_id", "th", "at"])


def factored(spans: list[dict]) -> list[tuple[int, int, tuple, int]]:
    """(start, length in words, source, start in the source) of a document's factors, from its matches in any order.

    Greedy, from left to right: of the matches that begin at a place, the longest counts; a factor grows while the next
    match goes on in its source, and what a later factor repeats of an earlier one is left to it.
    """
    out: list[list] = []
    for x in sorted(spans, key=lambda x: (x["at"], -x["n"])):
        source, shift, end = (x["src"], x["src_th"]), x["src_at"] - x["at"], x["at"] + x["n"] + WINDOW - 1
        last = out[-1] if out else None
        if last and end <= last[1]:
            continue
        if last and last[2:] == [source, shift] and x["at"] <= last[1]:
            last[1] = end
        else:
            out.append([x["at"], end, source, shift])
    return [(at, end - at, source, at + shift) for at, end, source, shift in out]


def _kept(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches, "size"):
        rows = []
        for doc_id, z, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "z", "spans"))):
            data = unpack.decompress(z)
            n, removed, at, kept = 0, 0, 0, []
            gone = factored(spans or [])
            next_gone = 0
            for part in parts(data):
                words = part.split()
                edge = np.zeros(len(words) + 1, np.int64)
                while next_gone < len(gone) and gone[next_gone][0] < at + len(words):
                    start, size = gone[next_gone][:2]
                    edge[max(start - at, 0)] += 1
                    edge[max(min(start + size - at, len(words)), 0)] -= 1
                    if start + size > at + len(words):
                        break  # goes on in the next part
                    next_gone += 1
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                if len(stay):
                    kept.append(b" ".join(words if len(stay) == len(words) else [words[k] for k in stay.tolist()]))
                n, removed, at = n + len(words), removed + len(words) - len(stay), at + len(words)
            rows.append((doc_id, n, removed, b" ".join(kept).decode()))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, n, src, src_th, src_at): windows at ... at + n - 1 of a text also start at src_at ... of the earlier text src.

    th tells texts of one doc_id apart. Every window that also starts earlier is in a row at least.
    """
    given = _given(docs)
    key = ["anchor", F.col("state").desc(), "block", "shift", "n", F.col("doc_id").asc_nulls_first(), "th", "at"]
    parsed = given.mapInArrow(_parsed, _BLOCK)
    # blocks settled already pass by the index on keys of their own
    spread = F.when(F.col("state").isin(MATCHED, ASKED), F.xxhash64("doc_id", "at")).otherwise(F.col("anchor"))
    placed = parsed.withColumn("key", spread).repartition("key").sortWithinPartitions(*key)
    spans = materialise(placed.mapInArrow(_settled, _SPAN), "factors")
    asked = spans.where("not sure").groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("asked"))
    texts = given.mapInArrow(_pressed, _PRESSED)
    near = texts.alias("t").join(asked.alias("a"), F.expr("t.doc_id <=> a.doc_id and t.th = a.th")).select("t.doc_id", "t.th", "t.size", "t.z", "a.asked")
    windows = materialise(near.mapInArrow(_windows, "anchor long, window long, doc_id long, th int, at long"), "windows")
    first = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "th", "at")).alias("first"), F.count("*").alias("__n")).where("__n > 1")
    first = materialise(first, "first")
    # a line that very many texts share makes hot windows, which are dealt to several tasks
    hot = hot_keys(first.select("anchor", "window", "__n"), windows.count())
    later = spread_join(windows, first.drop("__n"), ["anchor", "window"], "inner", hot).where("not (doc_id <=> first.doc_id and th = first.th and at = first.at)")
    found = later.select("doc_id", "th", "at", F.lit(1).alias("n"), F.col("first.doc_id").alias("src"), F.col("first.th").alias("src_th"), F.col("first.at").alias("src_at"))
    return spans.where("sure").select(found.columns).unionByName(found)


def _settled(batches):
    """Passes on what is settled already; the other blocks are joined by anchor."""
    passed: list[pa.RecordBatch] = []

    def rest():
        for batch in batches:
            state = batch.column("state").to_numpy()
            apart = (state == MATCHED) | (state == ASKED)
            if apart.any():
                passed.append(batch.take(pa.array(np.flatnonzero(apart))))
            yield batch.take(pa.array(np.flatnonzero(~apart))).drop_columns(["key"])

    def out():
        while passed:
            b = passed.pop()
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "th", "at", "n", "anchor", "src", "src_th", "src_at")), pa.array(b.column("state").to_numpy() == MATCHED)], names=["doc_id", "th", "at", "n", "anchor", "src", "src_th", "src_at", "sure"])

    for found in _joined(rest()):
        yield from out()
        yield found
    yield from out()


def _by_document(docs: DataFrame) -> DataFrame:
    found = materialise(matches(docs), "spans")
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "n", "src", "src_th", "src_at")).alias("spans"))


def _listed(batches):
    for batch in batches:
        rows = [(i, at, n, source[0], start) for i, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()) for at, n, source, start in factored(spans)]
        if rows:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_words", "source_id", "source_start"])


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, source_id, source_start): the factors of WINDOW words or more of all documents.

    n_words words from word `start` on also stand in document source_id, from word source_start on: an earlier document,
    or an earlier place of the same one. Orders, nulls and repeated rows are as in remove_repeats.
    """
    return _by_document(docs).mapInArrow(_listed, "doc_id long, start long, n_words long, source_id long, source_start long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of windows that also start earlier.

    Earlier means in a smaller doc_id (null is smallest; different texts of one doc_id in an order of their hashes), or
    before in the same text. Rows that repeat both doc_id and text are one document given twice. A null text has no
    words. kept joins the words left by single spaces. Very long texts are parsed and put together in parts. Only
    doc_id and text are read, so other columns may have any names. An empty table gives no rows.
    """
    texts = _given(docs).mapInArrow(_pressed, _PRESSED)
    both = texts.alias("t").join(_by_document(docs).alias("s"), F.expr("t.doc_id <=> s.doc_id and t.th = s.th"), "left").select("t.doc_id", "t.size", "t.z", "s.spans")
    return both.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
