"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

A shard file holds records back to back, all integers little-endian:

    u64 n | u32 masked(crc32(the 8 bytes of n)) | n bytes of payload | u32 masked(crc32(payload))

A payload is one document: i64 doc_id, u8 flags (1: doc_id is null), u8 bytes an id (2 or 4), then its ids.
The index file beside it holds i64 doc_id, u8 flags (1: doc_id is null), u64 offset, u32 n_ids a record, for reads in
any order: read_index gives its rows, and read_at the records of any of them, however they were shuffled.
Checksums are CRC-32 rotated right by 15 bits plus a constant, so that a checksum stored in data does not
check itself. Shards follow ascending doc_id; the manifest lists those of successful tasks only, so files of
lost or repeated task attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, sliced, texts
from .tokens import WORD_BPE, encoder

_HEAD, _INDEX, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<qBQI"), struct.Struct("<qBB")
_MASK_DELTA = 0xA282EAD8
_INDEX_TYPE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n_ids", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[bytes, int]:
    """The payload at an offset, and the offset after its record; an error where a checksum differs."""
    n, check = _HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"length checksum differs at {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"payload checksum differs at {at}")
    return payload, at + 16 + n


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return _PAYLOAD.pack(doc_id or 0, doc_id is None, wide) + ids.astype(f"<u{wide}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, wide = _PAYLOAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{wide}", offset=_PAYLOAD.size)


def _write_shard(batches, path: str, vocabulary: str, end_id: int | None):
    encode, shard = encoder(vocabulary), TaskContext.get().partitionId()
    store, base = pafs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
    n_docs = n_tokens = at = 0
    out = index = None
    for batch in sliced(batches):
        if out is None:
            out, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            ids = np.frombuffer(encode.ids(text), "<u2")
            if end_id is not None:
                ids = np.append(ids, np.uint32(end_id))
            record = frame(pack(doc_id, ids))
            out.write(record)
            index.write(_INDEX.pack(doc_id or 0, doc_id is None, at, len(ids)))
            n_docs, n_tokens, at = n_docs + 1, n_tokens + len(ids), at + len(record)
    if out is not None:
        out.close()
        index.close()
        yield pa.record_batch([[shard], [name], [n_docs], [n_tokens], [at]], names=["shard", "file", "n_docs", "n_tokens", "n_bytes"])


def write_records(docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end_id: int | None = 2) -> list[dict]:
    """Encode every text and write it under `path` (a URI that all executors can write to); returns the manifest.

    One shard a task, in ascending doc_id (null first; ties by text). Null texts are empty, and hold the end id
    only. Repeated rows become repeated records. The manifest has a row for each shard, so it is bounded by the
    number of tasks: {"shard", "file", "n_docs", "n_tokens", "n_bytes"}, in order of the shards.
    """

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = placed.mapInArrow(partial(_write_shard, path=path, vocabulary=vocabulary, end_id=end_id), "shard long, file string, n_docs long, n_tokens long, n_bytes long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["shard"])


def _read_shards(batches, path: str):
    store, base = pafs.FileSystem.from_uri(path)
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_stream(f"{base}/{row['file']}.idx") as f:
                index = np.frombuffer(f.read(), _INDEX_TYPE)
            if len(index) != row["n_docs"]:
                raise ValueError(f"{row['file']}: the index has {len(index)} records, the manifest {row['n_docs']}")
            at, ends = row["start"], np.append(index["offset"][1:], np.uint64(np.iinfo(np.int64).max))
            with store.open_input_stream(f"{base}/{row['file']}.rec") as f:
                found, size = [], 0
                for k in range(len(index)):
                    data = f.read(int(ends[k] - index["offset"][k])) if k + 1 < len(index) else f.read()
                    payload, end = unframe(data, 0)
                    doc_id, ids = unpack(payload)
                    if end != len(data) or len(ids) != index["n_ids"][k]:
                        raise ValueError(f"{row['file']}: record {k} does not fit its index")
                    ids = ids.astype("<u4")
                    found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids))
                    at, size = at + len(ids), size + ids.nbytes
                    if size > 4 << 20:
                        yield _batch(found)
                        found, size = [], 0
                if found:
                    yield _batch(found)


def read_records(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all records, each checked; start counts the ids before it."""
    start, rows = 0, []
    for shard in manifest:
        rows.append((shard["file"], start, shard["n_docs"]))
        start += shard["n_tokens"]

    shards = spark.createDataFrame(rows, "file string, start long, n_docs long")
    return shards.repartition(max(1, len(rows))).mapInArrow(partial(_read_shards, path=path), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _indexed(batches, path: str):
    store, base = pafs.FileSystem.from_uri(path)
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_stream(f"{base}/{row['file']}.idx") as f:
                index = np.frombuffer(f.read(), _INDEX_TYPE)
            ends = np.append(index["offset"][1:], np.uint64(row["n_bytes"])).astype(np.int64)
            doc = pa.array(index["doc_id"].astype(np.int64), mask=index["null"].astype(bool))
            offset = index["offset"].astype(np.int64)
            yield pa.record_batch([pa.array([row["file"]] * len(index), pa.string()), doc, pa.array(offset), pa.array(ends - offset), pa.array(index["n_ids"].astype(np.int64))], names=["file", "doc_id", "offset", "n_bytes", "n_tokens"])


def read_index(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """(file, doc_id, offset, n_bytes, n_tokens) of every record; no record itself is read."""
    shards = spark.createDataFrame([(m["file"], m["n_bytes"]) for m in manifest], "file string, n_bytes long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(partial(_indexed, path=path), "file string, doc_id long, offset long, n_bytes long, n_tokens long")


def _read_at(batches, path: str):
    store, base = pafs.FileSystem.from_uri(path)
    name, file = None, None
    try:
        for batch in batches:
            for part in sliced([batch], "n_bytes"):
                found = []
                for row in part.to_pylist():
                    if row["file"] != name:
                        if file:
                            file.close()
                        name, file = row["file"], store.open_input_file(f"{base}/{row['file']}.rec")
                    payload, end = unframe(file.read_at(row["n_bytes"], row["offset"]), 0)
                    doc_id, ids = unpack(payload)
                    if end != row["n_bytes"] or doc_id != row["doc_id"] or len(ids) != row["n_tokens"]:
                        raise ValueError(f"{name}: the record at {row['offset']} does not fit its index")
                    found.append((doc_id, row["offset"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype("<u4")))
                yield _batch(found, "offset")
    finally:
        if file:
            file.close()


def read_at(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, offset, n_tokens, ids_crc32, ids) of the records that rows of the index name, in whatever order they come.

    rows: (file, doc_id, offset, n_bytes, n_tokens), shuffled, filtered or repeated at will; each is read at its offset
    and checked. An empty table gives no rows.
    """
    wanted = rows.select("file", F.col("doc_id").cast("long").alias("doc_id"), "offset", "n_bytes", "n_tokens")
    return wanted.mapInArrow(partial(_read_at, path=path), "doc_id long, offset long, n_tokens long, ids_crc32 long, ids array<int>")


def _batch(rows: list[tuple], place: str = "start") -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows)
    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(np.concatenate(ids).view("<i4"), pa.int32()))
    return pa.record_batch([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), lists], names=["doc_id", place, "n_tokens", "ids_crc32", "ids"])


def round_trip(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """Write all documents as records to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    return read_records(spark, path, write_records(docs, path, vocabulary, end_id)).select("doc_id", "start", "n_tokens", "ids_crc32")
