"""Helpers shared by the corpus operators: shared storage, bounded batches, hashing."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the Python workers; bounds their memory whatever Arrow delivers.
SLICE_BYTES = 2 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the master is local (tests), a temporary folder takes its place; on a cluster
    an unset folder is an error, since a machine-local one would lose data with its executor.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and reread: cuts the lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def concluded(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows of build(), written; tables written on the way are removed, and shuffles that led there can go, too.

    Nothing that is read later depends on them, so losing executors stays as cheap as before.
    """
    before = len(_made)
    found = materialise(build(), label)
    passed, _made[before:] = _made[before:-1], _made[-1:]
    for session, path in passed:
        remove(session, path)
    gc.collect()  # Spark drops shuffle files once neither Python nor the JVM refers to their plan
    spark.sparkContext._jvm.System.gc()
    return found


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may have ended before, or the folder may be gone
            continue


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds more than `limit` bytes of `column` (but one row at least).

    A column of whole numbers tells the bytes itself, as where texts come pressed.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        held = batch.column(column)
        lengths = pc.fill_null(held if pa.types.is_integer(held.type) else pc.binary_length(held), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < n:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


_SPACE, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")


def parts(text: bytes, overlap: int = 0, limit: int | None = None) -> Iterator[bytes]:
    """The text in parts of about `limit` bytes (SLICE_BYTES), cut before white space; a short one comes whole.

    Each part but the first begins with the last `overlap` words of the one before, and each holds more words than
    that, so every run of overlap + 1 words stands in exactly one part. A word is never cut, however long.
    """
    limit = limit or SLICE_BYTES
    start, end = 0, 0
    while True:
        end = max(end, start + limit)
        while True:
            cut = _SPACE.search(text, end) if end < len(text) else None
            end = cut.start() if cut else len(text)
            if end == len(text) or len(text[start:end].split(None, overlap + 1)) > overlap:
                break
            end += limit
        if end < len(text) and not _WORD.search(text, end):
            end = len(text)
        yield text[start:end]
        if end == len(text):
            return
        start = start + len(text[start:end].rsplit(None, overlap)[0]) if overlap else end


def grouped(docs: Iterable[bytes], overlap: int = 0) -> Iterator[tuple[list[int], list[bytes]]]:
    """(indices, parts) of texts: parts of several texts together, but about SLICE_BYTES at most at once."""
    held: tuple[list[int], list[bytes]] = ([], [])
    size = 0
    for k, doc in enumerate(docs):
        for part in parts(doc, overlap):
            if size and size + len(part) > 2 * SLICE_BYTES:
                yield held
                held, size = ([], []), 0
            held[0].append(k)
            held[1].append(part)
            size += len(part)
    if held[0]:
        yield held


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key is hot that has more than HOT_ROWS rows and more than a HOT_SHARE-th of all; so fewer than HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 250, 20_000


def hot_keys(counts: DataFrame, total: int) -> DataFrame | None:
    """(key columns, __parts) of the hot keys, from (key columns, __n) of all keys or of the larger ones; None without any.

    There are fewer than HOT_SHARE of them, whatever the table holds, so they may be collected and broadcast. __parts
    is the number of tasks that the key's rows are dealt to.
    """
    if total <= HOT_ROWS:
        return None
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.where(F.col("__n") > most).select(*(c for c in counts.columns if c != "__n"), F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def spread_join(rows: DataFrame, one: DataFrame, key: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with `one`, which has a row for each key at most (how: inner, left or left_semi).

    The rows of hot keys are dealt to several tasks, each of which gets a copy of the key's one row; this needs no
    adaptive execution. hot: as hot_keys gives it. A null key matches nothing.
    """
    if hot is None:
        return rows.join(one.hint("merge"), key, how)
    many, salt = fresh(rows, "__parts"), fresh(rows, "__salt")
    hot = F.broadcast(hot.withColumnRenamed("__parts", many))
    own = F.when(F.col(many).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(many))).cast("int")
    dealt = rows.join(hot, key, "left").withColumn(salt, own).drop(many)
    copies = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(many, F.lit(1)) - 1))).drop(many)
    return dealt.join(copies.hint("merge"), [*key, salt], how).drop(salt)


def count_by(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("__n"))


_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASE, _INVERSE = 0x9DDFEA08EB382D69, pow(0x9DDFEA08EB382D69, -1, 1 << 64)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts: their places, 64-bit hashes and documents.

    data: the texts' UTF-8 bytes with a space after each. start, end: byte offsets of each word.
    doc: index of each word's text. hash: one 64-bit value a word, by a polynomial over its bytes.
    """

    def __init__(self, docs: list[bytes], fold: bool = False):
        joined = b" ".join(docs) + b" "
        if fold:
            joined = joined.lower()
        self.raw = joined
        self.data = np.frombuffer(joined, np.uint8)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.start) > len(self.end):
            self.end = np.append(self.end, len(self.data))
        self.base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in docs]))).astype(np.int64)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.base)  # index of each document's first word, and the count

    def hashes(self) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(self.data)), dtype=np.uint64)))
        value = (total[self.end] - total[self.start]) * powers(_INVERSE, len(self.data))[self.start]
        return mixed(value ^ (self.end - self.start).astype(np.uint64) * _M1)


_ROLL, _ROLL_INVERSE = 0xC6BC279692B5C323, pow(0xC6BC279692B5C323, -1, 1 << 64)


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(_ROLL, len(values)), dtype=np.uint64)))
        self.back = powers(_ROLL_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])
