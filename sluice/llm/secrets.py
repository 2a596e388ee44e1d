"""Secret scans with an incremental ledger of content-addressed blobs.

Every text is a blob, addressed by its SHA-256. The ledger holds, for each pair of blob and rule version scanned
so far, the spans found. A scan hashes all texts, scans one copy of each blob whose pair is not in the ledger yet,
adds it, and joins the findings back to all rows ("paths") that hold the blob. A later version of a table is scanned
with the same ledger, and only what is new in it is read by the rules.

Blobs of which there are very many copies, such as the empty text, are dealt to several tasks in every join.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hot_keys, materialise, sliced, spread_join, texts

KINDS = ("assign", "access", "hex", "pem")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run from AKIA on holds no longer one
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
#: Follows from the rules, and changes whenever one does; blobs are scanned again then.
RULE_VERSION = hashlib.sha256("\n".join(f"{k} {r.flags} {r.pattern}" for k, r in zip(KINDS, (_ASSIGN, _ACCESS, _HEX, _PEM))).encode()).hexdigest()[:16]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings by start, then kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    return sorted(found)


def _scan(batches):
    for batch in sliced(batches):
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts(batch)]
        yield pa.record_batch([batch.column("blob"), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["blob", "found"])


_FOUND = "array<struct<kind: string, start: bigint, end: bigint>>"
LEDGER = f"blob string, rule_version string, found {_FOUND}"


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The ledger's rows; None where it does not exist yet."""
    if path is None:
        return None
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): (doc_id, blob) of every row, and ledger rows of unseen pairs only.

    Which copy of a blob is scanned is settled on ids and addresses alone; the texts of other copies are not moved. A
    null text is the empty blob. Rows with a null doc_id count as paths of their own and are scanned where no other row
    has the blob. Empty tables give empty ones. Only doc_id and text are read. A text is scanned whole, however long.
    """
    paths, entries, _ = _scan_new(docs, ledger, rule_version)
    return paths, docs.sparkSession.createDataFrame([], LEDGER) if entries is None else materialise(entries, "ledger")


def _scan_new(docs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """As scan_new, and the blobs of very many paths. The entries are None where all is known; they are not written yet."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = given.select("doc_id", _blob(F.col("text")).alias("blob"))  # hashing again is cheaper than keeping them
    blobs = materialise(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("__n")), "blobs")
    total = blobs.agg(F.sum("__n")).first()[0] or 0
    hot = hot_keys(blobs.select("blob", "__n"), total)
    new = blobs.select("blob", "doc_id")
    if ledger is not None:
        new = materialise(new.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti"), "unseen")
        if new.isEmpty():
            return paths, None, hot
    # one row for each blob is to be scanned: null ids are told by a flag, so that the join is on equal keys
    key = ["blob", "none", "id"]
    own = lambda df: df.select("blob", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), *(c for c in df.columns if c == "text"))
    held = own(given.select("doc_id", "text", _blob(F.col("text")).alias("blob")))
    again = hot_keys(own(paths).groupBy(*key).agg(F.count("*").alias("__n")), total) if hot is not None else None
    # both sides grow with the corpus: merged at every size, never broadcast
    one = spread_join(held, own(new), key, "left_semi", again).select("blob", "text").mapInArrow(_scan, f"blob string, found {_FOUND}")
    # a row given again with the same id and text is scanned again, and entered once
    entries = one.groupBy("blob").agg(F.first("found").alias("found")).select("blob", F.lit(rule_version).alias("rule_version"), "found")
    return paths, entries, hot


def enter(docs: DataFrame, ledger_path: str) -> None:
    """Scans what the ledger does not hold yet and appends it; the ledger is made where there is none."""
    entries = _scan_new(docs, read_ledger(docs.sparkSession, ledger_path))[1]
    if entries is not None:
        entries.write.mode("append").parquet(ledger_path)


def find_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """(doc_id, blob, found, scanned) of every row; found lists kind, start and end by start, then kind.

    ledger_path: a Parquet folder of earlier scans that new entries are appended to; without it, all are unseen.
    scanned tells whether the row's blob was unseen, and so was scanned now. Null and empty texts, and those without
    secrets, have an empty list; rows with null or repeated ids keep their own. An empty table gives no rows.
    """
    ledger = read_ledger(docs.sparkSession, ledger_path)
    paths, entries, hot = _scan_new(docs, ledger)
    if entries is not None and ledger_path:
        entries = materialise(entries, "ledger")  # the join and the ledger both read them
    told = []
    if entries is not None:
        told.append(entries.select("blob", "found", F.lit(True).alias("scanned")))
    if ledger is not None:  # two scans at once may both have entered a blob; what is clean and known need not be said
        known = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0)).groupBy("blob").agg(F.first("found").alias("found"))
        told.append(known.withColumn("scanned", F.lit(False)))
    found = spread_join(paths, told[0].unionByName(told[1]) if len(told) > 1 else told[0], ["blob"], "left", hot)
    found = found.select("doc_id", "blob", F.coalesce("found", F.array().cast(_FOUND)).alias("found"), F.coalesce("scanned", F.lit(False)).alias("scanned"))
    if entries is not None and ledger_path:
        found = materialise(found, "findings")  # before the ledger changes
        entries.write.mode("append").parquet(ledger_path)
    return found


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans' list, and all spans' list; whether the row's blob was scanned now."""
    base = F.filter("found", lambda x: x["kind"] != "pem")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "scanned")


def _redacted(batches, column: str):
    for batch in sliced(batches):
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
            kept, at = [], 0
            for x in found or ():
                if x["end"] > at:
                    kept += [text[at : max(at, x["start"])], "[SECRET]"] if x["start"] >= at else []
                    at = x["end"]
            out.append(text if text is None or not found else "".join(kept) + text[at:])
        names = [k for k in batch.schema.names if k != column]
        yield pa.record_batch([pa.array(out, pa.string()) if k == "text" else batch.column(k) for k in names], names=names)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with every finding in their text replaced by [SECRET], and n_chars, where there is one, to match.

    Findings are looked up by blob, so rows with null or repeated doc_ids are redacted as well. Texts without findings
    stay as they are, null ones too. Other columns may have any names and types, and stay. An empty table stays empty.
    """
    blob, column = fresh(docs, "__blob"), fresh(docs, "__found")
    _, entries, hot = _scan_new(docs, None)
    hits = materialise(entries.where(F.size("found") > 0).select(F.col("blob").alias(blob), F.col("found").alias(column)), "hits")
    hot = hot.withColumnRenamed("blob", blob) if hot is not None else None
    joined = spread_join(docs.withColumn("text", F.col("text").cast("string")).withColumn(blob, _blob(F.col("text"))), hits, [blob], "left", hot)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields])
    out = joined.select(*(f"`{c}`" for c in docs.columns), column).mapInArrow(partial(_redacted, column=column), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
