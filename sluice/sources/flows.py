"""Flow records from JSON, as dumped by the usual collector tool, and small configuration files."""

from __future__ import annotations

import dataclasses
import json
import shutil
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators.prototype import Configuration

#: Fields of a record (fixed values of the dump format): those always there, then those that may be missing.
REQUIRED = {
    "type": "string", "sampled": "int", "export_sysid": "long", "t_first": "string", "t_last": "string", "proto": "short", "fwd_status": "short",
    "tcp_flags": "string", "src_tos": "short", "in_packets": "long", "in_bytes": "long", "input_snmp": "long", "output_snmp": "long", "src_as": "long",
    "dst_as": "long", "ip4_router": "string", "engine_type": "short", "engine_id": "long", "t_received": "string", "label": "string",
}
OPTIONAL = {
    "src4_addr": "string", "dst4_addr": "string", "src6_addr": "string", "dst6_addr": "string", "src_port": "int", "dst_port": "int", "src_mask": "short",
    "dst_mask": "short", "dst_tos": "short", "direction": "short", "bgp4_next_hop": "string", "bgp6_next_hop": "string", "icmp_type": "short", "icmp_code": "short",
    "ip4_next_hop": "string", "ip6_next_hop": "string", "in_src_mac": "string", "out_dst_mac": "string", "nat_event_id": "string", "nat_event": "string",
    "ingress_vrf": "string", "egress_vrf": "string",
}
#: Fields that have one value only, where they are there.
CONSTANT = {"type": "FLOW", "sampled": 0, "label": "<none>", "nat_event_id": "0", "nat_event": "IGNORE", "ingress_vrf": "1610612736"}

SCHEMA = ", ".join(f"{k} {v}" for k, v in (REQUIRED | OPTIONAL | {"first": "string", "last": "string"}).items())


def read_json(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Records of JSON arrays, .gz too. A broken file is an error. strict: unknown or missing fields and wrong constants are as well."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not strict:
        return rows
    seen = set(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).columns)
    if unknown := seen - set(REQUIRED) - set(OPTIONAL):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return validated(rows)


def validated(rows: DataFrame) -> DataFrame:
    """The same rows; one that lacks a required field, or has another value than a constant's, is an error."""
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED))
    wrong = F.concat_ws(",", *(F.when(F.col(c).isNotNull() & (F.col(c) != v), F.lit(c)) for c, v in CONSTANT.items()), F.when(~F.col("direction").isin(0, 1), F.lit("direction")), F.when(net.tcp_flags(F.col("tcp_flags")).isNull(), F.lit("tcp_flags")))
    bad = F.concat_ws(" wrong: ", missing, wrong)
    ok = (F.length(missing) == 0) & (F.length(wrong) == 0)
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("bad flow record, "), bad)).cast("boolean")))


def _micros(text: Column) -> Column:
    """Wall-clock time as microseconds; an offset is dropped, not applied."""
    bare = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)", 1)
    seconds = F.unix_micros(F.to_timestamp(F.concat(F.replace(F.substring(bare, 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")), "yyyy-MM-dd'T'HH:mm:ssX"))
    return seconds + F.coalesce(F.rpad(F.nullif(F.substring(bare, 21, 6), F.lit("")), 6, "0").cast("long"), F.lit(0).cast("long"))


def _required(value: Column, name: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"no {name}")))


def slim(rows: DataFrame, location: str = "xxx", family: int = 4) -> DataFrame:
    """The columns that operators read, of the records of one family; call it for each. Times fall back from first and
    last to t_first and t_last; IPv4 addresses win over IPv6 ones; a record with neither, with addresses of different
    families, or without a time, is an error."""
    if family not in (4, 6):
        raise ValueError("the family is 4 or 6")
    parsed = lambda side: net.parse_v4(F.col(side)) if family == 4 else net.parse_v6(side)
    return addressed(rows).where(net.family(F.col("src")) == family).select(
        F.xxhash64("src", "dst", "first", "t_first", "last", "t_last", "src_port").alias("flow_id"),
        F.lit(location).alias("location"),
        parsed("src").alias("src_addr"),
        parsed("dst").alias("dst_addr"),
        "proto",
        "dst_port",
        _micros(_required(F.coalesce("first", "t_first"), "first time")).alias("first_us"),
        _micros(_required(F.coalesce("last", "t_last"), "last time")).alias("last_us"),
        "in_packets",
        "in_bytes",
    )


def both_families(rows: DataFrame, location: str = "xxx") -> list[DataFrame]:
    """The flows of IPv4 and those of IPv6."""
    return [slim(rows, location, family) for family in (4, 6)]


def addressed(rows: DataFrame) -> DataFrame:
    """Records with their addresses as text, src and dst."""
    addresses = rows.select("*", _required(F.coalesce("src4_addr", "src6_addr"), "source address").alias("src"), _required(F.coalesce("dst4_addr", "dst6_addr"), "destination address").alias("dst"))
    mixed = net.family(F.col("src")) != net.family(F.col("dst"))
    return addresses.where(F.when(mixed, F.raise_error(F.lit("source and destination are of different families")).cast("boolean")).otherwise(True))


def packed(rows: DataFrame) -> DataFrame:
    """Records of both families with addresses as bytes, for masks of either family."""
    return addressed(rows).select("*", net.family(F.col("src")).alias("family"), net.parse_any("src").alias("src_bytes"), net.parse_any("dst").alias("dst_bytes"))


def _dumped(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            reader = ["zcat" if path.endswith(".gz") else "cat", path]
            with subprocess.Popen(reader, stdout=subprocess.PIPE) as source:
                out = subprocess.run(["nfdump", "-r", "-", "-o", "json"], stdin=source.stdout, capture_output=True, check=True).stdout
            rows = [json.dumps(x) for x in json.loads(out or b"[]")]
            for at in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array(rows[at : at + 10_000], pa.string())], names=["record"])


def read_dumps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of binary dumps, by the collector's own tool; a task for each file, which all executors can read."""
    if not shutil.which("nfdump"):
        raise RuntimeError("the nfdump tool is not installed; convert the dumps to JSON and use read_json")
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(_dumped, "record string").select(F.from_json("record", SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_config(path: str) -> Configuration:
    """A JSON file in which lines that begin with // (after spaces) are comments."""
    with open(path, encoding="utf-8") as f:
        kept = "".join(line for line in f if not line.lstrip(" ").startswith("//"))
    values = json.loads(kept)
    if "destination_addresses" in values:
        net.networks(values["destination_addresses"])  # bits beyond a prefix are an error
        values["destination_addresses"] = tuple(values["destination_addresses"])
    known = {f.name for f in dataclasses.fields(Configuration)}
    return Configuration(**{k: v for k, v in values.items() if k in known})
