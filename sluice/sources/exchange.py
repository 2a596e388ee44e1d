"""The pipeline's own files: aggregates, attackers, catchments, results and reports, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators.ingest import INTERVALS

AGGREGATE_KEY = ["location", "src_net", "time", "proto", "dst_addr"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


#: Rows of one JSON document that is written; a task writes as many files as it takes.
_ROWS_BITS = 17


def _documents(pairs: DataFrame, value: Column, path: str) -> None:
    """Files of one JSON document each, made of some of the rows; every task writes its own."""
    chunk = F.shiftright(F.monotonically_increasing_id(), _ROWS_BITS).alias("chunk")
    pairs.select("*", chunk).groupBy("chunk").agg(value.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_aggregates(spark: SparkSession, path: str, location: str = "xxx", family: int = 4) -> DataFrame:
    """The part of one family of {"ipv4": [[[time, proto, src, dst], {"total_packets": n}], ...], "ipv6": ...}.

    Each file is such a document; one that has neither part is an error. Addresses are as in flows of that family.
    """
    part, parse = (("ipv4", net.parse_v4), ("ipv6", net.parse_v6))[family == 6]
    whole = _whole(spark, path).where(F.length(F.trim("value")) > 0).select(F.from_json("value", "ipv4 array<array<string>>, ipv6 array<array<string>>").alias("d"))
    neither = F.col("d.ipv4").isNull() & F.col("d.ipv6").isNull()
    pair = F.explode(F.when(neither, F.raise_error(F.lit("a file of aggregates has neither ipv4 nor ipv6")).cast("array<array<string>>")).otherwise(F.col(f"d.{part}"))).alias("pair")
    key = F.from_json(F.col("pair")[0], "array<string>")
    value = F.from_json(F.col("pair")[1], "total_packets bigint")["total_packets"]
    rows = whole.select(pair).select(key.alias("k"), value.alias("total_packets"))
    bare = lambda x: F.split(x, "/")[0]
    return rows.select(F.lit(location).alias("location"), parse(bare(F.col("k")[2])).alias("src_net"), parse(bare(F.col("k")[3])).alias("dst_addr"), F.col("k")[1].cast("short").alias("proto"), F.col("k")[0].cast("long").alias("time"), "total_packets")


def write_aggregates(path: str, *aggregates: DataFrame) -> None:
    """Files of {"ipv4": [[[time, proto, src, dst], {"total_packets": n}], ...], "ipv6": ...}, which read_aggregates reads.

    aggregates: tables of either family.
    """
    pairs = None
    for rows in aggregates:
        key = F.concat(F.lit("[["), F.col("time"), F.lit(","), F.col("proto"), F.lit(',"'), net.text_of(rows, "src_net"), F.lit('","'), net.text_of(rows, "dst_addr"), F.lit('"],{"total_packets":'), F.col("total_packets"), F.lit("}]"))
        own = rows.select(F.lit(6 if net.is_v6(rows, "src_net") else 4).alias("family"), key.alias("pair"))
        pairs = own if pairs is None else pairs.unionByName(own)
    of = lambda family: F.concat_ws(",", F.collect_list(F.when(F.col("family") == family, F.col("pair"))))
    _documents(pairs, F.concat(F.lit('{"ipv4":['), of(4), F.lit('],"ipv6":['), of(6), F.lit("]}")), path)


def table_of(path: str, family: int) -> str:
    """Where the aggregates of a family are stored: those of IPv6 have a table of their own beside the other."""
    return path if family == 4 else path.rstrip("/") + "-ipv6"


def store_aggregates(aggregates: DataFrame, path: str, interval: int) -> None:
    """Parquet by interval and location. Stored intervals are never overwritten; a repeated key, a location of more than
    four characters or an unknown interval is an error."""
    if interval not in INTERVALS:
        raise ValueError(f"the interval is one of {INTERVALS}")
    rows = aggregates.where(F.when(F.length("location") <= 4, True).otherwise(F.raise_error(F.lit("a location has four characters at most")).cast("boolean")))
    unique(rows, AGGREGATE_KEY).write.partitionBy("location").mode("errorifexists").parquet(f"{path}/agg_interval={interval}")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored intervals; filters on agg_interval and location skip whole folders."""
    return spark.read.parquet(path)


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """The same rows; a key that repeats is an error."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key: {twice[0].asDict()}")
    return rows


def read_attackers(spark: SparkSession, path: str, family: int = 4) -> DataFrame:
    """(src_addr, weight) from an object of addresses and weights: those of one family."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,double>")).alias("ip", "weight"))
    return rows.select((net.parse_v6("ip") if family == 6 else net.parse_v4(F.col("ip"))).alias("src_addr"), "weight").where("src_addr is not null")


def read_catchment(spark: SparkSession, path: str) -> DataFrame:
    """(entry, start, end, dst_addr, location, factor) from [[networks, {destination: {location: factor}}], ...].

    An entry spans from its first network's start to its last one's end.
    """
    entries = _whole(spark, path).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("entry", "pair"))
    nets, known = F.from_json(F.col("pair")[0], "array<string>"), F.from_json(F.col("pair")[1], "map<string,map<string,double>>")
    start = net.parse_v4(F.split(nets[0], "/")[0])
    last = F.element_at(nets, -1)
    size = F.expr("shiftleft(1L, 32 - cast(split(element_at(n, -1), '/')[1] as int))")
    spans = entries.withColumn("n", nets).select(F.col("entry").cast("long").alias("entry"), start.alias("start"), (net.parse_v4(F.split(last, "/")[0]) + size - 1).alias("end"), F.explode(known).alias("dst", "at"))
    return spans.select("entry", "start", "end", net.parse_v4(F.col("dst")).alias("dst_addr"), F.explode("at").alias("location", "factor"))


RESULT = "array<array<string>>"
CONFIG = "location string, iprange_dst string, window_start bigint, train_length bigint, test_length bigint, min_active bigint, min_pkts_avg bigint, low_pass bigint, above_train_limit double"
SUMS = "total double, true_positives double, true_negatives double, false_positives double, false_negatives double"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of arrays of [configuration, sums], each on a line of its own, from all files below a folder.

    The attack's bandwidth and the number of evading networks come from the path: ..._<n>bps... and ...<n>ips/...
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.input_file_name().alias("file"))
    pairs = rows.select("file", F.explode(F.from_json("value", RESULT)).alias("pair"))
    flat = pairs.select("file", F.from_json(F.col("pair")[0], CONFIG).alias("c"), F.from_json(F.col("pair")[1], SUMS).alias("s")).select("file", "c.*", "s.*")
    number = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit("")).try_cast("long")
    return flat.select(
        "location", net.parse_v4(F.split("iprange_dst", "/")[0]).alias("dst_addr"), number(r"_(\d+)bps").alias("attack_bandwidth"), number(r"(\d+)ips/").alias("evasion_ips"), "window_start", "train_length", "test_length", "min_active", "min_pkts_avg", "low_pass",
        F.col("above_train_limit").alias("above_limit"), F.col("true_positives").alias("tp"), F.col("true_negatives").alias("tn"), F.col("false_positives").alias("fp"), F.col("false_negatives").alias("fn"), "total", "file",
    )


def write_results(results: DataFrame, path: str, bandwidth: int) -> None:
    """A folder for each location and destination below <path>, whose name carries the bandwidth; lines of [configuration, sums]."""
    config = F.struct("location", net.cidr_v4(F.col("dst_addr"), 32).alias("iprange_dst"), "window_start", "train_length", "test_length", "min_active", "min_pkts_avg", "low_pass", F.col("above_limit").alias("above_train_limit"))
    sums = F.struct("total", F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"))
    line = F.concat(F.lit("[["), F.to_json(config), F.lit(","), F.to_json(sums), F.lit("]]"))
    results.select("location", F.col("dst_addr").alias("dst"), line.alias("value")).write.partitionBy("location", "dst").text(f"{path}/results_{bandwidth}bps")


OPTIMA = "location string, iprange_dst string, attack_bandwidth bigint, test_length bigint, low_pass bigint, avg_fpr double, avg_attack_traffic double, best_params struct<train_length: bigint, min_active: bigint, min_pkts_avg: bigint, low_pass: bigint, above_train_limit: double>"
PEAKS = "location string, iprange_src string, total_packets_max bigint, total_packets_sum bigint, active_hours bigint"
DIFFS = "config struct<location: string, iprange_dst: string, train_length: bigint, test_length: bigint, min_active: bigint, min_pkts_avg: bigint, low_pass: bigint, above_train_limit: double>, diffs array<struct<attack_traffic: double, fpr: double>>"
EVASIONS = "location string, iprange_dst string, evasion_ips bigint, fpr double, attack_traffic double, params struct<window_start: bigint, train_length: bigint, test_length: bigint, min_active: bigint, min_pkts_avg: bigint, low_pass: bigint, above_train_limit: double>"


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of peak rates."""
    return spark.read.schema(PEAKS).json(path)


def read_optima(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of optima, from a file or a pattern such as *_results_*.json."""
    return spark.read.schema(OPTIMA).option("multiLine", True).json(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(config fields, idx, attack_traffic, fpr) of churn differences, idx from 0."""
    rows = spark.read.schema(DIFFS).option("multiLine", True).json(path)
    return rows.select("config.*", F.posexplode("diffs").alias("idx", "diff")).select("*", "diff.*").drop("diff")


def read_evasions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVASIONS).option("multiLine", True).json(path)


def write_allowlist(allowlist: DataFrame, path: str | None) -> None:
    """CSV with header; "-" prints it, as every row comes to the driver then; None prints the number of rows only."""
    if path is None:
        print(f"{allowlist.count()} entries")
    elif path == "-":
        print("ip,packets")
        for row in allowlist.toLocalIterator():
            print(f"{row['ip']},{row['packets']}")
    else:
        allowlist.select("ip", "packets").write.option("header", True).csv(path)


def write_table(rows: DataFrame, path: str, key: list[str], by: str = "location") -> None:
    """Parquet by location; null keys and repeated keys are errors."""
    filled = rows.where(F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in key), F.lit(0)) == 0, True).otherwise(F.raise_error(F.lit("a key column is null")).cast("boolean")))
    unique(filled, key).write.partitionBy(by).mode("errorifexists").parquet(path)


def _report(rows: DataFrame, path: str) -> None:
    _documents(rows, F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.to_json(F.struct(*rows.columns)))), F.lit("]")), path)


def write_optima(optima: DataFrame, path: str) -> None:
    """Arrays of optima, which read_optima reads; a series whose rates are all null has no best_params."""
    known = [c for c in ("train_length", "min_active", "min_pkts_avg", "above_limit") if c in optima.columns]
    best = F.struct("train_length", "min_active", "min_pkts_avg", "low_pass", F.col("above_limit").alias("above_train_limit")) if known else None
    more = [F.when(F.col("train_length").isNotNull(), best).alias("best_params")] if known else []
    _report(optima.select("location", net.cidr_v4(F.col("dst_addr"), 32).alias("iprange_dst"), "attack_bandwidth", "test_length", "low_pass", "avg_fpr", "avg_attack_traffic", *more), path)


def write_evasions(means: DataFrame, path: str) -> None:
    """Arrays of means under evasion, which read_evasions reads; a series counts from its first window."""
    dst = net.cidr_v4(F.col("dst_addr"), 32).alias("iprange_dst")
    params = F.struct("location", dst, F.lit(1).alias("window_start"), "train_length", "test_length", "min_active", "min_pkts_avg", "low_pass", F.col("above_limit").alias("above_train_limit"))
    _report(means.select("location", dst, "evasion_ips", "fpr", "attack_traffic", params.alias("params")), path)


def json_rows(rows: DataFrame) -> DataFrame:
    """(json) of each row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def json_object(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: an object of all keys and values, in order of the keys. Meant for exports of bounded size."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return rows.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
