"""Flow records, attackers and a catchment derived from the test tables by integer arithmetic, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import attack, evaluate, ingest, series, windows

NET0, DST_A, DST_B = 167772160, 3325256705, 3325256706
NOW = 1706659200
BANDWIDTH = 4444


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    value = F.floor("value").cast("long")
    return e.select(
        F.col("event_id").alias("flow_id"),
        F.when(F.col("user_id") % 4 < 3, "aaa").otherwise("bbb").alias("location"),
        (F.lit(NET0) + (F.col("user_id") % 32) * 256 + F.col("event_id") % 256).cast("long").alias("src_addr"),
        F.when(F.col("event_type").isin("click", "view"), F.lit(DST_A)).otherwise(F.lit(DST_B)).alias("dst_addr"),
        F.when(F.col("event_id") % 10 == 9, 6).otherwise(17).cast("short").alias("proto"),
        F.when(F.col("event_id") % 13 == 12, 443).otherwise(53).alias("dst_port"),
        us.alias("first_us"),
        (us + (F.col("event_id") % 7) * 600000000).alias("last_us"),
        F.when(F.col("event_id") % 7 == 0, F.lit(1).cast("long")).otherwise(value + 2).alias("in_packets"),
        ((F.col("event_id") % 5 + 1) * 60 + value * 90).cast("long").alias("in_bytes"),
    )


def flows_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows between IPv6 addresses: 10.0.k.x is 2001:db8:k::(x + 1)."""
    f = flows(spark, sf_dir)
    k, x = F.shiftright("src_addr", 8).bitwiseAND(255), F.col("src_addr").bitwiseAND(255)
    src = F.concat(F.lit("2001:db8:"), F.lower(F.hex(k)), F.lit("::"), F.hex(x + 1))
    dst = F.when(F.col("dst_addr") == DST_A, "2001:db8:ffff::53").otherwise("2001:0DB8:ffff:0:0:0:198.51.100.2")
    return f.withColumns({"src_addr": net.parse_v6(src), "dst_addr": net.parse_v6(dst)})


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dns_flows(flows(spark, sf_dir))


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.aggregates(dns(spark, sf_dir))


def attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("(c_custkey % 64) % 3 = 0")
    addressed = c.select((F.lit(NET0) + (F.col("c_custkey") % 64) * 256 + F.col("c_custkey") % 200).cast("long").alias("src_addr"), (F.col("c_custkey") % 7 + 1).cast("double").alias("weight"))
    return attack.weights_by_network(addressed)


def catchment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of three /24 networks and a gap, for one destination each, seen at one location or both."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("entry"))
    at = F.when(F.col("entry") % 3 == 0, F.array(F.struct(F.lit("aaa").alias("location"), F.lit(0.25).alias("factor")))).when(F.col("entry") % 3 == 1, F.array(F.struct(F.lit("aaa").alias("location"), F.lit(0.5).alias("factor")), F.struct(F.lit("bbb").alias("location"), F.lit(0.75).alias("factor")))).otherwise(F.array(F.struct(F.lit("bbb").alias("location"), F.lit(1.5).alias("factor"))))
    return n.select("entry", (F.lit(NET0) + F.col("entry") * 1024).alias("start"), (F.lit(NET0) + F.col("entry") * 1024 + 767).alias("end"), F.when(F.col("entry") % 2 == 0, F.lit(DST_A)).otherwise(F.lit(DST_B)).alias("dst_addr"), F.inline(at))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dense_series(aggregates(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str, lengths: tuple[int, ...] = windows.TRAIN_LENGTHS) -> DataFrame:
    return windows.window_stats(dense(spark, sf_dir), lengths)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates(spark, sf_dir).select("location", "dst_addr").distinct()


def attack_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.attack_by_location(attack.attack_rates(attackers(spark, sf_dir), BANDWIDTH), targets(spark, sf_dir))


def hours(spark: SparkSession, sf_dir: str) -> int:
    return _hours(aggregates(spark, sf_dir))


def _hours(counts: DataFrame) -> int:
    row = series.hour_range(counts).first()
    return (row["last"] - row["first"]) // 3600 + 1


GRID = {"train_lengths": (8, 24), "test_lengths": (8, 24, 72), "active_minima": (1, 4), "packet_minima": (4, 64), "low_passes": (128, 512), "above_limits": (1.0, 2.0)}


def evaluation(spark: SparkSession, sf_dir: str, **grid) -> DataFrame:
    """Results of a grid. The counts and the windows are read several times, so they are kept; they spill to disk, and are made anew if lost."""
    grid = grid or GRID
    lengths = tuple(sorted({*grid["train_lengths"], *grid["test_lengths"]}))
    counts = aggregates(spark, sf_dir).persist()
    hit = attack.attack_by_location(attack.attack_rates(attackers(spark, sf_dir), BANDWIDTH), counts.select("location", "dst_addr").distinct())
    return evaluate.evaluate_grid(windows.window_stats(series.dense_series(counts), lengths).persist(), hit, _hours(counts), **grid)


#: DuckDB common table expressions, each with those it needs.
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "flows": ((), """SELECT event_id AS flow_id, CASE WHEN user_id % 4 < 3 THEN 'aaa' ELSE 'bbb' END AS location,
 CAST(167772160 + (user_id % 32) * 256 + event_id % 256 AS BIGINT) AS src_addr,
 CAST(CASE WHEN event_type IN ('click', 'view') THEN 3325256705 ELSE 3325256706 END AS BIGINT) AS dst_addr,
 CAST(CASE WHEN event_id % 10 = 9 THEN 6 ELSE 17 END AS SMALLINT) AS proto, CASE WHEN event_id % 13 = 12 THEN 443 ELSE 53 END AS dst_port,
 CAST(epoch_us(ts) AS BIGINT) AS first_us, CAST(epoch_us(ts) + (event_id % 7) * 600000000 AS BIGINT) AS last_us,
 CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 + CAST(floor(value) AS BIGINT) END AS BIGINT) AS in_packets,
 CAST(60 * (event_id % 5 + 1) + CAST(floor(value) AS BIGINT) * 90 AS BIGINT) AS in_bytes FROM events"""),
    "packets": (("flows",), """SELECT flow_id, location, src_addr, dst_addr, proto, CAST(i AS BIGINT) AS i,
 CAST(first_us * 1000 + i * CASE WHEN in_packets > 1 THEN ((last_us - first_us) * 1000) // (in_packets - 1) ELSE 0 END AS BIGINT) AS time_ns,
 CAST(in_bytes // in_packets + CASE WHEN i = 0 THEN in_bytes % in_packets ELSE 0 END AS BIGINT) AS bytes
 FROM flows, unnest(range(0, in_packets)) AS u(i) WHERE dst_port = 53 AND proto IN (6, 17)"""),
    "nfaggregates": (("packets",), """SELECT location, CAST((src_addr // 256) * 256 AS BIGINT) AS src_net, dst_addr, proto,
 CAST((time_ns // 1000000000) - (time_ns // 1000000000) % 3600 AS BIGINT) AS time, CAST(count(*) AS BIGINT) AS total_packets FROM packets GROUP BY ALL"""),
    "attackers": ((), """SELECT CAST(167772160 + (c_custkey % 64) * 256 AS BIGINT) AS src_net, CAST(sum(1 + c_custkey % 7) AS DOUBLE) AS weight
 FROM customer WHERE (c_custkey % 64) % 3 = 0 GROUP BY 1"""),
    "catchment": ((), """SELECT n_nationkey AS entry, CAST(167772160 + n_nationkey * 1024 AS BIGINT) AS "start", CAST(167772160 + n_nationkey * 1024 + 767 AS BIGINT) AS "end",
 CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3325256705 ELSE 3325256706 END AS BIGINT) AS dst_addr, location, factor
 FROM nation JOIN (VALUES (0, 'aaa', 0.25), (1, 'aaa', 0.5), (1, 'bbb', 0.75), (2, 'bbb', 1.5)) v(kind, location, factor) ON n_nationkey % 3 = kind"""),
    "dense": (("nfaggregates",), """SELECT k.location, k.src_net, k.dst_addr, h.time, row_number() OVER (PARTITION BY k.location, k.src_net, k.dst_addr ORDER BY h.time) AS i,
 coalesce(n.total_packets, 0) AS packets FROM (SELECT DISTINCT location, src_net, dst_addr FROM nfaggregates) k
 CROSS JOIN (SELECT unnest(range(min(time), max(time) + 1, 3600)) AS time FROM nfaggregates) h
 LEFT JOIN (SELECT * FROM nfaggregates WHERE proto = 17) n ON n.location = k.location AND n.src_net = k.src_net AND n.dst_addr = k.dst_addr AND n.time = h.time"""),
    "sums": (("dense",), """SELECT *, sum(packets) OVER w AS c, sum(CASE WHEN packets > 0 THEN 1 ELSE 0 END) OVER w AS a FROM dense
 WINDOW w AS (PARTITION BY location, src_net, dst_addr ORDER BY i ROWS UNBOUNDED PRECEDING)"""),
    "stats": (("sums",), """SELECT s.location, s.src_net, s.dst_addr, s.i - t + 1 AS time_start, t AS train_window, CAST(s.c - coalesce(p.c, 0) AS BIGINT) AS total,
 CAST(s.a - coalesce(p.a, 0) AS BIGINT) AS active, CAST(s.c - coalesce(p.c, 0) AS DOUBLE) / (s.a - coalesce(p.a, 0)) AS average
 FROM sums s CROSS JOIN unnest([1, 2, 4, 8, 12, 24, 25, 48, 49, 72, 73]) AS u(t)
 LEFT JOIN sums p ON p.location = s.location AND p.src_net = s.src_net AND p.dst_addr = s.dst_addr AND p.i = s.i - t
 WHERE s.i >= t AND s.a - coalesce(p.a, 0) > 0"""),
    "targets": (("nfaggregates",), "SELECT DISTINCT location, dst_addr FROM nfaggregates"),
    "rates": (("attackers",), "SELECT src_net, 4444 * 3600.0 / 800 / (SELECT sum(weight) FROM attackers) * weight AS rate FROM attackers"),
    "attack": (("rates", "targets"), "SELECT location, dst_addr, src_net, CAST(rate AS DOUBLE) / (SELECT count(*) FROM targets u WHERE u.dst_addr = t.dst_addr) AS attack FROM rates CROSS JOIN targets t"),
    "axis": (("nfaggregates",), "SELECT CAST((max(time) - min(time)) // 3600 + 1 AS BIGINT) AS hours FROM nfaggregates"),
    "cfg": ((), """SELECT tr AS train_length, te AS test_length, ma AS min_active, mp AS min_pkts_avg, lp AS low_pass, CAST(al AS DOUBLE) AS above_limit
 FROM unnest([8, 24]) a(tr), unnest([8, 24, 72]) b(te), unnest([1, 4]) c(ma), unnest([4, 64]) d(mp), unnest([128, 512]) e(lp), unnest([1, 2]) f(al)"""),
}
# the attack meets every start here, where Spark counts attackers without benign traffic once
_SQL["cells"] = (("stats", "attack", "axis", "cfg"), """SELECT tr AS train_length, te AS test_length, location, dst_addr, s AS window_start, src_net, max(attack) AS attack, max(train) AS train, max(active) AS active, max(test) AS test FROM (
 SELECT tr, te, location, dst_addr, s, src_net, attack, NULL AS train, NULL AS active, NULL AS test FROM attack, (SELECT DISTINCT train_length AS tr, test_length AS te FROM cfg), axis, unnest(range(1, hours - tr - te + 2)) u(s)
 UNION ALL SELECT tr, te, location, dst_addr, time_start, src_net, NULL, average, active, NULL FROM stats JOIN (SELECT DISTINCT train_length AS tr, test_length AS te FROM cfg) ON train_window = tr
 UNION ALL SELECT tr, te, location, dst_addr, time_start - tr, src_net, NULL, NULL, NULL, average FROM stats JOIN (SELECT DISTINCT train_length AS tr, test_length AS te FROM cfg) ON train_window = te
 ), axis WHERE s >= 1 AND s <= hours - tr - te + 1 GROUP BY ALL""")
_SQL["scored"] = (("cells", "cfg"), """SELECT location, dst_addr, window_start, train_length, test_length, min_active, min_pkts_avg, low_pass, above_limit,
 sum(a - fn) AS tp, sum(tn) AS tn, sum(b - tn) AS fp, sum(fn) AS fn, sum(a + b) AS total FROM (
 SELECT *, least(b, lim * (1 - a / (a + b))) AS tn, least(a, lim * (a / (a + b))) AS fn FROM (
 SELECT c.*, g.min_active, g.min_pkts_avg, g.low_pass, g.above_limit, coalesce(attack, 0.0) AS a, coalesce(test * 10, 0.0) AS b,
 CASE WHEN active >= g.min_active AND train >= g.min_pkts_avg THEN train * 10 * g.above_limit ELSE CAST(g.low_pass AS DOUBLE) END AS lim
 FROM cells c JOIN cfg g USING (train_length, test_length) WHERE attack IS NOT NULL OR test IS NOT NULL)) GROUP BY ALL""")
_SQL["scored_evading"] = (("cells", "cfg", "attackers"), """SELECT location, dst_addr, window_start, train_length, test_length, min_active, min_pkts_avg, low_pass, above_limit,
 sum(a - fn) AS tp, sum(tn) AS tn, sum(b - tn) AS fp, sum(fn) AS fn FROM (
 SELECT *, least(b, lim * (1 - a / (a + b))) AS tn, least(a, lim * (a / (a + b))) AS fn FROM (SELECT c.*, g.min_active, g.min_pkts_avg, g.low_pass, g.above_limit, coalesce(attack, 0.0) AS a, coalesce(test * 10, 0.0) AS b,
 CASE WHEN active >= g.min_active AND train >= g.min_pkts_avg THEN CASE WHEN evading THEN largest ELSE train END * 10 * g.above_limit ELSE CAST(g.low_pass AS DOUBLE) END AS lim
 FROM (SELECT *, max(train) OVER (PARTITION BY location, dst_addr, window_start, train_length, test_length) AS largest, src_net IN (SELECT src_net FROM attackers WHERE (src_net // 256) % 4 = 0) AS evading FROM cells) c
 JOIN cfg g USING (train_length, test_length) WHERE train_length = 24 AND (attack IS NOT NULL OR test IS NOT NULL))) GROUP BY ALL""")
_SQL["evaded"] = (("results", "scored_evading", "attackers"), """SELECT CAST(0 AS BIGINT) AS evasion_ips, location, dst_addr, attack_bandwidth, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit, window_start, fpr, attack_traffic FROM results WHERE train_length = 24
 UNION ALL SELECT (SELECT count(*) FROM attackers WHERE (src_net // 256) % 4 = 0), location, dst_addr, 4444, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit, window_start, round(fp / nullif(fp + tn, 0), 9), fn FROM scored_evading""")
_SQL["results"] = (("scored",), """SELECT location, dst_addr, 4444 AS attack_bandwidth, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit, window_start,
 round(fp / nullif(fp + tn, 0), 9) AS fpr, fn AS attack_traffic FROM scored""")


def sql(body: str, *names: str) -> str:
    """body with the common table expressions named, and those they need, before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _SQL[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    before = ",\n".join(f"{n} AS MATERIALIZED ({_SQL[n][1]})" for n in order)
    if not before:
        return body
    return f"WITH {before}" + (",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body)
