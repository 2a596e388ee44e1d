"""One query for each operator, and the SQL that gives the same rows.

Both sides name every column alike, give whole numbers as BIGINT, and round doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, net
from ..operators import attack, evaluate, ingest, prototype, reports, select, series, windows
from . import fixture as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, *names: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.sql(sql, *names)
        return f

    return register


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return _longs(df).select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


PROTOTYPE = prototype.Configuration(param_w_train=72, param_steady=3, param_heavy=64)

#: Buckets as the one-shot allowlist counts them: flows within one hour at once, others packet by packet in doubles.
_BUCKETS = """buckets AS (SELECT CAST((src_addr // 256) * 256 AS BIGINT) AS src_net, time, CAST(sum(n) AS BIGINT) AS packets FROM (
 SELECT src_addr, first_us // 1000000 - (first_us // 1000000) % 3600 AS time, in_packets AS n FROM flows WHERE dst_port = 53 AND (in_packets = 1 OR first_us // 3600000000 = last_us // 3600000000)
 UNION ALL SELECT src_addr, CAST(floor(t - (t - floor(t / 3600) * 3600)) AS BIGINT), 1 FROM (
 SELECT src_addr, first_us / 1e6 + i * ((last_us / 1e6 - first_us / 1e6) / (in_packets - 1)) AS t FROM flows, unnest(range(0, in_packets)) u(i)
 WHERE dst_port = 53 AND in_packets > 1 AND first_us // 3600000000 <> last_us // 3600000000)) GROUP BY ALL)"""
_FORMAT = "concat_ws('.', (src_net >> 24) & 255, (src_net >> 16) & 255, (src_net >> 8) & 255, src_net & 255)"


@_query(f"""SELECT {_FORMAT} AS ip, packets FROM (WITH {_BUCKETS} SELECT src_net, max(packets) AS packets FROM buckets
 WHERE time >= {fx.NOW} - 72 * 3600 AND time < {fx.NOW} GROUP BY 1 HAVING count(*) >= 3 AND max(packets) >= 64)""", "flows")
def proto_allowlist(spark, sf_dir):
    return prototype.one_shot_allowlist(fx.flows(spark, sf_dir), PROTOTYPE, fx.NOW)


@_query(f"WITH {_BUCKETS} SELECT * FROM buckets", "flows")
def proto_buckets(spark, sf_dir):
    return ingest.source_buckets(ingest.dns_flows(fx.flows(spark, sf_dir), None, None))


@_query("SELECT flow_id, CAST(proto AS BIGINT) AS proto, src_addr, in_packets FROM flows WHERE dst_port = 53 AND proto IN (6, 17) AND dst_addr BETWEEN 3325256704 AND 3325256705", "flows")
def flow_filter(spark, sf_dir):
    kept = ingest.dns_flows(fx.flows(spark, sf_dir), net.networks(["198.51.100.0/31", "2001:db8::/32"]))
    return _longs(kept.select("flow_id", "proto", "src_addr", "in_packets"))


@_query("SELECT flow_id, i, time_ns, bytes FROM packets", "packets")
def packet_split(spark, sf_dir):
    return ingest.packets(ingest.valid_flows(fx.dns(spark, sf_dir))).select("flow_id", "i", "time_ns", "bytes")


@_query("SELECT flow_id, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(max(bytes) AS BIGINT) AS first_bytes, CAST(count(*) AS BIGINT) AS n FROM packets GROUP BY 1", "packets")
def packet_bytes(spark, sf_dir):
    return ingest.packets(fx.dns(spark, sf_dir)).groupBy("flow_id").agg(F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("first_bytes"), F.count("*").alias("n"))


@_query("SELECT location, src_net, dst_addr, CAST(proto AS BIGINT) AS proto, time, total_packets FROM nfaggregates", "nfaggregates")
def hourly_agg(spark, sf_dir):
    return _longs(fx.aggregates(spark, sf_dir))


@_query("""SELECT location, CAST((src_addr // 65536) * 65536 AS BIGINT) AS src_net, dst_addr, CAST(proto AS BIGINT) AS proto, CAST((time_ns // 1000000000) - (time_ns // 1000000000) % 300 AS BIGINT) AS time,
 CAST(count(*) AS BIGINT) AS total_packets FROM packets WHERE time_ns // 300000000000 * 300 >= 1704672000 AND time_ns // 300000000000 * 300 < 1705276800 GROUP BY ALL""", "packets")
def agg_time_range(spark, sf_dir):
    return _longs(ingest.aggregates(fx.dns(spark, sf_dir), 300, 16, 1704672000, 1705276800))


@_query("SELECT location, src_net, dst_addr, CAST(proto AS BIGINT) AS proto, time, CAST(2 * total_packets AS BIGINT) AS total_packets FROM nfaggregates", "nfaggregates")
def agg_merge(spark, sf_dir):
    once = fx.aggregates(spark, sf_dir)
    return _longs(ingest.merge(once, once))


@_query("""SELECT src_addr, src_addr & 4278190080 AS net8, src_addr & 4294967040 AS net24, CAST(0 AS BIGINT) AS net0, concat_ws('.', src_addr >> 24, (src_addr >> 16) & 255, (src_addr >> 8) & 255, src_addr & 255) AS ip,
 concat_ws('.', src_addr >> 24, (src_addr >> 16) & 255, (src_addr >> 8) & 255, '0/24') AS cidr FROM (SELECT DISTINCT src_addr FROM flows)""", "flows")
def prefix_mask_v4(spark, sf_dir):
    a = F.col("src_addr")
    masked = fx.flows(spark, sf_dir).select("src_addr").distinct()
    return masked.select("src_addr", net.mask_v4(a, 8).alias("net8"), net.mask_v4(a, 24).alias("net24"), net.mask_v4(a, 0).alias("net0"), net.format_v4(net.parse_v4(net.format_v4(a))).alias("ip"), net.cidr_v4(net.mask_v4(a, 24), 24).alias("cidr"))


def _v6(k: str, rest: str = "") -> str:
    """The text of 2001:db8:k::rest in SQL."""
    return f"CASE WHEN {k} = 0 THEN '2001:db8::' ELSE '2001:db8:' || format('{{:x}}', CAST({k} AS BIGINT)) || '::' END" + (f" || format('{{:x}}', CAST({rest} AS BIGINT))" if rest else "")


_K, _DST6 = "((src_addr // 256) % 256)", "CASE WHEN dst_addr = 3325256705 THEN '2001:db8:ffff::53' ELSE '2001:db8:ffff::c633:6402' END"


@_query(f"SELECT {_v6(_K, 'src_addr % 256 + 1')} AS ip, {_v6(_K)} AS net48, {_v6(f'{_K} - {_K} % 4')} AS net46, '2001:db8::' AS net32, '::' AS net0, '20010DB8' || printf('%04X', CAST({_K} AS BIGINT)) || '00000000000000000000' AS hex48 FROM (SELECT DISTINCT src_addr FROM flows)", "flows")
def prefix_mask_v6(spark, sf_dir):
    a = fx.flows_v6(spark, sf_dir).select("src_addr").distinct()
    shown = lambda p: net.format_v6(net.mask_v6("src_addr", p)).alias(f"net{p}")
    return a.select(net.format_v6(net.parse_v6(net.format_v6("src_addr"))).alias("ip"), shown(48), shown(46), shown(32), shown(0), F.hex(net.mask_v6("src_addr", 48)).alias("hex48"))


@_query(f"SELECT location, {_v6('((src_net // 256) % 256)')} AS src_net, {_DST6} AS dst_addr, CAST(proto AS BIGINT) AS proto, time, total_packets FROM nfaggregates", "nfaggregates")
def hourly_agg_v6(spark, sf_dir):
    found = ingest.aggregates(ingest.dns_flows(fx.flows_v6(spark, sf_dir)))
    return _longs(found.select("location", net.text_of(found, "src_net").alias("src_net"), net.text_of(found, "dst_addr").alias("dst_addr"), "proto", "time", "total_packets"))


@_query("SELECT flow_id, CAST(proto AS BIGINT) AS proto, in_packets FROM flows WHERE dst_port = 53 AND proto IN (6, 17) AND dst_addr = 3325256705", "flows")
def flow_filter_v6(spark, sf_dir):
    kept = ingest.dns_flows(fx.flows_v6(spark, sf_dir), net.networks(["198.51.100.0/24", "2001:db8:ffff::/121"]))
    return _longs(kept.select("flow_id", "proto", "in_packets"))


@_query(f"""SELECT {_v6('((src_net // 256) % 256)')} AS ip, packets FROM (WITH {_BUCKETS} SELECT src_net, max(packets) AS packets FROM buckets
 WHERE time >= {fx.NOW} - 72 * 3600 AND time < {fx.NOW} GROUP BY 1 HAVING count(*) >= 3 AND max(packets) >= 64)""", "flows")
def proto_allowlist_v6(spark, sf_dir):
    return prototype.one_shot_allowlist(fx.flows_v6(spark, sf_dir), PROTOTYPE, fx.NOW)


@_query("""SELECT flags, CAST(list_sum(list_transform(range(1, 9), lambda k: CASE WHEN substr(flags, CAST(k AS INTEGER), 1) = '.' THEN 0 ELSE CAST(pow(2, 8 - k) AS BIGINT) END)) AS BIGINT) AS mask
 FROM (SELECT DISTINCT array_to_string(list_transform(range(0, 8), lambda k: CASE WHEN (event_id >> CAST(7 - k AS BIGINT)) % 2 = 1 THEN substr('CEUAPRSF', CAST(k + 1 AS INTEGER), 1) ELSE '.' END), '') AS flags FROM events)""")
def tcp_flags(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shown = F.concat(*(F.when(F.shiftright("event_id", 7 - k) % 2 == 1, F.lit("CEUAPRSF"[k])).otherwise(F.lit(".")) for k in range(8)))
    return _longs(e.select(shown.alias("flags")).distinct().select("flags", net.tcp_flags(F.col("flags")).alias("mask")))


@_query("SELECT location, src_net, dst_addr, CAST(i AS BIGINT) AS i, CAST(packets AS BIGINT) AS packets FROM dense", "dense")
def dense_series_long(spark, sf_dir):
    return _longs(series.long_series(fx.dense(spark, sf_dir)))


@_query("""SELECT location, src_net, dst_addr, CAST(sum(packets) AS BIGINT) AS total, CAST(max(packets) AS BIGINT) AS peak, CAST(count(*) FILTER (packets > 0) AS BIGINT) AS active
 FROM dense WHERE i BETWEEN 100 AND 171 GROUP BY ALL""", "dense")
def series_stats(spark, sf_dir):
    return _longs(series.slice_stats(fx.dense(spark, sf_dir), 100, 72))


@_query("SELECT location, src_net, dst_addr, CAST(time_start AS BIGINT) AS time_start, CAST(train_window AS BIGINT) AS train_window, total, active, round(average, 6) AS average FROM stats", "stats")
def window_stats(spark, sf_dir):
    return _rounded(fx.stats(spark, sf_dir))


_PAIRS = f"unnest({list(windows.ACTIVE_MINIMA)}) a(active_min), unnest({list(windows.PACKET_MINIMA)}) p(pkts_min)"


@_query(f"""SELECT location, dst_addr, CAST(time_start AS BIGINT) AS time_start, CAST(train_window AS BIGINT) AS train_window, CAST(active_min AS BIGINT) AS active_min, CAST(pkts_min AS BIGINT) AS pkts_min,
 string_agg(CAST(src_net AS VARCHAR), ',' ORDER BY src_net) AS srcs FROM stats, {_PAIRS} WHERE active >= active_min AND average >= pkts_min GROUP BY ALL""", "stats")
def allowlist_grid(spark, sf_dir):
    found = windows.allowlists(fx.stats(spark, sf_dir))
    return _longs(found.withColumn("srcs", F.array_join(F.transform("srcs", lambda x: x.cast("string")), ",")))


@_query("""SELECT location, dst_addr, CAST(time_start AS BIGINT) AS time_start, CAST(train_window AS BIGINT) AS train_window, string_agg(CAST(src_net AS VARCHAR), ',' ORDER BY src_net) AS iprange_srcs,
 string_agg(CAST(CAST(round(average * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY src_net) AS pkts_avgs FROM stats GROUP BY ALL""", "stats")
def traffic_interval(spark, sf_dir):
    t = windows.traffic_intervals(fx.stats(spark, sf_dir))
    join = lambda c, f: F.array_join(F.transform(c, lambda x: f(x).cast("string")), ",").alias(c)
    return _longs(t.select("location", "dst_addr", "time_start", "train_window", join("iprange_srcs", lambda x: x), join("pkts_avgs", lambda x: F.round(x * 1000).cast("long"))))


@_query("""SELECT w.location, w.dst_addr, CAST(w.time_start AS BIGINT) AS time_start, CAST(w.train_window AS BIGINT) AS train_window, count(s.src_net) AS n_sources, CAST(coalesce(max(m.n), 0) AS BIGINT) AS n_listed
 FROM (SELECT location, dst_addr, s AS time_start, t AS train_window FROM targets, axis, unnest([8, 24]) u(t), unnest(range(1, hours - t + 2)) v(s)) w
 LEFT JOIN stats s ON s.location = w.location AND s.dst_addr = w.dst_addr AND s.time_start = w.time_start AND s.train_window = w.train_window
 LEFT JOIN (SELECT location, dst_addr, time_start, train_window, count(*) AS n FROM stats WHERE active >= 4 AND average >= 64 GROUP BY ALL) m ON m.location = w.location AND m.dst_addr = w.dst_addr AND m.time_start = w.time_start AND m.train_window = w.train_window
 GROUP BY ALL""", "stats", "targets", "axis")
def window_lookups(spark, sf_dir):
    s, t = fx.stats(spark, sf_dir, (8, 24)), fx.hours(spark, sf_dir)
    wanted = fx.targets(spark, sf_dir).withColumn("train_window", F.explode(F.array(F.lit(8), F.lit(24)))).withColumn("time_start", F.explode(F.sequence(F.lit(1), F.lit(t) - F.col("train_window") + 1)))
    both = windows.lookup_intervals(wanted, windows.traffic_intervals(s), "empty").select(*windows.GROUP, "iprange_srcs", F.lit(4).alias("active_min"), F.lit(64).alias("pkts_min"))
    found = windows.lookup_allowlists(both, windows.allowlists(s, (4,), (64,)))
    return _longs(found.select(*windows.GROUP, F.size("iprange_srcs").alias("n_sources"), F.size("srcs").alias("n_listed")))


@_query("SELECT location, src_net, max(total_packets) AS total_packets_max, CAST(sum(total_packets) AS BIGINT) AS total_packets_sum, count(DISTINCT time) AS active_hours FROM nfaggregates WHERE time BETWEEN 1704067200 AND 1706659200 GROUP BY ALL", "nfaggregates")
def peak_rate(spark, sf_dir):
    return reports.peak_rates(fx.aggregates(spark, sf_dir), 1704067200, 1706659200)


@_query("SELECT CAST((src_addr // 256) * 256 AS BIGINT) AS src_net, count(DISTINCT src_addr) AS n_sources FROM flows WHERE proto IN (6, 17) AND week(make_timestamp(first_us)) BETWEEN 2 AND 4 GROUP BY 1", "flows")
def net_distinct(spark, sf_dir):
    f = fx.flows(spark, sf_dir).where(F.col("proto").isin(6, 17) & F.weekofyear(F.timestamp_micros("first_us")).between(2, 4))
    return reports.sources_by_network(f)


@_query("SELECT DISTINCT location, dst_addr FROM nfaggregates", "nfaggregates")
def logical_destinations(spark, sf_dir):
    return fx.targets(spark, sf_dir)


@_query("SELECT src_net, round(CAST(40 AS DOUBLE) * 1073741824 * 3600 / 800 / (SELECT sum(weight) FROM attackers) * weight, 1) AS rate FROM attackers", "attackers")
def attack_rate(spark, sf_dir):
    return _rounded(attack.attack_rates(fx.attackers(spark, sf_dir), 40 * 2**30), 1)


@_query("""SELECT n.src_net, CAST(max(c.entry) AS BIGINT) AS entry FROM (SELECT DISTINCT CAST((src_addr // 256) * 256 AS BIGINT) AS src_net FROM flows UNION SELECT src_net FROM attackers) n
 LEFT JOIN catchment c ON c."start" = n.src_net OR (c."start" < n.src_net AND c."end" >= n.src_net + 255) GROUP BY 1""", "flows", "attackers", "catchment")
def catchment_range_join(spark, sf_dir):
    nets = fx.flows(spark, sf_dir).select(net.mask_v4(F.col("src_addr"), 24).alias("src_net")).union(fx.attackers(spark, sf_dir).select("src_net")).distinct()
    return _longs(attack.catchment_matches(nets, fx.catchment(spark, sf_dir).select("entry", "start", "end").distinct()))


@_query("""SELECT location, dst_addr, src_net, round(attack, 6) AS attack FROM (SELECT t.location, t.dst_addr, r.src_net,
 CASE WHEN (SELECT count(*) FROM catchment c WHERE c.dst_addr = t.dst_addr AND (c."start" = r.src_net OR (c."start" < r.src_net AND c."end" >= r.src_net + 255))) = 0
 THEN r.rate / (SELECT count(*) FROM targets u WHERE u.dst_addr = t.dst_addr)
 ELSE r.rate * (SELECT max(c.factor) FROM catchment c WHERE c.dst_addr = t.dst_addr AND c.location = t.location AND (c."start" = r.src_net OR (c."start" < r.src_net AND c."end" >= r.src_net + 255))) END AS attack
 FROM (SELECT src_net, CAST(rate AS DOUBLE) AS rate FROM rates) r CROSS JOIN targets t) WHERE attack IS NOT NULL""", "rates", "targets", "catchment")
def catchment_scaled(spark, sf_dir):
    rates = attack.attack_rates(fx.attackers(spark, sf_dir), fx.BANDWIDTH)
    return _rounded(attack.attack_by_location(rates, fx.targets(spark, sf_dir), fx.catchment(spark, sf_dir)))


@_query("""SELECT location, dst_addr, CAST(window_start AS BIGINT) AS window_start, src_net, round(attack, 6) AS attack, round(train, 6) AS train, round(test, 6) AS test, coalesce(active >= 4 AND train >= 64, false) AS listed
 FROM cells WHERE train_length = 24 AND test_length = 24""", "cells")
def merge_join(spark, sf_dir):
    return _rounded(_merged(spark, sf_dir))


def _merged(spark, sf_dir) -> DataFrame:
    s, t = fx.stats(spark, sf_dir, (24,)), fx.hours(spark, sf_dir)
    key, starts = ["location", "dst_addr", "window_start", "src_net"], t - 24 - 24 + 1
    train = s.select("location", "dst_addr", F.col("time_start").alias("window_start"), "src_net", F.col("average").alias("train"), "active").where(F.col("window_start") <= starts)
    test = s.select("location", "dst_addr", (F.col("time_start") - 24).alias("window_start"), "src_net", F.col("average").alias("test")).where(F.col("window_start").between(1, starts))
    hit = fx.attack_traffic(spark, sf_dir).withColumn("window_start", F.explode(F.sequence(F.lit(1), F.lit(starts))))
    return evaluate.merged(train.where("active >= 4 and train >= 64"), hit, train, test, key)


@_query("""SELECT location, dst_addr, CAST(window_start AS BIGINT) AS window_start, round(tp, 3) AS tp, round(tn, 3) AS tn, round(fp, 3) AS fp, round(fn, 3) AS fn, round(total, 3) AS total FROM scored
 WHERE train_length = 24 AND test_length = 24 AND min_active = 4 AND min_pkts_avg = 64 AND low_pass = 128 AND above_limit = 1""", "scored")
def evaluate_one(spark, sf_dir):
    """The evaluation by merge and conditional sums, for one configuration."""
    return _rounded(evaluate.score(_merged(spark, sf_dir), ["location", "dst_addr", "window_start"], 128, 1.0), 3)


@_query("""SELECT location, dst_addr, CAST(window_start AS BIGINT) AS window_start, CAST(test_length AS BIGINT) AS test_length, CAST(min_active AS BIGINT) AS min_active, CAST(min_pkts_avg AS BIGINT) AS min_pkts_avg, CAST(low_pass AS BIGINT) AS low_pass, above_limit,
 round(tp, 3) AS tp, round(tn, 3) AS tn, round(fp, 3) AS fp, round(fn, 3) AS fn FROM scored_evading""", "scored_evading")
def evaluate_evasion(spark, sf_dir):
    """Evading networks get the window's largest train traffic, at the best training length."""
    done = evaluate.best_train_only(_evading(spark, sf_dir)[0], {"aaa": 24})
    return _rounded(done.select("location", "dst_addr", "window_start", "test_length", "min_active", "min_pkts_avg", "low_pass", "above_limit", "tp", "tn", "fp", "fn"), 3)


def _evading(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The evaluation under evasion, and one row with the number of evading networks."""
    evading = fx.attackers(spark, sf_dir).where(F.shiftright("src_net", 8) % 4 == 0)
    return fx.evaluation(spark, sf_dir, **{**fx.GRID, "train_lengths": (24,), "evasion": evading}), evading.agg(F.count("*").alias("evasion_ips"))


_CONFIG = "location, dst_addr, CAST(window_start AS BIGINT) AS window_start, CAST(train_length AS BIGINT) AS train_length, CAST(test_length AS BIGINT) AS test_length, CAST(min_active AS BIGINT) AS min_active, CAST(min_pkts_avg AS BIGINT) AS min_pkts_avg, CAST(low_pass AS BIGINT) AS low_pass, above_limit"


@_query(f"SELECT {_CONFIG}, round(tp, 3) AS tp, round(tn, 3) AS tn, round(fp, 3) AS fp, round(fn, 3) AS fn, round(total, 3) AS total FROM scored", "scored")
def evaluate_grid(spark, sf_dir):
    return _rounded(fx.evaluation(spark, sf_dir), 3)


@_query(f"""SELECT {_CONFIG}, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(5 * tp / nullif(5 * tp + 4 * fp + fn, 0), 6) AS f2,
 round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(tp / nullif(total, 0), 6) AS tp_share FROM scored""", "scored")
def metric_columns(spark, sf_dir):
    r = fx.evaluation(spark, sf_dir)
    keys = [c for c in r.columns if c not in ("tp", "tn", "fp", "fn", "total")]
    with_all = r.select("*", metrics.fpr().alias("fpr"), metrics.fnr().alias("fnr"), metrics.f_beta().alias("f1"), metrics.f_beta(2).alias("f2"), metrics.balanced_accuracy().alias("balanced"))
    return _rounded(metrics.normalised(with_all).select(*keys, "fpr", "fnr", "f1", "f2", "balanced", F.col("tp").alias("tp_share")))


@_query("SELECT CAST(count(*) AS BIGINT) AS n_results, CAST(count(*) FILTER (abs(tp + tn + fp + fn - total) >= 2 AND abs((tp + tn + fp + fn) / total - 1) >= 1e-9) AS BIGINT) AS n_wrong FROM scored", "scored")
def conservation(spark, sf_dir):
    r = fx.evaluation(spark, sf_dir)
    wrong = evaluate.conservation(r).agg(F.count("*").alias("n_wrong"))
    return r.agg(F.count("*").alias("n_results")).join(wrong, F.lit(True))  # one row each


def _results(spark, sf_dir) -> DataFrame:
    return _rated(fx.evaluation(spark, sf_dir))


def _rated(r: DataFrame) -> DataFrame:
    return r.select("location", "dst_addr", F.lit(fx.BANDWIDTH).alias("attack_bandwidth"), "test_length", "low_pass", *select.PARAMS, "window_start", F.round(metrics.fpr(), 9).alias("fpr"), F.col("fn").alias("attack_traffic"))


_SERIES = "location, dst_addr, CAST(attack_bandwidth AS BIGINT) AS attack_bandwidth, CAST(test_length AS BIGINT) AS test_length, CAST(low_pass AS BIGINT) AS low_pass"
_STRIDE = """means AS (SELECT location, dst_addr, attack_bandwidth, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit, CASE WHEN count(fpr) = count(*) THEN avg(fpr) END AS f, avg(attack_traffic) AS t FROM (
 SELECT *, row_number() OVER (PARTITION BY location, dst_addr, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit ORDER BY window_start) - 1 AS nth FROM results WHERE (window_start - 1) % test_length = 0)
 WHERE nth = (window_start - 1) // test_length GROUP BY ALL)"""
_BEST = f"""SELECT location, dst_addr, attack_bandwidth, test_length, low_pass, f AS avg_fpr, CASE WHEN f IS NOT NULL THEN t END AS avg_attack_traffic, CASE WHEN f IS NOT NULL THEN train_length END AS train_length, CASE WHEN f IS NOT NULL THEN min_active END AS min_active,
 CASE WHEN f IS NOT NULL THEN min_pkts_avg END AS min_pkts_avg, CASE WHEN f IS NOT NULL THEN above_limit END AS above_limit FROM (SELECT *, row_number() OVER (PARTITION BY location, dst_addr, test_length, low_pass ORDER BY round(f, 9) NULLS LAST, train_length, min_active, min_pkts_avg, above_limit) AS k FROM means) WHERE k = 1"""


@_query(f"""WITH {_STRIDE} SELECT {_SERIES}, round(avg_fpr, 6) AS avg_fpr, round(avg_attack_traffic, 3) AS avg_attack_traffic, CAST(train_length AS BIGINT) AS train_length, CAST(min_active AS BIGINT) AS min_active, CAST(min_pkts_avg AS BIGINT) AS min_pkts_avg, above_limit FROM ({_BEST})""", "results")
def global_opt(spark, sf_dir):
    best = select.global_optimum(_results(spark, sf_dir))
    return _rounded(best.withColumn("avg_attack_traffic", F.round("avg_attack_traffic", 3)))


@_query(f"""WITH chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location, dst_addr, test_length, low_pass, window_start ORDER BY fpr NULLS LAST, train_length DESC, min_active DESC, min_pkts_avg DESC, above_limit DESC) AS k
 FROM results WHERE (window_start - 1) % test_length = 0) WHERE k = 1)
 SELECT {_SERIES}, round(f, 6) AS avg_fpr, round(t, 3) AS avg_attack_traffic FROM (SELECT r.location, r.dst_addr, r.attack_bandwidth, r.test_length, r.low_pass, CASE WHEN count(r.fpr) = count(*) THEN avg(r.fpr) END AS f, avg(r.attack_traffic) AS t
 FROM results r JOIN chosen c ON r.location = c.location AND r.dst_addr = c.dst_addr AND r.test_length = c.test_length AND r.low_pass = c.low_pass AND r.train_length = c.train_length AND r.min_active = c.min_active
 AND r.min_pkts_avg = c.min_pkts_avg AND r.above_limit = c.above_limit AND r.window_start = c.window_start + c.test_length GROUP BY ALL)""", "results")
def dfc(spark, sf_dir):
    out = select.day_forward(_results(spark, sf_dir))
    return _rounded(out.withColumn("avg_attack_traffic", F.round("avg_attack_traffic", 3)))


def _evasion_means(spark, sf_dir) -> DataFrame:
    """Means without evasion and with it, at the training length that evasion is evaluated at."""
    r, n = _evading(spark, sf_dir)
    plain = _rated(fx.evaluation(spark, sf_dir, **{**fx.GRID, "train_lengths": (24,)})).withColumn("evasion_ips", F.lit(0).cast("long"))
    return select.evasion_means(plain.unionByName(_rated(r).crossJoin(F.broadcast(n))))  # the number is one row


_MEANS = f"""SELECT evasion_ips, {_SERIES}, CAST(train_length AS BIGINT) AS train_length, CAST(min_active AS BIGINT) AS min_active, CAST(min_pkts_avg AS BIGINT) AS min_pkts_avg, above_limit,
 round(CASE WHEN count(fpr) = count(*) THEN avg(fpr) END, 6) AS fpr, round(avg(attack_traffic), 3) AS attack_traffic FROM evaded GROUP BY ALL"""


@_query(_MEANS, "evaded")
def evasion_means(spark, sf_dir):
    return _rounded(_evasion_means(spark, sf_dir).withColumn("attack_traffic", F.round("attack_traffic", 3)))


@_query(f"""WITH means AS ({_MEANS}) SELECT location, evasion_ips, fpr, round(attack_traffic / 3600, 6) AS attack_per_second FROM (SELECT *, row_number() OVER (PARTITION BY location, evasion_ips ORDER BY dst_addr DESC, test_length DESC, low_pass DESC, min_active DESC, min_pkts_avg DESC, above_limit DESC) AS k FROM means) WHERE k = 1""", "evaded")
def evasion_lookup(spark, sf_dir):
    """By location and number of evading networks; of several configurations the last in order."""
    means = _evasion_means(spark, sf_dir).withColumns({"fpr": F.round("fpr", 6), "attack_traffic": F.round("attack_traffic", 3)})
    return _rounded(select.evasion_lookup(means, F.struct("dst_addr", "test_length", "low_pass", "min_active", "min_pkts_avg", "above_limit")))


def _median(value: str) -> str:
    """The weighted median of a few values as SQL: where no datum weighs more than half, the first past half of the weight."""
    rows = f"list_sort(list({{'v': {value}, 'w': w}}) FILTER ({value} IS NOT NULL))"
    upto = f"list_transform(range(1, len({rows}) + 1), lambda i: list_sum(list_transform(({rows})[1:i], lambda x: x.w)))"
    heavy = f"list_filter({rows}, lambda x: x.w > list_sum(list_transform({rows}, lambda y: y.w)) / 2)"
    at = f"list_position(list_transform({upto}, lambda u: u > ({upto})[-1] / 2), true)"
    return f"round(CASE WHEN len({heavy}) > 0 THEN ({heavy})[1].v WHEN {at} > 1 AND ({upto})[{at} - 1] = ({upto})[-1] / 2 THEN (({rows})[{at}].v + ({rows})[{at} - 1].v) / 2 ELSE ({rows})[{at}].v END, 6)"


@_query(f"""WITH {_STRIDE} SELECT CAST(test_length AS BIGINT) AS test_length, CAST(low_pass AS BIGINT) AS low_pass, round(min(avg_fpr), 6) AS min_fpr, round(avg(avg_fpr), 6) AS avg_fpr, round(median(avg_fpr), 6) AS med_fpr, round(max(avg_fpr), 6) AS max_fpr,
 round(min(avg_attack_traffic / 3600), 6) AS min_traffic, round(avg(avg_attack_traffic / 3600), 6) AS avg_traffic, round(median(avg_attack_traffic / 3600), 6) AS med_traffic, round(max(avg_attack_traffic / 3600), 6) AS max_traffic,
 round(sum(avg_fpr * w) / sum(w) FILTER (avg_fpr IS NOT NULL), 6) AS avgw_fpr, round(sum(avg_attack_traffic / 3600 * w) / sum(w) FILTER (avg_attack_traffic IS NOT NULL), 6) AS avgw_traffic, {_median("avg_fpr")} AS medw_fpr, {_median("avg_attack_traffic / 3600")} AS medw_traffic
 FROM (SELECT *, CASE WHEN location = 'aaa' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM ({_BEST})) GROUP BY 1, 2""", "results")
def summary_table(spark, sf_dir):
    weight = F.when(F.col("location") == "aaa", 3.0).otherwise(2.0)
    return _rounded(reports.summary(select.global_optimum(_results(spark, sf_dir)).withColumn("weight", weight)))


@_query("""WITH r AS (SELECT o_orderpriority AS k, o_totalprice AS v, CAST(o_custkey % 5 AS DOUBLE) AS w FROM orders), c AS (SELECT k, v, w, sum(w) OVER (PARTITION BY k ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS u, lag(v) OVER (PARTITION BY k ORDER BY v, w) AS before, sum(w) OVER (PARTITION BY k) / 2 AS half FROM r)
 SELECT k AS priority, round(min_by(CASE WHEN u - w = half THEN (before + v) / 2 ELSE v END, u), 6) AS weighted_median FROM c WHERE u > half GROUP BY 1""")
def weighted_median(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("v"), (F.col("o_custkey") % 5).cast("double").alias("w"))
    return _rounded(reports.weighted_median(o, ["priority"], "v", "w"))


_PEAKS = "peaks AS (SELECT location, src_net, max(total_packets) * 10.0 AS pkts_max, sum(total_packets) * 10.0 AS pkts_sum, count(DISTINCT time) AS active_hours FROM nfaggregates GROUP BY ALL)"


@_query(f"""WITH {_PEAKS}, span AS (SELECT location, min(active_hours) AS lo, max(active_hours) AS hi FROM peaks GROUP BY 1)
 SELECT location, CAST(CASE WHEN lo = hi THEN 20 ELSE least(floor(CAST(active_hours - lo AS DOUBLE) / (hi - lo) * 40), 39) END AS BIGINT) AS x_bin, CAST(least(len(list_filter([10, 32, 100, 320, 1000, 3200, 10000, 32000, 100000], lambda e: e <= pkts_max)) - 1, 7) AS BIGINT) AS y_bin, count(*) AS n
 FROM peaks JOIN span USING (location) WHERE pkts_max BETWEEN 10 AND 100000 GROUP BY ALL""", "nfaggregates")
def hist2d_log(spark, sf_dir):
    rates = reports.hourly_rates(reports.peak_rates(fx.aggregates(spark, sf_dir)))
    return _longs(reports.rate_histogram(rates, "pkts_max", 40, [10, 32, 100, 320, 1000, 3200, 10000, 32000, 100000]))


@_query(f"""WITH {_PEAKS}, pairs AS (SELECT location, m AS min_hours, pkts_max, pkts_sum, sum(pkts_sum) AS step FROM peaks, unnest(range(0, 649, 50)) u(m) WHERE active_hours >= m GROUP BY ALL),
 run AS (SELECT *, sum(step) OVER (PARTITION BY location, min_hours ORDER BY pkts_max DESC, pkts_sum DESC ROWS UNBOUNDED PRECEDING) AS carried FROM pairs)
 SELECT location, min_hours, threshold, max(pkts_max) AS border FROM run, unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.95::DOUBLE]) t(threshold) WHERE carried >= threshold * (SELECT sum(pkts_sum) FROM peaks p WHERE p.location = run.location) GROUP BY ALL""".replace("SELECT location, min_hours, threshold, max(pkts_max) AS border", "SELECT location, CAST(min_hours AS BIGINT) AS min_hours, threshold, CAST(max(pkts_max) AS DOUBLE) AS border"), "nfaggregates")
def border(spark, sf_dir):
    rates = reports.hourly_rates(reports.peak_rates(fx.aggregates(spark, sf_dir)))
    return _longs(reports.borders(rates, "pkts_max", [0.5, 0.8, 0.95], list(range(0, 649, 50))))


def _churn(spark, sf_dir) -> DataFrame:
    """Results against those at the first window, the inferred meaning of the published difference files."""
    r = _results(spark, sf_dir)
    keys = [*select.SERIES, *select.PARAMS]
    first = Window.partitionBy(*keys).orderBy("window_start")
    return reports.churn(r.withColumn("fixed_fpr", F.first("fpr").over(first)).withColumn("fixed_attack_traffic", F.first("attack_traffic").over(first)))


_CHURN = """diffs AS (SELECT *, window_start - 1 AS idx, first(fpr) OVER w - fpr AS fpr_diff, first(attack_traffic) OVER w - attack_traffic AS attack_diff FROM results
 WINDOW w AS (PARTITION BY location, dst_addr, test_length, low_pass, train_length, min_active, min_pkts_avg, above_limit ORDER BY window_start))"""


@_query(f"WITH {_CHURN} SELECT {_SERIES}, CAST(train_length AS BIGINT) AS train_length, CAST(min_active AS BIGINT) AS min_active, CAST(min_pkts_avg AS BIGINT) AS min_pkts_avg, above_limit, CAST(idx AS BIGINT) AS idx, round(fpr_diff, 6) AS fpr_diff, round(attack_diff, 3) AS attack_diff FROM diffs WHERE low_pass = 128 AND train_length = 24", "results")
def churn_diff(spark, sf_dir):
    d = reports.matching(_churn(spark, sf_dir), {"low_pass": [128], "train_length": [24]})
    return _rounded(d.select(*select.SERIES, *select.PARAMS, "idx", "fpr_diff", F.round("attack_diff", 3).alias("attack_diff")))


@_query(f"""WITH {_CHURN} SELECT location, dst_addr, CAST(CASE WHEN idx <= 696 THEN least(idx // 4, 173) END AS BIGINT) AS x_bin,
 CAST(least(len(list_filter({reports.FPR_EDGES}, lambda e: CAST(e AS DOUBLE) <= d)) - 1, {len(reports.FPR_EDGES) - 2}) AS BIGINT) AS y_bin, count(*) AS n FROM (SELECT *, round(fpr_diff, 7) + 3e-8 AS d FROM diffs) WHERE d BETWEEN -1 AND 1 AND idx <= 696 GROUP BY ALL""", "results")
def hist2d_edges(spark, sf_dir):
    # moved off the edges by less than any difference that counts, so that rounding cannot change a bin
    d = _churn(spark, sf_dir).withColumn("fpr_diff", F.round("fpr_diff", 7) + 3e-8)
    return _longs(reports.difference_histogram(d, "fpr_diff", reports.FPR_EDGES))


@_query(f"""WITH {_CHURN} SELECT location, dst_addr, CAST(CASE WHEN idx <= 696 THEN least(idx // 4, 173) END AS BIGINT) AS x_bin,
 CAST(least(len(list_filter({reports.TRAFFIC_EDGES}, lambda e: CAST(e AS DOUBLE) <= d)) - 1, {len(reports.TRAFFIC_EDGES) - 2}) AS BIGINT) AS y_bin, count(*) AS n FROM (SELECT *, round(attack_diff, 3) + 3e-4 AS d FROM diffs) WHERE d BETWEEN -100000 AND 100000 AND idx <= 696 GROUP BY ALL""", "results")
def hist2d_traffic(spark, sf_dir):
    # moved off the edges, as in hist2d_edges
    d = _churn(spark, sf_dir).withColumn("attack_diff", F.round("attack_diff", 3) + 3e-4)
    return _longs(reports.difference_histogram(d, "attack_diff", reports.TRAFFIC_EDGES))
