"""Hand-computed cases, properties, and a plain-Python version of the one-shot allowlist."""

import ipaddress
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.functions import metrics, net
from sluice.operators import attack, evaluate, ingest, prototype, reports, select, series, windows

FLOW = "flow_id long, location string, src_addr long, dst_addr long, proto short, dst_port int, first_us long, last_us long, in_packets long, in_bytes long"


def flow(spark, *rows):
    return spark.createDataFrame([(k, "aaa", 167772161, 3325256705, 17, 53, *r) for k, r in enumerate(rows)], FLOW)


def test_masks_and_text(spark):
    row = spark.createDataFrame([("10.1.2.3",)], "ip string").select(*(net.format_v4(net.mask_v4(net.parse_v4(F.col("ip")), p)).alias(f"p{p}") for p in (32, 24, 8, 0))).first()
    assert tuple(row) == ("10.1.2.3", "10.1.2.0", "10.0.0.0", "0.0.0.0")
    bad = spark.createDataFrame([("10.1.2",), ("256.1.1.1",), ("a.b.c.d",), ("1.2.3.4.5",), (None,)], "ip string").select(net.parse_v4(F.col("ip")).alias("n")).collect()
    assert all(r.n is None for r in bad)
    with pytest.raises(ValueError):
        net.mask_v4(F.col("ip"), 33)


def test_both_families(spark):
    ips = ["9.0.0.1", "10.0.0.0", "2001:db8::1", "255.255.255.255", "::1"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = df.select("ip", net.family(F.col("ip")).alias("f"), net.parse_any("ip").alias("b")).orderBy("f", "b").collect()
    assert [r.ip for r in got] == ["9.0.0.1", "10.0.0.0", "255.255.255.255", "::1", "2001:db8::1"]
    masked = df.select(net.format_any(net.mask_any(24, 48)(net.parse_any("ip"))).alias("m")).collect()
    assert [r.m for r in masked] == ["9.0.0.0", "10.0.0.0", "2001:db8::", "255.255.255.0", "::"]


def test_six(spark):
    """Text, bytes, masks and networks of IPv6 against the standard library."""
    r = random.Random(1)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "2001:DB8::1", "1:2", "12345::", ":::", "1::2::3", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "::1.2.3.400", "g::", "", "1:0:0:2:0:0:0:3", "0:0:1::"]
    texts += [":".join(format(r.choice([0, 0, 0, r.randrange(1 << 16), 10, 256]), "x") for _ in range(8)) for _ in range(60)]
    prefixes = (0, 1, 46, 47, 48, 64, 127, 128)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", net.parse_v6("t"))
    nets = net.networks(["2001:db8::/33", "::/100", "10.0.0.0/8"])
    for x in df.select("t", "p", net.format_v6("p").alias("f"), net.in_networks(df, "p", nets).alias("inside"), *(net.mask_v6("p", k).alias(f"m{k}") for k in prefixes)).collect():
        try:
            want = ipaddress.IPv6Address(x.t)
        except ValueError:
            assert x.p is None and x.f is None
            continue
        assert bytes(x.p) == want.packed and (x.f == str(want) or want.ipv4_mapped)
        assert x.inside == any(want in n for n in nets[:2])
        for k in prefixes:
            assert int.from_bytes(bytes(x[f"m{k}"]), "big") == int(want) >> (128 - k) << (128 - k)
    with pytest.raises(ValueError):
        net.mask_v6("p", 129)


def test_flags(spark):
    flags = spark.createDataFrame([("...AP...",), ("........",), ("CEUAPRSF",)], "f string")
    assert [r.m for r in flags.select(net.tcp_flags(F.col("f")).alias("m")).collect()] == [24, 0, 255]
    with pytest.raises(Exception, match="eight flags"):
        spark.createDataFrame([(".......",)], "f string").select(net.tcp_flags(F.col("f"))).collect()


def test_networks(spark):
    nets = net.networks(["10.0.0.0/8", "2001:db8::/32"])
    with pytest.raises(ValueError):
        net.networks(["10.0.0.1/8"])
    rows = spark.createDataFrame([(int(ipaddress.ip_address(x)),) for x in ("10.255.255.255", "11.0.0.0")], "a long")
    assert [r.x for r in rows.select(net.in_networks_v4(F.col("a"), nets).alias("x")).collect()] == [True, False]


def test_packets_of_a_flow(spark):
    rows = ingest.packets(flow(spark, (0, 10_000_000, 5, 103))).orderBy("i").collect()
    assert [(r.time_ns / 1e9, r.bytes) for r in rows] == [(0, 23), (2.5, 20), (5, 20), (7.5, 20), (10, 20)]
    assert [r.time_ns for r in ingest.packets(flow(spark, (3_599_000_000, 3_700_000_000, 1, 10))).collect()] == [3_599_000_000_000]
    with pytest.raises(Exception, match="packets"):
        ingest.valid_flows(flow(spark, (0, 1, 0, 0))).collect()


def test_buckets_equal_packets(spark):
    r = random.Random(0)
    flows = flow(spark, *[(a := r.randrange(10**10), a + r.choice([0, r.randrange(10**5), r.randrange(3 * 10**10)]), r.choice([1, 2, 3, r.randrange(1, 200)]), 100) for _ in range(300)])
    for interval in (60, 3600):
        exploded = ingest.packets(flows).withColumn("time", ingest.bucket(F.expr("time_ns div 1000000000"), interval)).groupBy("flow_id", "time").agg(F.count("*").alias("n"))
        closed = ingest.bucket_packets(flows, interval).select("flow_id", "time", "n")
        assert sorted(exploded.collect()) == sorted(closed.collect())


def test_one_shot_spread(spark):
    assert [tuple(r)[1:] for r in ingest.source_buckets(flow(spark, (0, 3_000_000_000, 7, 1))).collect()] == [(0, 7)]
    assert [tuple(r)[1:] for r in ingest.source_buckets(flow(spark, (0, 10, 0, 1))).collect()] == [(0, 0)]
    assert [tuple(r)[1:] for r in ingest.source_buckets(flow(spark, (3_599_000_000, 3_700_000_000, 1, 1))).collect()] == [(0, 1)]


def plain_allowlist(flows, w, steady, heavy, now, agg=3600):
    data = defaultdict(lambda: defaultdict(int))
    for f in flows:
        first, last, n = f.first_us / 1e6, f.last_us / 1e6, f.in_packets
        src, a, b = f.src_addr & ~255, int(first) - int(first) % agg, int(last) - int(last) % agg
        if a == b or n == 1:
            data[src][a] += n
        else:
            for i in range(n):
                t = first + i * ((last - first) / (n - 1))
                data[src][int(t - t % agg)] += 1
    start, out = now - now % agg - agg * w, {}
    for src, times in data.items():
        v = [x for t, x in times.items() if start <= t < now]
        if len(v) >= steady and max(v) >= heavy:
            out[src] = max(v)
    return out


def test_one_shot_allowlist(spark, sf):
    from sluice.plans import fixture

    flows = fixture.flows(spark, sf)
    rows = flows.where("dst_port = 53").collect()
    for w, steady, heavy, now in ((72, 3, 64, fixture.NOW), (200, 2, 20, fixture.NOW - 1234)):
        config = prototype.Configuration(param_w_train=w, param_steady=steady, param_heavy=heavy)
        got = {r.ip: r.packets for r in prototype.one_shot_allowlist(flows, config, now).collect()}
        assert got == {str(ipaddress.ip_address(k)): v for k, v in plain_allowlist(rows, w, steady, heavy, now).items()} and got


def test_unaligned_now_admits_one_bucket_more(spark):
    buckets = spark.createDataFrame([(1, t, 1) for t in range(0, 14400, 3600)], "src_net long, time long, packets long")
    config = prototype.Configuration(param_w_train=2, param_steady=3, param_heavy=1)
    assert prototype.allowlist_of(buckets, config, 10000).count() == 1  # 0, 3600, 7200
    assert prototype.allowlist_of(buckets, config, 10800).count() == 0  # 3600, 7200


def test_frames_equal_slices(spark, sf):
    from sluice.plans import fixture

    dense = fixture.dense(spark, sf).cache()
    stats = windows.window_stats(dense, (24,)).where("time_start in (1, 100, 698)").select(*series.KEY, "time_start", "total", "active")
    parts = [series.slice_stats(dense, s, 24).where("active > 0").select(*series.KEY, F.lit(s).alias("time_start"), "total", "active") for s in (1, 100, 698, 699)]
    assert sorted(stats.collect()) == sorted(parts[0].union(parts[1]).union(parts[2]).union(parts[3]).collect())
    assert parts[3].count() == 0  # would reach beyond the series


def test_other_protocols_give_zero_series(spark):
    rows = [("aaa", 1, 9, 6, 0, 5), ("aaa", 2, 9, 17, 3600, 7), ("aaa", 2, 9, 17, 10800, 1)]
    got = series.dense_series(spark.createDataFrame(rows, "location string, src_net long, dst_addr long, proto short, time long, total_packets long")).collect()
    assert {r.src_net: r.total_packets for r in got} == {1: [0, 0, 0, 0], 2: [0, 7, 0, 1]}


def test_allowlists_shrink_with_their_minima(spark, sf):
    from sluice.plans import fixture

    stats = fixture.stats(spark, sf, (24,))
    n = {(r.active_min, r.pkts_min): r.n for r in windows.allowlist_rows(stats).groupBy("active_min", "pkts_min").agg(F.count("*").alias("n")).collect()}
    for a, p in n:
        assert all(n[a, p] >= n.get(k, 0) for k in ((a + 1, p), (a, p * 2)))


def test_series_by_hand(spark):
    """Zeros before, between and after; bounds; an hour that occurs twice."""
    schema = "location string, src_net long, dst_addr long, proto short, time long, total_packets long"
    rows = [("a", 1, 9, 17, 7200, 4), ("a", 1, 9, 17, 18000, 5), ("a", 2, 9, 17, 0, 1), ("a", 2, 9, 17, 21600, 2), ("a", 3, 9, 6, 3600, 7), ("a", 4, 9, 17, 5000, 3)]
    df = spark.createDataFrame(rows, schema)
    got = {r.src_net: r.total_packets for r in series.dense_series(df).collect()}
    assert got == {1: [0, 0, 4, 0, 0, 5, 0], 2: [1, 0, 0, 0, 0, 0, 2], 3: [0] * 7, 4: [0] * 7}
    got = {r.src_net: r.total_packets for r in series.dense_series(df.where("src_net < 4"), start=3600, end=18000).collect()}
    assert got == {1: [0, 4, 0, 0, 5], 2: [0] * 5, 3: [0] * 5}
    with pytest.raises(Exception, match="twice"):
        series.dense_series(df.union(df)).collect()
    assert series.dense_series(df.limit(0)).count() == 0


def test_missing_intervals_are_an_error(spark):
    key = "location string, src_net long, dst_addr long, total_packets array<long>"
    hit = spark.createDataFrame([("a", 9, 1, 5.0)], "location string, dst_addr long, src_net long, attack double")
    grid = dict(hours=8, train_lengths=(2,), test_lengths=(3,), active_minima=(1,), packet_minima=(1,), low_passes=(1,), above_limits=(1.0,), missing="error")
    full = windows.window_stats(spark.createDataFrame([("a", 1, 9, [1] * 8)], key), (2, 3))
    assert evaluate.evaluate_grid(full, hit, **grid).count() == 4
    gap = windows.window_stats(spark.createDataFrame([("a", 1, 9, [1, 0, 0, 1, 1, 1, 1, 1])], key), (2, 3))
    with pytest.raises(ValueError, match="windows of 2 hours"):
        evaluate.evaluate_grid(gap, hit, **grid)
    with pytest.raises(ValueError):
        evaluate.evaluate_grid(full, hit, **(grid | {"missing": "x"}))


def test_missing_windows(spark):
    wanted = spark.createDataFrame([("aaa", 9, 1, 8)], "location string, dst_addr long, time_start int, train_window int")
    empty = windows.traffic_intervals(windows.window_stats(spark.createDataFrame([("aaa", 1, 9, [0] * 8)], "location string, src_net long, dst_addr long, total_packets array<long>"), (8,)))
    assert windows.lookup_intervals(wanted, empty, "empty").first().iprange_srcs == []
    with pytest.raises(Exception, match="no traffic interval"):
        windows.lookup_intervals(wanted, empty).collect()


def test_attack_rate(spark):
    rates = attack.attack_rates(spark.createDataFrame([(1, 1.0), (2, 3.0)], "src_net long, weight double"), 40 * 2**30).orderBy("src_net").collect()
    assert sum(r.rate for r in rates) == pytest.approx(193_273_528_320) and rates[1].rate == pytest.approx(3 * rates[0].rate)


def test_catchment(spark):
    ip = lambda x: int(ipaddress.ip_address(x))
    spans = spark.createDataFrame([(0, ip("10.0.0.0"), ip("10.255.255.255"), 1, "xxx", 0.25)], "entry long, start long, end long, dst_addr long, location string, factor double")
    rates = spark.createDataFrame([(ip("10.1.2.0"), 400.0), (ip("11.0.0.0"), 400.0)], "src_net long, rate double")
    targets = spark.createDataFrame([(loc, d) for loc in ("xxx", "yyy") for d in (1, 2)], "location string, dst_addr long")
    got = {(r.location, r.dst_addr, r.src_net): r.attack for r in attack.attack_by_location(rates, targets, spans).collect()}
    assert got == {("xxx", 1, ip("10.1.2.0")): 100.0, **{(loc, 2, ip("10.1.2.0")): 200.0 for loc in ("xxx", "yyy")}, **{(loc, d, ip("11.0.0.0")): 200.0 for loc in ("xxx", "yyy") for d in (1, 2)}}


@pytest.mark.parametrize("attack_,test,limit,tn,fp,fn,tp", [(300, 100, 128, 32, 68, 96, 204), (300, 100, 200, 50, 50, 150, 150), (0, 100, 128, 100, 0, 0, 0), (300, 0, 128, 0, 0, 128, 172), (0, 0, 128, 0, 0, 0, 0)])
def test_filter(spark, attack_, test, limit, tn, fp, fn, tp):
    r = spark.range(1).select(*(v.alias(k) for k, v in evaluate.outcomes(F.lit(float(attack_)), F.lit(float(test)), F.lit(float(limit))).items())).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)


def test_listed_without_train_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1.0, None, 1.0, True)], "k string, attack double, train double, test double, listed boolean")
    with pytest.raises(Exception, match="allowlisted"):
        evaluate.score(rows, ["k"], 128, 1).collect()


def naive(stats, attacks, hours, tr, te, m, p, lp, al, evading=(), extend=False):
    by = {(r.time_start, r.train_window, r.src_net): r for r in stats}
    out = {}
    for s in range(1, hours - tr - te + 2):
        total = defaultdict(float)
        train = {k[2]: v.average for k, v in by.items() if k[:2] == (s, tr)}
        largest = max(train.values(), default=None)
        for src in {k[2] for k in by} | set(attacks):
            a, t = attacks.get(src, 0.0), by.get((s + tr, te, src))
            t = t.average * 10 if t else 0.0
            w = by.get((s, tr, src))
            listed = bool(w and w.active >= m and w.average >= p)
            x = train.get(src)
            if src in evading and src in attacks and largest is not None:
                x, listed = largest, listed or extend
            if a + t == 0:
                continue
            limit, ratio = x * 10 * al if listed else lp, a / (a + t)
            tn, fn = min(t, limit * (1 - ratio)), min(a, limit * ratio)
            for k, v in (("tp", a - fn), ("tn", tn), ("fp", t - tn), ("fn", fn), ("total", a + t)):
                total[k] += v
        out[s] = total
    return out


@pytest.mark.parametrize("mode", [None, "as_published", "extend_allowlist"])
def test_grid_against_loops(spark, mode):
    r = random.Random(4)
    rows = [("aaa", k, 9, [r.choice([0, 0, r.randrange(200)]) for _ in range(20)]) for k in range(6)]
    stats = windows.window_stats(spark.createDataFrame(rows, "location string, src_net long, dst_addr long, total_packets array<long>"), (3, 4))
    attacks = {k: float(r.randrange(1, 3000)) for k in (1, 3, 50, 51)}
    hit = spark.createDataFrame([("aaa", 9, k, v) for k, v in attacks.items()], "location string, dst_addr long, src_net long, attack double")
    evading = (3, 51) if mode else ()
    extra = {"evasion": spark.createDataFrame([(k,) for k in evading], "src_net long"), "evasion_mode": mode} if mode else {}
    got = evaluate.evaluate_grid(stats, hit, 20, (4,), (3,), (1, 3), (10, 60), (128, 700), (1.0, 2.0), **extra).collect()
    assert len(got) == 16 * 14 and evaluate.conservation(spark.createDataFrame(got)).count() == 0
    known = stats.collect()
    for m in (1, 3):
        for p in (10, 60):
            for lp in (128, 700):
                for al in (1.0, 2.0):
                    want = naive(known, attacks, 20, 4, 3, m, p, lp, al, evading, mode == "extend_allowlist")
                    for x in got:
                        if (x.min_active, x.min_pkts_avg, x.low_pass, x.above_limit) == (m, p, lp, al):
                            assert all(x[c] == pytest.approx(want[x.window_start][c], abs=1e-6) for c in ("tp", "tn", "fp", "fn", "total")), x


def test_higher_limits_never_drop_more(spark, sf):
    from sluice.plans import fixture

    rows = fixture.evaluation(spark, sf).groupBy("low_pass", "above_limit").agg(F.sum("fp").alias("fp")).collect()
    fp = {(r.low_pass, r.above_limit): r.fp for r in rows}
    assert fp[512, 1.0] <= fp[128, 1.0] and fp[128, 2.0] <= fp[128, 1.0]


RESULTS = "location string, dst_addr long, attack_bandwidth long, test_length int, low_pass int, train_length int, min_active int, min_pkts_avg int, above_limit double, window_start int, fpr double, attack_traffic double"


def results(spark, rows):
    return spark.createDataFrame([("a", 1, 5, t, 128, p, 1, 4, 1.0, s, f, 10.0 * p) for t, p, s, f in rows], RESULTS)


def test_ties(spark):
    same = results(spark, [(8, p, s, 0.5) for p in (1, 2) for s in (1, 9, 17)])
    assert select.global_optimum(same).first().train_length == 1
    assert select.day_forward(same).first().avg_attack_traffic == 20.0


def test_stride_ends_at_the_first_gap(spark):
    assert select.global_optimum(results(spark, [(8, 1, 1, 0.1), (8, 1, 9, 0.3), (8, 1, 25, 0.9), (8, 1, 2, 0.9)])).first().avg_fpr == pytest.approx(0.2)


def test_nulls_never_win(spark):
    best = select.global_optimum(results(spark, [(8, 1, 1, None), (8, 2, 1, 0.9)])).first()
    assert best.train_length == 2
    assert select.global_optimum(results(spark, [(8, 1, 1, None)])).first().train_length is None


def test_day_forward_uses_the_day_before(spark):
    rows = results(spark, [(8, 1, 1, 0.1), (8, 2, 1, 0.2), (8, 1, 9, 0.7), (8, 2, 9, 0.0), (8, 1, 17, 0.4), (8, 2, 17, 0.3), (8, 1, 33, 0.0)])
    assert select.day_forward(rows).first().avg_fpr == pytest.approx((0.7 + 0.3) / 2)


def test_dense_starts(spark):
    with pytest.raises(Exception, match="missing"):
        select.evasion_means(results(spark, [(8, 1, 1, 0.1), (8, 1, 3, 0.1)]).withColumn("evasion_ips", F.lit(1))).collect()


def test_limits_are_rounded(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.49, 1.5, 2.5)], "above_limit double")
    assert [r.above_limit for r in select.rounded_limits(rows).collect()] == [1, 1, 1, 2, 3]


def test_evasion_lookup(spark):
    means = spark.createDataFrame([("a", 0, 1, 0.5, 3600.0), ("a", 0, 2, 0.25, 7200.0), ("a", 7, 1, 0.1, 360.0)], "location string, evasion_ips long, attack_bandwidth long, fpr double, attack_traffic double")
    assert sorted(tuple(r) for r in select.evasion_lookup(means).collect()) == [("a", 0, 0.25, 2.0), ("a", 7, 0.1, 0.1)]


def test_weighted_summary(spark):
    for data, weights, want in (([1, 2, 3], [1, 1, 2], 2.5), ([5, 1, 9], [1, 1, 5], 9), ([1, 2, 3, 4], [1] * 4, 2.5), ([1, 2, 3], [1] * 3, 2), ([4], [1], 4)):
        rows = spark.createDataFrame([(8, 128, float(d), 3600.0 * d, float(w)) for d, w in zip(data, weights)] + [(8, 128, None, None, 9.0)], "test_length int, low_pass int, avg_fpr double, avg_attack_traffic double, weight double")
        got = reports.summary(rows).first()
        assert got.medw_fpr == got.medw_traffic == want and got.max_fpr == max(data)
        assert got.avgw_fpr == pytest.approx(sum(d * w for d, w in zip(data, weights)) / sum(weights))


def test_last_written(spark):
    twice = results(spark, [(8, 1, 1, 0.1)]).withColumn("n", F.lit(1)).union(results(spark, [(8, 1, 1, 0.4)]).withColumn("n", F.lit(2)))
    assert select.last_written(twice, "n").first().fpr == 0.4


@pytest.mark.parametrize("data,weights,want", [([1, 2, 3], [1, 1, 2], 2.5), ([5, 1, 9], [1, 1, 5], 9), ([1, 2, 3, 4], [1] * 4, 2.5), ([1, 2, 3], [1] * 3, 2), ([4], [1], 4), ([1, 2], [0, 0], None)])
def test_weighted_median(spark, data, weights, want):
    rows = spark.createDataFrame([("g", float(d), float(w)) for d, w in zip(data, weights)], "g string, v double, w double")
    assert reports.weighted_median(rows, ["g"], "v", "w").first().weighted_median == want


def test_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (2.0,), (3.0,), (3.1,), (-0.1,)], "v double")
    got = rows.select(reports.edge_bin(F.col("v"), [0, 1, 2, 3]).alias("e"), reports.linear_bin(F.col("v"), F.lit(0.0), F.lit(3.0), 3).alias("l")).collect()
    assert [r.e for r in got] == [r.l for r in got] == [0, 0, 1, 2, 2, None, None]
    assert reports.log_edges(10, 10_000_000, 100)[0] == pytest.approx(10) and len(reports.log_edges(10, 10_000_000, 100)) == 100


def test_metrics(spark):
    row = spark.createDataFrame([(8.0, 6.0, 2.0, 4.0, 20.0)], "tp double, tn double, fp double, fn double, total double").select(metrics.fpr().alias("fpr"), metrics.fnr().alias("fnr"), metrics.f_beta().alias("f1"), metrics.balanced_accuracy().alias("b")).first()
    assert tuple(row) == pytest.approx((0.25, 1 / 3, 16 / 22, (8 / 12 + 6 / 8) / 2))
    none = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "tp double, tn double, fp double, fn double, total double")
    assert tuple(none.select(metrics.fpr(), metrics.fnr(), metrics.f_beta(2), metrics.balanced_accuracy()).first()) == (None,) * 4


def test_seeded_sample(spark):
    nets = spark.range(100).withColumnRenamed("id", "src_net")
    a = {r.src_net for r in evaluate.seeded_sample(nets, 7).collect()}
    assert len(a) == 7 and a == {r.src_net for r in evaluate.seeded_sample(nets.repartition(9), 7).collect()} != {r.src_net for r in evaluate.seeded_sample(nets, 7, 1).collect()}
