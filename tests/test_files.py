"""Files in and out, the command line, and the stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sluice import cli
from sluice.functions import net
from sluice.operators import ingest, prototype, select
from sluice.sources import exchange, flows
from sluice.streaming import allowlist as stream

FULL = {
    "type": "FLOW", "sampled": 0, "export_sysid": 1, "t_first": "2024-01-01T00:00:00.250", "t_last": "2024-01-01T00:10:00.000", "proto": 17, "fwd_status": 0, "tcp_flags": "...AP...",
    "src_tos": 0, "in_packets": 5, "in_bytes": 500, "input_snmp": 1, "output_snmp": 2, "src_as": 1, "dst_as": 2, "ip4_router": "10.0.0.1", "engine_type": 0, "engine_id": 0,
    "t_received": "2024-01-01T00:11:00.000", "label": "<none>", "src4_addr": "192.0.2.7", "dst4_addr": "198.51.100.1", "src_port": 999, "dst_port": 53,
}
SIX = {k: v for k, v in FULL.items() if not k.endswith("4_addr")} | {"src6_addr": "2001:db8::1", "dst6_addr": "2001:db8::2"}


def written(path, rows, indent=2):
    text = json.dumps(rows, indent=indent)
    if str(path).endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return f"file://{path}"


def test_read_flows(spark, tmp_path):
    v2 = {k: v for k, v in FULL.items() if k not in ("t_first", "t_last")} | {"first": "2024-01-01T01:00:00.000+05:00", "last": "2024-01-01T01:00:01.5"}
    for name in ("a.json", "b.json.gz"):
        rows = flows.slim(flows.read_json(spark, written(tmp_path / name, [FULL, v2, SIX])), "aaa").orderBy("first_us").collect()
        assert [(r.first_us, r.last_us, r.src_addr, r.in_packets) for r in rows] == [(1704067200_250000, 1704067800_000000, 3221225991, 5), (1704070800_000000, 1704070801_500000, 3221225991, 5)]
    assert flows.packed(flows.read_json(spark, f"file://{tmp_path}/a.json")).where("family = 6").first().src_bytes[:2] == b"\x20\x01"


def test_strict_flows(spark, tmp_path):
    assert flows.read_json(spark, written(tmp_path / "good.json", [FULL, SIX]), strict=True).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        flows.read_json(spark, written(tmp_path / "more.json", [FULL | {"extra": 1}]), strict=True)
    for name, bad in (("type", FULL | {"type": "EVENT"}), ("direction", FULL | {"direction": 2}), ("proto", {k: v for k, v in FULL.items() if k != "proto"})):
        with pytest.raises(Exception, match=name):
            flows.read_json(spark, written(tmp_path / f"{name}.json", [bad]), strict=True).collect()


def test_broken_flows(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps([FULL])[:-1])
    with pytest.raises(Exception):
        flows.read_json(spark, f"file://{tmp_path}/cut.json").collect()
    for name, gone in (("first time", "t_first"), ("source address", "src4_addr")):
        with pytest.raises(Exception, match=name):
            flows.slim(flows.read_json(spark, written(tmp_path / "x.json", [{k: v for k, v in FULL.items() if k != gone}]))).collect()
    with pytest.raises(Exception, match="families"):
        flows.packed(flows.read_json(spark, written(tmp_path / "m.json", [{k: v for k, v in FULL.items() if k != "dst4_addr"} | {"dst6_addr": "::1"}]))).collect()


def test_config(tmp_path):
    (tmp_path / "c.jsonc").write_text('{\n  // a comment\n  "param_heavy": 7,\n  "destination_addresses": ["10.0.0.0/8", "::/0"]\n}')
    assert flows.read_config(f"{tmp_path}/c.jsonc") == prototype.Configuration(destination_addresses=("10.0.0.0/8", "::/0"), param_heavy=7)
    (tmp_path / "bad.jsonc").write_text('{"destination_addresses": ["10.0.0.1/8"]}')
    with pytest.raises(ValueError):
        flows.read_config(f"{tmp_path}/bad.jsonc")


def test_dumps_need_the_tool(spark):
    with pytest.raises(RuntimeError):
        flows.read_dumps(spark, ["x"])


AGG = "location string, src_net long, dst_addr long, proto short, time long, total_packets long"


def test_aggregates(spark, tmp_path):
    whole = {"ipv4": [[[3600, 17, "192.0.2.0/24", "198.51.100.1"], {"total_packets": 7}], [[7200, 6, "192.0.2.0", "198.51.100.1"], {"total_packets": 1}]], "ipv6": [[[1, 17, "2001:db8::", "::1"], {"total_packets": 2}]]}
    rows = exchange.read_aggregates(spark, written(tmp_path / "a.json", whole, None), "aaa")
    assert sorted((r.time, r.proto, r.src_net, r.total_packets) for r in rows.collect()) == [(3600, 17, 3221225984, 7), (7200, 6, 3221225984, 1)]
    six = exchange.read_aggregates(spark, f"file://{tmp_path}/a.json", "aaa", 6).collect()
    assert [(r.time, bytes(r.src_net)[:4], r.total_packets) for r in six] == [(1, b"\x20\x01\x0d\xb8", 2)]
    exchange.store_aggregates(rows, f"file://{tmp_path}/t", 3600)
    back = exchange.read_stored(spark, f"file://{tmp_path}/t")
    assert back.where("agg_interval = 3600 and location = 'aaa'").count() == 2
    with pytest.raises(Exception, match="exist"):
        exchange.store_aggregates(rows, f"file://{tmp_path}/t", 3600)
    with pytest.raises(ValueError, match="repeated"):
        exchange.store_aggregates(rows.union(rows), f"file://{tmp_path}/u", 3600)
    with pytest.raises(ValueError):
        exchange.store_aggregates(rows, f"file://{tmp_path}/v", 61)
    with pytest.raises(Exception, match="four characters"):
        exchange.store_aggregates(rows.withColumn("location", F.lit("abcde")), f"file://{tmp_path}/w", 300)
    assert {r.total_packets for r in ingest.merge(rows, rows).collect()} == {14, 2}


def test_aggregates_are_read_as_written(spark, tmp_path):
    four = spark.createDataFrame([("aaa", 167772160 + 256 * k, 3325256705, 17, 3600 * k, k + 1) for k in range(50)], AGG).repartition(3)
    six = four.withColumns({"src_net": net.parse_v6(F.concat(F.lit("2001:db8:"), F.hex(F.col("time") / 3600), F.lit("::"))), "dst_addr": net.parse_v6(F.lit("::1"))})
    exchange.write_aggregates(f"file://{tmp_path}/out", four, six)
    for family, want in ((4, four), (6, six)):
        got = exchange.read_aggregates(spark, f"file://{tmp_path}/out", "aaa", family)
        assert got.dtypes == want.select(got.columns).dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    for file in (tmp_path / "out").glob("*.txt"):
        assert set(json.loads(file.read_text())) == {"ipv4", "ipv6"}
    exchange.write_aggregates(f"file://{tmp_path}/none", four.limit(0))
    assert exchange.read_aggregates(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="neither"):
        exchange.read_aggregates(spark, written(tmp_path / "x.json", {"other": []}, None)).collect()


def test_catchment_and_attackers(spark, tmp_path):
    c = exchange.read_catchment(spark, written(tmp_path / "c.json", [[["10.0.0.0/24", "10.0.2.0/23"], {"203.0.113.1": {"xxx": 0.25, "yyy": 1}}], [["11.0.0.0/8"], {}]], None)).orderBy("location").collect()
    assert [(r.entry, r.start, r.end, r.location, r.factor) for r in c] == [(0, 167772160, 167772160 + 1023, "xxx", 0.25), (0, 167772160, 167772160 + 1023, "yyy", 1.0)]
    a = exchange.read_attackers(spark, written(tmp_path / "w.json", {"10.0.0.1": 1.5, "::1": 2}, None)).collect()
    assert [tuple(r) for r in a] == [(167772161, 1.5)]
    assert [(bytes(r[0])[-1], r[1]) for r in exchange.read_attackers(spark, f"file://{tmp_path}/w.json", 6).collect()] == [(1, 2.0)]


def test_results_carry_their_path(spark, tmp_path):
    folder = tmp_path / "conf" / "aaa-12ips"
    folder.mkdir(parents=True)
    config = {"location": "aaa", "iprange_dst": "198.51.100.1/32", "window_start": 1, "train_length": 8, "test_length": 8, "min_active": 1, "min_pkts_avg": 64, "low_pass": 128, "above_train_limit": 1.0}
    written(folder / "aaa_4444bps.json", [[config, {"total": 4, "true_positives": 1, "true_negatives": 1, "false_positives": 1, "false_negatives": 1}]], None)
    r = exchange.read_results(spark, f"file://{tmp_path}/conf").first()
    assert (r.attack_bandwidth, r.evasion_ips, r.dst_addr, r.tp) == (4444, 12, 3325256705, 1.0)


def test_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"location":"aaa","iprange_src":"10.0.0.0/24","total_packets_max":3,"total_packets_sum":9,"active_hours":2}\n')
    assert exchange.read_peaks(spark, f"file://{tmp_path}/p.json").first().total_packets_sum == 9
    d = exchange.read_diffs(spark, written(tmp_path / "d.json", [{"config": {"location": "aaa", "low_pass": 1}, "diffs": [{"attack_traffic": 1.0, "fpr": 0.5}, {"attack_traffic": 2.0, "fpr": 0.1}]}])).collect()
    assert [(r.location, r.idx, r.fpr) for r in d] == [("aaa", 0, 0.5), ("aaa", 1, 0.1)]
    o = exchange.read_optima(spark, written(tmp_path / "x_results_1.json", [{"location": "aaa", "avg_fpr": 0.5, "best_params": {"train_length": 24}}]).replace("x_results_1", "*_results_*")).first()
    assert o.best_params.train_length == 24
    assert exchange.read_evasions(spark, written(tmp_path / "e.json", [{"location": "aaa", "evasion_ips": 3, "fpr": 0.25}])).first().evasion_ips == 3
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert exchange.json_object(rows, "k", "v").first().json == '{"a":1,"b":2}'
    assert exchange.json_rows(rows).first().json == '{"k":"b","v":2}'


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("aaa", 1), ("bbb", 1)], "location string, k long")
    exchange.write_table(rows, f"file://{tmp_path}/t", ["location", "k"])
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    with pytest.raises(Exception, match="null"):
        exchange.write_table(rows.withColumn("k", F.nullif("k", F.lit(1))), f"file://{tmp_path}/u", ["location", "k"])


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    rows = []
    for hour in range(30):
        for src in range(6):
            rows.append(FULL | {"t_first": f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:05:00.000", "t_last": f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:40:00.000", "in_packets": 20 + 7 * src + hour, "src4_addr": f"10.0.{src}.9"})
        rows.append(SIX | {k: rows[-1][k] for k in ("t_first", "t_last")})
    path = written(tmp_path / "f.json", rows, None)
    run = lambda *a, **k: cli.run(cli.parser().parse_args([str(x) for x in a]), spark, **k)
    run("allowlist", "-n", 1704067200 + 30 * 3600, "-o", "-", "-c", written(tmp_path / "c.json", {"param_heavy": 60}).removeprefix("file://"), path)
    out = capsys.readouterr().out.split()
    assert out[0] == "ip,packets" and sorted(out[1:]) == sorted(f"10.0.{s}.0,{20 + 7 * s + 29}" for s in range(6) if 49 + 7 * s >= 60)
    run("allowlist", "-n", 1704067200 + 30 * 3600, "-o", "-", "-c", written(tmp_path / "six.json", {"param_heavy": 5, "destination_addresses": ["2001:db8::/32"]}).removeprefix("file://"), path)
    assert capsys.readouterr().out.split() == ["ip,packets", "2001:db8::,5"]
    run("allowlist", "-n", 1704067200 + 30 * 3600, path)
    assert "entries" in capsys.readouterr().out
    run("aggregate", "--output", f"file://{tmp_path}/agg", "--time-start", 0, path)
    run("store", 3600, "aaa", f"file://{tmp_path}/table", f"file://{tmp_path}/agg")
    table = ingest.aggregates(ingest.dns_flows(flows.slim(flows.read_json(spark, path), "aaa")))
    stored = exchange.read_stored(spark, f"file://{tmp_path}/table").select(table.columns)
    assert sorted(stored.collect()) == sorted(table.collect()) and stored.count() == 180
    seen = exchange.read_stored(spark, exchange.table_of(f"file://{tmp_path}/table", 6))
    assert [(net_text, n) for net_text, n in seen.groupBy(net.format_v6("src_net")).agg(F.sum("total_packets")).collect()] == [("2001:db8::", 5 * 30)]
    grid = {"train_lengths": (8,), "test_lengths": (4,), "active_minima": (1,), "packet_minima": (10, 40), "low_passes": (128,), "above_limits": (1.0, 2.0)}
    run("evaluate", "--attacker-ips", written(tmp_path / "w.json", {"10.0.1.1": 1, "10.0.9.9": 2}, None), "--bits-per-second", 4444, f"file://{tmp_path}/table", f"file://{tmp_path}/out/conf", grid=grid)
    run("optimise", "--configuration", "conf", f"file://{tmp_path}/out")
    best = exchange.read_optima(spark, f"file://{tmp_path}/out/global_opt_results_conf.json").collect()
    assert [(r.attack_bandwidth, r.test_length, r.low_pass, r.iprange_dst) for r in best] == [(4444, 4, 128, "198.51.100.1/32")]
    direct = select.global_optimum(cli._results(spark, f"file://{tmp_path}/out/conf")).first()
    assert (best[0].avg_fpr, best[0].best_params.train_length, best[0].best_params.min_pkts_avg, best[0].best_params.above_train_limit) == (direct.avg_fpr, direct.train_length, direct.min_pkts_avg, direct.above_limit)
    ahead = exchange.read_optima(spark, f"file://{tmp_path}/out/dfc_results_conf.json").collect()
    assert len(ahead) == 1 and ahead[0].avg_fpr is not None and ahead[0].best_params is None
    monkeypatch.setattr(cli, "BEST_TRAIN", 8)
    run("evaluate", "--attacker-ips", f"file://{tmp_path}/w.json", "--evasion-ips", 1, "--bits-per-second", 4444, f"file://{tmp_path}/table", f"file://{tmp_path}/out/evade", grid=grid)
    run("evasion", "--configuration", "evade", "--extra", "x", f"file://{tmp_path}/out")
    means = exchange.read_evasions(spark, f"file://{tmp_path}/out/results_evasion_evade_x.json").collect()
    assert len(means) == 4 and {(r.evasion_ips, r.params.train_length) for r in means} == {(1, 8)}
    with pytest.raises(ValueError):
        run("aggregate", "--output", "x", "--time-start", 5, "--time-end", 5, path)


def test_stream(spark, tmp_path):
    from sluice.plans import fixture

    sf = "/root/testdata/sf0.001"
    table = fixture.dns(spark, sf).where("location = 'aaa'").orderBy("first_us")
    rows = table.collect()
    parts = [rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3] for k in range(3)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, table.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    live = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    seen = []
    config = prototype.Configuration(param_w_train=72, param_steady=2, param_heavy=20)
    query = stream.refresh(stream.source_hours(live, "2000 hours"), config, f"file://{tmp_path}/hours", lambda a: seen.append(a.count()), f"file://{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    short = stream.source_hours(live, "1 hour")
    query = short.writeStream.format("memory").queryName("hours").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.src_net, r.time): r.n for r in ingest.bucket_packets(table).groupBy((F.col("src_addr").bitwiseAND(F.lit(~255))).alias("src_net"), "time").agg(F.sum("n").alias("n")).collect()}
    got = {(r.src_net, r.time): r.packets for r in spark.table("hours").collect()}
    assert got and all(v <= batch[k] for k, v in got.items())
    # one file at a time keeps the order of the files, so with a long delay nothing comes late
    whole = stream.source_hours(live, "2000 hours").writeStream.format("memory").queryName("whole").outputMode("complete").start()
    whole.processAllAvailable()
    whole.stop()
    assert {(r.src_net, r.time): r.packets for r in spark.table("whole").collect()} == batch
