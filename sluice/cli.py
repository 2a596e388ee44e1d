"""Command line: allowlist, aggregate, store, evaluate, optimise, evasion."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics
from .operators import attack, evaluate, ingest, prototype, select, series, windows
from .sources import exchange, flows


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all files below a folder; of a configuration and window that repeat, those of the last file count."""
    r = exchange.read_results(spark, folder).withColumns({"fpr": metrics.fpr(), "attack_traffic": F.col("fn")})
    return select.last_written(select.rounded_limits(r), "file", "evasion_ips")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("allowlist", help="one-shot allowlist from flow files")
    a.add_argument("-c", "--config")
    a.add_argument("-n", "--now", type=int)
    a.add_argument("-o", "--output")
    a.add_argument("files", nargs="+")
    a = sub.add_parser("aggregate", help="packet counts by bucket and network")
    a.add_argument("--output", required=True)
    a.add_argument("--time-start", type=int, default=0)
    a.add_argument("--time-end", type=int, default=(1 << 32) - 1)
    a.add_argument("--agg-interval", type=int, default=3600)
    a.add_argument("files", nargs="+")
    a = sub.add_parser("store", help="aggregates of one location into the table")
    a.add_argument("interval", type=int)
    a.add_argument("location")
    a.add_argument("table")
    a.add_argument("files", nargs="+")
    a = sub.add_parser("evaluate", help="all configurations over stored aggregates")
    a.add_argument("--attacker-ips", required=True)
    a.add_argument("--catchment")
    a.add_argument("--evasion-ips", type=int, default=0)
    a.add_argument("--bits-per-second", type=int, required=True)
    a.add_argument("table")
    a.add_argument("output")
    for name in ("optimise", "evasion"):
        a = sub.add_parser(name)
        a.add_argument("--configuration", required=True)
        a.add_argument("--extra")
        a.add_argument("folder")
    return p


#: The parameters of the full evaluation (fixed values of the experiment).
FULL_GRID = {"train_lengths": (1, 2, 4, 8, 12, 24, 25, 48, 49, 72, 73), "test_lengths": (8, 24, 72), "active_minima": (1, 4, 8, 12), "packet_minima": (64, 128, 256), "low_passes": (128, 512, 2048, 8192), "above_limits": (1.0, 2.0, 4.0)}

#: The training length that evaluations under evasion use.
BEST_TRAIN = 24


def run(args: argparse.Namespace, spark: SparkSession, grid: dict | None = None) -> None:
    if args.command == "allowlist":
        config = flows.read_config(args.config) if args.config else prototype.Configuration()
        now = args.now if args.now is not None else int(time.time())
        four, six = (prototype.one_shot_allowlist(f, config, now) for f in flows.both_families(flows.read_json(spark, args.files)))
        exchange.write_allowlist(four.unionByName(six), args.output)
    elif args.command == "aggregate":
        if args.time_start >= args.time_end:
            raise ValueError("the time range is empty")
        dns = [ingest.valid_flows(ingest.dns_flows(f)) for f in flows.both_families(flows.read_json(spark, args.files))]
        exchange.write_aggregates(args.output, *(ingest.aggregates(f, args.agg_interval, 24, args.time_start, args.time_end, 48) for f in dns))
    elif args.command == "store":
        for family in (4, 6):
            rows = ingest.merge(*(exchange.read_aggregates(spark, f, args.location, family) for f in args.files))
            if family == 4 or not rows.isEmpty():
                exchange.store_aggregates(rows, exchange.table_of(args.table, family), args.interval)
    elif args.command == "evaluate":
        stored = exchange.read_stored(spark, args.table).where("agg_interval = 3600")
        grid = grid or FULL_GRID
        if args.evasion_ips:
            grid = grid | {"train_lengths": (BEST_TRAIN,)}
        axis = series.hour_range(stored).first()
        rates = attack.attack_rates(attack.weights_by_network(exchange.read_attackers(spark, args.attacker_ips)), args.bits_per_second)
        catchment = exchange.read_catchment(spark, args.catchment) if args.catchment else None
        hit = attack.attack_by_location(rates, stored.select("location", "dst_addr").distinct(), catchment)
        evading = evaluate.seeded_sample(rates, args.evasion_ips) if args.evasion_ips else None
        lengths = tuple(sorted({*grid["train_lengths"], *grid["test_lengths"]}))
        stats = windows.window_stats(series.dense_series(stored), lengths).persist()
        done = evaluate.evaluate_grid(stats, hit, (axis["last"] - axis["first"]) // 3600 + 1, **grid, evasion=evading, missing="error")
        exchange.write_results(done, f"{args.output}/{args.evasion_ips}ips" if args.evasion_ips else args.output, args.bits_per_second)
        stats.unpersist()
    else:
        extra = f"_{args.extra}" if args.extra else ""
        results = _results(spark, f"{args.folder}/{args.configuration}")
        if args.command == "optimise":
            exchange.write_optima(select.global_optimum(results), f"{args.folder}/global_opt_results_{args.configuration}{extra}.json")
            exchange.write_optima(select.day_forward(results), f"{args.folder}/dfc_results_{args.configuration}{extra}.json")
        else:
            exchange.write_evasions(select.evasion_means(results), f"{args.folder}/results_evasion_{args.configuration}{extra}.json")


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(args, spark)
    spark.stop()


if __name__ == "__main__":
    main()
