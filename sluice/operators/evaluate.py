"""Filter evaluation: benign and attack traffic that passes or is dropped, for every configuration and window.

A source's traffic in the test window is limited: to `low_pass` if it is not on the allowlist, else to its average in
the train window times `above_limit`. Benign and attack traffic share the limit in proportion.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Flow records are sampled one in ten.
SAMPLING = 10.0
PLACE = ("location", "dst_addr")


def outcomes(attack: Column, test: Column, limit: Column) -> dict[str, Column]:
    """tp, tn, fp, fn of one source; both traffics 0 gives 0 throughout."""
    ratio = F.coalesce(F.try_divide(attack, attack + test), F.lit(0.0))
    tn = F.least(test, limit * (1 - ratio))
    fn = F.least(attack, limit * ratio)
    return {"tp": attack - fn, "tn": tn, "fp": test - tn, "fn": fn}


def source_windows(stats: DataFrame, attack: DataFrame, train_length: int, test_length: int) -> DataFrame:
    """(location, dst_addr, window_start, src_net, attack, train, active, test), for sources seen in either window.

    Train and test rows of one source meet by union and grouping: one exchange on a key that both are aggregated on.
    The test window of start s begins at s + train_length.
    """
    key = [*PLACE, "window_start", "src_net"]
    none = F.lit(None)
    train = stats.where(F.col("train_window") == train_length).select(*PLACE, F.col("time_start").alias("window_start"), "src_net", F.col("average").alias("train"), F.col("active"), none.cast("double").alias("test"))
    test = stats.where(F.col("train_window") == test_length).select(*PLACE, (F.col("time_start") - train_length).alias("window_start"), "src_net", none.cast("double").alias("train"), none.cast("int").alias("active"), F.col("average").alias("test"))
    seen = train.unionByName(test.where("window_start >= 1")).groupBy(*key).agg(F.max("train").alias("train"), F.max("active").alias("active"), F.max("test").alias("test"))
    return seen.join(attack, [*PLACE, "src_net"], "left").select(*key, "attack", "train", "active", "test")


def merged(allowlist: DataFrame, attack: DataFrame, train: DataFrame, test: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of four tables on `key`: attack, train, test (null where absent) and `listed`.

    Each table has a row for a key at most, so tagging, union and one grouping give what three full joins would.
    """
    columns = {"attack": "double", "train": "double", "test": "double", "listed": "boolean"}
    parts = []
    for df, own in ((attack, "attack"), (train, "train"), (test, "test"), (allowlist.withColumn("listed", F.lit(True)), "listed")):
        parts.append(df.select(*key, *(F.col(c).cast(t).alias(c) if c == own else F.lit(None).cast(t).alias(c) for c, t in columns.items())))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    out = every.groupBy(*key).agg(*(F.max(c).alias(c) for c in columns))
    return out.withColumn("listed", F.coalesce("listed", F.lit(False)))


def check_listed(rows: DataFrame) -> DataFrame:
    """The same rows; an allowlisted source without train traffic is an error."""
    bad = F.col("listed") & F.col("train").isNull()
    return rows.where(F.when(bad, F.raise_error(F.lit("allowlisted, but no traffic in the train window")).cast("boolean")).otherwise(True))


def score(rows: DataFrame, by: list[str], low_pass: float, above_limit: float, sampling: float = SAMPLING) -> DataFrame:
    """The sums tp, tn, fp, fn and total of merged rows for one configuration, by the given columns."""
    attack, test = F.coalesce("attack", F.lit(0.0)), F.coalesce(F.col("test") * sampling, F.lit(0.0))
    limit = F.when(F.col("listed"), F.col("train") * sampling * above_limit).otherwise(F.lit(float(low_pass)))
    live = check_listed(rows.where("attack is not null or test is not null"))
    each = outcomes(attack, test, limit)
    return live.select(*by, *(v.alias(k) for k, v in each.items()), (attack + test).alias("total")).groupBy(*by).agg(*(F.sum(c).alias(c) for c in (*each, "total")))


def check_intervals(stats: DataFrame, attack: DataFrame, hours: int, train_lengths: tuple[int, ...], test_lengths: tuple[int, ...]) -> None:
    """An error if a place of the attack has no traffic interval for a window that the evaluation uses."""
    wanted = []
    for t in sorted({*train_lengths, *test_lengths}):
        first = 1 if t in train_lengths else min(train_lengths) + 1
        last = hours - t + 1 if t in test_lengths else hours - t - min(test_lengths) + 1
        if last >= first:
            wanted.append(F.struct(F.lit(t).alias("t"), F.lit(first).alias("first"), F.lit(last).alias("last")))
    if not wanted:
        return
    spans = attack.select(*PLACE).distinct().select(*PLACE, F.inline(F.array(*wanted)))
    seen = stats.groupBy(*PLACE, F.col("train_window").alias("t"), "time_start").agg(F.lit(1).alias("one"))
    found = spans.join(seen, [*PLACE, "t"], "left").groupBy(*PLACE, "t", "first", "last").agg(F.count_if(F.col("time_start").between(F.col("first"), F.col("last"))).alias("n"))
    gaps = found.where("n < last - first + 1").orderBy(*PLACE, "t").limit(1).collect()
    if gaps:
        raise ValueError(f"no traffic interval for some of the windows of {gaps[0]['t']} hours at {gaps[0]['location']}, {gaps[0]['dst_addr']}")


def evaluate_grid(
    stats: DataFrame,
    attack: DataFrame,
    hours: int,
    train_lengths: tuple[int, ...],
    test_lengths: tuple[int, ...],
    active_minima: tuple[int, ...],
    packet_minima: tuple[int, ...],
    low_passes: tuple[int, ...],
    above_limits: tuple[float, ...],
    sampling: float = SAMPLING,
    evasion: DataFrame | None = None,
    evasion_mode: str = "as_published",
    missing: str = "empty",
) -> DataFrame:
    """(location, dst_addr, window_start, train_length, test_length, min_active, min_pkts_avg, low_pass, above_limit, tp, tn, fp, fn, total).

    Outcomes of unlisted sources depend on low_pass only, of listed ones on above_limit only. So each source row makes
    one partial sum for each pair of minima and each of low_passes + above_limits, and the combinations are made from
    sums: sources x pairs x (L + A) terms in place of sources x pairs x L x A.

    Attackers that send no benign traffic in a window add the same there at every start. They are counted once for
    each place, and for sources that are seen the difference to that is summed, so attackers never meet the starts.

    attack: (location, dst_addr, src_net, attack). hours: length of the series. evasion: (src_net) of attackers that
    made themselves known: their train traffic is the window's largest. In mode "extend_allowlist" they are on the
    allowlist too; as published they are only if they were anyhow. Sources are listed by their own train traffic, so
    none can be listed without any. missing: a window without any traffic at a place is "empty", or an "error".
    """
    if missing not in ("error", "empty"):
        raise ValueError("missing is 'error' or 'empty'")
    if missing == "error":
        check_intervals(stats, attack, hours, train_lengths, test_lengths)
    if evasion_mode not in ("as_published", "extend_allowlist"):
        raise ValueError("evasion_mode is 'as_published' or 'extend_allowlist'")
    low = [("low", float(v)) for v in low_passes]
    above = [("above", float(v)) for v in above_limits]
    pairs = [p for p in product(active_minima, packet_minima)]
    sums = ("tp", "tn", "fp", "fn", "total")
    alone = attack.groupBy(*PLACE).agg(F.sum("attack").alias("total"), *(F.sum(F.least("attack", F.lit(v))).alias(f"fn_{k}") for k, (_, v) in enumerate(low)))
    out = None
    for train_length, test_length in product(train_lengths, test_lengths):
        starts = hours - train_length - test_length + 1
        usable = [p for p in pairs if p[0] <= train_length]
        if starts < 1 or not usable:
            continue
        rows = source_windows(stats, attack, train_length, test_length).where(F.col("window_start") <= starts)
        if evasion is not None:
            rows = _with_evasion(rows, attack, evasion)
        live = rows.where("attack is not null or test is not null").withColumn("average", F.col("train") if evasion is None else F.col("own_train"))
        # long lists of terms are written as SQL, which is parsed at once, not built call by call
        minima = ", ".join(f"named_struct('min_active', {m}, 'min_pkts_avg', {p})" for m, p in usable)
        limits = ", ".join(f"named_struct('kind', '{kind}', 'value', {v!r}D)" for kind, v in low + above)
        each = live.selectExpr("*", f"inline(array({minima}))").selectExpr("*", f"inline(array({limits}))")
        is_low, listed = F.col("kind") == "low", F.coalesce((F.col("active") >= F.col("min_active")) & (F.col("average") >= F.col("min_pkts_avg")), F.lit(False))
        if evasion is not None and evasion_mode == "extend_allowlist":
            listed = listed | F.col("evading")
        # one step after the other, by name, so that no expression is written out many times over
        each = each.withColumns({"a": F.coalesce("attack", F.lit(0.0)), "t": F.coalesce(F.col("test") * sampling, F.lit(0.0)), "mine": listed != is_low, "limit": F.when(is_low, F.col("value")).otherwise(F.coalesce(F.col("train") * sampling * F.col("value"), F.lit(0.0)))})
        made = outcomes(F.col("a"), F.col("t"), F.col("limit"))
        each = each.withColumns({"own_tn": made["tn"], "own_fn": made["fn"], "gone": F.when(is_low, F.least("a", "value")).otherwise(F.lit(0.0)), "gone_total": F.when(is_low, F.col("a")).otherwise(F.lit(0.0))})
        zero = F.lit(0.0)
        mine = lambda v: F.when(F.col("mine"), v).otherwise(zero)
        # less what counting all attackers as unseen adds already
        terms = {
            "tp": mine(F.col("a") - F.col("own_fn")) - (F.col("gone_total") - F.col("gone")),
            "tn": mine(F.col("own_tn")),
            "fp": mine(F.col("t") - F.col("own_tn")),
            "fn": mine(F.col("own_fn")) - F.col("gone"),
            "total": mine(F.col("a") + F.col("t")) - F.col("gone_total"),
        }
        key = [*PLACE, "window_start", "min_active", "min_pkts_avg", "kind", "value"]
        partial = each.select(*key, *(v.alias(c) for c, v in terms.items())).groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums))
        # one row for each window and pair of minima, with the sums of each limit side by side
        wide = partial.groupBy(*PLACE, "window_start", "min_active", "min_pkts_avg").agg(*(F.expr(f"coalesce(sum(if(kind = '{kind}' AND value = {v!r}D, {c}, 0D)), 0D)").alias(f"{kind}{k}_{c}") for group in (low, above) for k, (kind, v) in enumerate(group) for c in sums))
        grid = alone.select(*PLACE, "total", *(f"fn_{k}" for k in range(len(low)))).withColumnRenamed("total", "alone_total").withColumn("window_start", F.explode(F.sequence(F.lit(1), F.lit(starts))))
        grid = grid.selectExpr("*", f"inline(array({minima}))")
        joined = grid.join(wide, [*PLACE, "window_start", "min_active", "min_pkts_avg"], "left").na.fill(0.0)
        combined = []
        for (i, (_, lv)), (j, (_, av)) in product(enumerate(low), enumerate(above)):
            base = {"tp": f"alone_total - fn_{i} +", "fn": f"fn_{i} +", "total": "alone_total +", "tn": "", "fp": ""}
            combined.append(f"named_struct('low_pass', {int(lv)}, 'above_limit', {av!r}D, " + ", ".join(f"'{c}', {base[c]} low{i}_{c} + above{j}_{c}" for c in sums) + ")")
        done = joined.selectExpr(*PLACE, "window_start", f"{train_length} AS train_length", f"{test_length} AS test_length", "min_active", "min_pkts_avg", f"inline(array({', '.join(combined)}))")
        out = done if out is None else out.unionByName(done)
    if out is None:
        raise ValueError("no window fits into the series")
    return out


def _with_evasion(rows: DataFrame, attack: DataFrame, evasion: DataFrame) -> DataFrame:
    """Evading networks get the largest train traffic of their window, where it has any; own_train keeps the measured one."""
    largest = rows.groupBy(*PLACE, "window_start").agg(F.max("train").alias("largest")).where("largest is not null")
    marked = evasion.select("src_net").distinct().withColumn("evading", F.lit(True))
    # evading networks that were not seen at all get a row too, for each window with train traffic
    evaders = attack.join(marked, "src_net").select(*PLACE, "src_net", "attack").join(largest.select(*PLACE, "window_start"), list(PLACE))
    unseen = evaders.join(rows.select(*PLACE, "window_start", "src_net"), [*PLACE, "window_start", "src_net"], "left_anti")
    every = rows.unionByName(unseen, allowMissingColumns=True).join(marked, "src_net", "left").join(largest, [*PLACE, "window_start"], "left")
    evading = F.coalesce("evading", F.lit(False))
    return every.withColumn("own_train", F.col("train")).withColumn("train", F.when(evading & F.col("largest").isNotNull(), F.col("largest")).otherwise(F.col("train"))).withColumn("evading", evading & F.col("largest").isNotNull()).drop("largest")


def best_train_only(results: DataFrame, best: dict[str, int], otherwise: int = 24) -> DataFrame:
    """Results at each location's best training length only, as evaluations under evasion use them."""
    length = F.lit(otherwise)
    for location, hours in best.items():
        length = F.when(F.col("location") == location, F.lit(hours)).otherwise(length)
    return results.where(F.col("train_length") == length)


def conservation(results: DataFrame) -> DataFrame:
    """Results whose four sums differ from the total by 2 or more and by a billionth or more of it: there should be none."""
    four = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    near = (F.abs(four - F.col("total")) < 2) | (F.abs(F.try_divide(four, F.col("total")) - 1) < 1e-9)
    return results.where(~F.coalesce(near, F.lit(False)))


def seeded_sample(nets: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k networks that stay the same from run to run: those of smallest hash."""
    return nets.select("src_net").distinct().orderBy(F.xxhash64("src_net", F.lit(seed)), "src_net").limit(k)
