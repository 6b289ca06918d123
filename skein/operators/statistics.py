"""Metrics, ranks, differences, resampling and selection over audit rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import written

LN2 = math.log(2)
RANGES = 4096
RESAMPLES = 10_000


def metric_block(df: DataFrame, by: list[str], nll: str = "nll_nats", tokens: str = "tokens", size: str = "utf8_bytes") -> DataFrame:
    """(by, sum_nll_nats, valid_tokens, utf8_bytes, mean_nll, perplexity, bits_per_byte) from sums, never from means of ratios.

    Rows with a null nll are left out; groups without tokens or bytes have null ratios.
    """
    s = df.where(F.col(nll).isNotNull()).groupBy(*by).agg(F.sum(nll).alias("sum_nll_nats"), F.sum(tokens).alias("valid_tokens"), F.sum(size).alias("bytes"))
    mean = F.when(F.col("valid_tokens") > 0, F.col("sum_nll_nats") / F.col("valid_tokens"))
    return s.select(*by, "sum_nll_nats", "valid_tokens", F.col("bytes").alias("utf8_bytes"), mean.alias("mean_nll"), F.exp(mean).alias("perplexity"), F.when(F.col("bytes") > 0, F.col("sum_nll_nats") / LN2 / F.col("bytes")).alias("bits_per_byte"))


def cumulative(df: DataFrame, by: list[str], at: str, values: list[str], ranges: int = RANGES) -> DataFrame:
    """df, one row a (by, at), with below_<value>: the sums over all rows of `by` with a smaller `at`.

    Rows are spread over ranges of (by, at) at sampled bounds, so skewed
    values fill ranges evenly and one large group isn't one task. Whole ranges
    are summed up first, only within a range are rows sorted.
    """
    parts = min(ranges, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = written(df.repartitionByRange(parts, *by, at).withColumn("__r", F.spark_partition_id()))
    per = rows.groupBy(*by, "__r").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    w = Window.partitionBy(*by).orderBy("__r")  # at most one row a range
    before = per.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__r").alias("__q"), *((F.sum(f"__{v}").over(w) - F.col(f"__{v}")).alias(f"__b_{v}") for v in values))
    inner = Window.partitionBy(*by, "__r").orderBy(at)
    same = F.col("__r") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = rows.join(before, same)
    return out.withColumns({f"below_{v}": F.col(f"__b_{v}") + F.sum(v).over(inner) - F.col(v) for v in values}).drop("__r", "__q", *(f"__by_{c}" for c in by), *(f"__b_{v}" for v in values))


def membership_auc(df: DataFrame, by: list[str], score: Column, member: str) -> DataFrame:
    """(by, members, others, auc): the chance that a member scores above another row, ties counting half.

    Rows with a null score or membership are left out; groups with one kind only have a null auc.
    """
    d = df.select(*by, score.cast("double").alias("score"), F.col(member).alias("m")).where("score is not null and m is not null")
    counts = d.groupBy(*by, "score").agg(F.count_if("m").alias("mem"), F.count_if(~F.col("m")).alias("oth"))
    c = cumulative(counts, by, "score", ["oth"])
    s = c.groupBy(*by).agg(F.sum("mem").alias("members"), F.sum("oth").alias("others"), F.sum(F.col("mem") * (F.col("below_oth") + F.col("oth") / 2)).alias("u"))
    return s.select(*by, "members", "others", (F.col("u") / F.nullif(F.col("members") * F.col("others"), F.lit(0))).alias("auc"))


def mid_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, rank): the average rank, from 1, of each distinct value in its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    c = cumulative(counts, by, value, ["n"])
    return c.select(*by, value, "n", (F.col("below_n") + (F.col("n") + 1) / 2).alias("rank"))


def exposure(df: DataFrame, by: list[str], loss: str, inserted: Column, control: Column) -> DataFrame:
    """df's inserted rows with exposure: log2((controls + 1) / (1 + controls with at most its loss)).

    Controls are counted up to every loss by one running sum over both kinds, without a non-equi join.
    """
    rows = df.where(F.col(loss).isNotNull() & (inserted | control)).withColumn("__c", control.cast("long"))
    counts = rows.groupBy(*by, loss).agg(F.sum("__c").alias("c"))
    upto = cumulative(counts, by, loss, ["c"]).select(*by, loss, (F.col("below_c") + F.col("c")).alias("not_above"))
    total = rows.groupBy(*by).agg(F.sum("__c").alias("controls"))
    return rows.where("__c = 0").drop("__c").join(upto, [*by, loss]).join(total, by).withColumn("exposure", F.log2((F.col("controls") + 1) / (1 + F.col("not_above"))))


def paired_benefits(a: DataFrame, b: DataFrame, key: list[str], group: str, value: str, base: str = "Z", unit: str = "C") -> DataFrame:
    """(group, n, benefit, tau): mean drop of the value from a to b, less that of the base group, and its ratio to the unit group's.

    Without the base group benefits are null; tau is null where the unit's benefit is 0 or absent.
    """
    rows = a.select(*key, group, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), key).withColumn("drop", F.col("va") - F.col("vb"))
    means = rows.where(F.col("drop").isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg("drop").alias("mean"))
    scalars = means.agg(F.max(F.when(F.col(group) == base, F.col("mean"))).alias("z"), F.max(F.when(F.col(group) == unit, F.col("mean"))).alias("c"))
    out = means.crossJoin(F.broadcast(scalars))  # one row
    benefit = F.col("mean") - F.col("z")
    return out.where(F.col(group) != base).select(group, "n", benefit.alias("benefit"), (benefit / F.nullif(F.col("c") - F.col("z"), F.lit(0.0))).alias("tau"))


def tau_bootstrap(a: DataFrame, b: DataFrame, key: list[str], group: str, value: str, base: str = "Z", unit: str = "C", resamples: int = RESAMPLES, seed: int = 17012) -> DataFrame:
    """(group, draws, low, high): the interval of tau when rows are resampled within their group; draws without a tau are left out.

    As in bootstrap_sums, every row takes part a Poisson(1) number of times,
    drawn from its own generator, and means are over the rows of a resample.
    """
    rows = a.select(*key, group, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), key)
    keyed = rows.select(F.shiftrightunsigned(F.xxhash64(*(F.col(k).cast("string") for k in key)), 1).alias("__key"), F.col(group).cast("string").alias("g"), (F.col("va") - F.col("vb")).alias("drop")).where("drop is not null and g is not null")

    def run(batches):
        total = {}
        for pdf in batches:
            for k, g, drop in zip(pdf["__key"], pdf["g"], pdf["drop"]):
                t = total.setdefault(g, np.zeros((2, resamples)))
                times = np.random.Generator(np.random.PCG64([seed, int(k)])).poisson(1.0, resamples)
                t[0] += times * drop
                t[1] += times
        for g, t in total.items():
            yield pd.DataFrame({"g": g, "resample": np.arange(resamples), "s": t[0], "n": t[1]})

    means = keyed.mapInPandas(run, "g string, resample long, s double, n double").groupBy("resample", "g").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean"))
    one = F.collect_list(F.struct("g", "mean"))
    pick = lambda name: F.max(F.when(F.col("g") == name, F.col("mean")))
    draws = means.groupBy("resample").agg(one.alias("m"), pick(base).alias("z"), pick(unit).alias("c")).select("z", "c", F.inline("m"))
    tau = draws.where(F.col("g") != base).select(F.col("g").alias(group), ((F.col("mean") - F.col("z")) / F.nullif(F.col("c") - F.col("z"), F.lit(0.0))).alias("tau")).where("tau is not null")
    return tau.groupBy(group).agg(F.count("*").alias("draws"), F.percentile("tau", 0.025).alias("low"), F.percentile("tau", 0.975).alias("high"))


def leave_one_out_slopes(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, slope, predicted, observed): for each group the slope without intercept of the others, and its own means."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    total = s.agg(F.sum("xy").alias("txy"), F.sum("xx").alias("txx"))
    slope = (F.col("txy") - F.col("xy")) / F.nullif(F.col("txx") - F.col("xx"), F.lit(0.0))
    return s.crossJoin(F.broadcast(total)).select(group, slope.alias("slope"), (slope * F.col("mx")).alias("predicted"), F.col("my").alias("observed"))


def calibration_summary(loo: DataFrame) -> DataFrame:
    """(groups, mae, calibration_slope) of leave-one-out predictions; the slope needs two groups."""
    return loo.agg(F.count("*").alias("groups"), F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"), F.regr_slope("observed", "predicted").alias("calibration_slope"))


def weighted_adjustment(df: DataFrame, size: str, similarity: str, factor: float) -> DataFrame:
    """(adjustment): what similarity times factor comes to, weighted by size."""
    return df.agg((F.sum(F.col(size) * F.col(similarity) * factor) / F.nullif(F.sum(size), F.lit(0))).alias("adjustment"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """(by, n, rho): correlation of ranks without ties; equal values are ranked by `tie`, which no two rows of a group share. A null group is one."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.struct(x, tie).alias("__x"), F.struct(y, tie).alias("__y"), F.lit(1).alias("__one"))
    for c in ("__x", "__y"):
        rows = cumulative(rows, by, c, ["__one"]).withColumn(f"r{c}", F.col("below___one").cast("double")).drop("below___one")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("r__x", "r__y").alias("rho"))


def spearman_permutation(df: DataFrame, by: list[str], x: str, y: str, tie: str, resamples: int = RESAMPLES, seed: int = 17012) -> DataFrame:
    """(by, n, rho, p): as spearman, with the share of permutations of y whose rho is at least as great, one added to both counts.

    A group is held by one task, so it is for tables of cells or runs. Fewer than two rows, or no rank to compare, have null rho and p.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__tie")
        rx, ry = (np.argsort(np.argsort(pdf[c].to_numpy(), kind="stable"), kind="stable").astype(float) for c in ("__x", "__y"))
        n = len(rx)
        rho = p = None
        if n > 1:
            rx, ry = rx - rx.mean(), ry - ry.mean()
            scale = np.sqrt((rx @ rx) * (ry @ ry))
            rng = np.random.Generator(np.random.PCG64(seed))
            null = np.array([rx @ rng.permutation(ry) for _ in range(resamples)])
            rho, p = float(rx @ ry / scale), float((np.sum(null >= rx @ ry - 1e-9) + 1) / (resamples + 1))  # ranks are halves: sums are exact
        return pd.DataFrame({**{b: pdf[b].iloc[:1].to_numpy() for b in by}, "n": [n], "rho": [rho], "p": [p]})

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(tie).cast("string").alias("__tie"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}n long, rho double, p double")


def extractability(df: DataFrame, by: list[str], extracted: str) -> DataFrame:
    """(by, eligible, extracted, rate) of given outcomes of greedy decoding; null outcomes (too short to decode) aren't eligible."""
    s = df.groupBy(*by).agg(F.count(extracted).alias("eligible"), F.count_if(F.coalesce(extracted, F.lit(False))).alias("extracted"))
    return s.withColumn("rate", F.col("extracted") / F.nullif("eligible", F.lit(0)))


def lower_percentile(sorted_values: Column, share: float) -> Column:
    """The value at the floor of share * (n - 1) of a sorted array."""
    return F.get(sorted_values, F.floor(F.lit(share) * (F.size(sorted_values) - 1)).cast("int"))


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 17012) -> DataFrame:
    """(n, mean, low, high): the mean of the value and the draws at the floor of share * (resamples - 1) in order.

    Rows are units of their own; null values are left out. Draws as in bootstrap_sums.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("__v"), F.lit(1.0).alias("__one"))
    draws = bootstrap_sums(rows, key, ["__v", "__one"], resamples, seed).select((F.col("__v") / F.nullif("__one", F.lit(0.0))).alias("m"))
    ends = draws.agg(F.sort_array(F.collect_list("m")).alias("s"))  # one number a resample
    return rows.agg(F.count("*").alias("n"), F.avg("__v").alias("mean")).crossJoin(ends.select(lower_percentile(F.col("s"), low).alias("low"), lower_percentile(F.col("s"), high).alias("high")))


def bootstrap_sums(df: DataFrame, cluster: str, values: list[str], resamples: int = RESAMPLES, seed: int = 17012) -> DataFrame:
    """(resample, <values>): weighted sums over clusters for every resample.

    Rows are summed per cluster first. Every cluster then takes part in every
    resample a Poisson(1) number of times, drawn from its own generator seeded
    by the cluster's key: the limit of drawing clusters with replacement,
    which needs no table of draws, whatever the number of clusters. One set
    of draws serves all columns.
    """
    sums = df.groupBy(cluster).agg(*(F.sum(v).cast("double").alias(v) for v in values)).na.fill(0.0, values)

    def run(batches):
        total = np.zeros((resamples, len(values)))
        for pdf in batches:
            for key, row in zip(pdf["__key"], pdf[values].to_numpy()):
                total += np.random.Generator(np.random.PCG64([seed, int(key)])).poisson(1.0, resamples)[:, None] * row
        yield pd.DataFrame({"resample": np.arange(resamples), **{v: total[:, i] for i, v in enumerate(values)}})

    keyed = sums.select(F.shiftrightunsigned(F.xxhash64(F.col(cluster).cast("string")), 1).alias("__key"), *values)
    parts = keyed.mapInPandas(run, "resample long, " + ", ".join(f"{v} double" for v in values))
    return parts.groupBy("resample").agg(*(F.sum(v).alias(v) for v in values))


def interval(draws: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high): linear quantiles of the draws."""
    return draws.agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))


def one_sided_p(draws: DataFrame, value: str, threshold: float, above: bool = True) -> DataFrame:
    """(p): the share of draws on the wrong side of the threshold, with one added to both counts."""
    wrong = F.col(value) <= threshold if above else F.col(value) >= threshold
    return draws.agg(((F.count_if(wrong) + 1) / (F.count("*") + 1)).alias("p"))


def holm_and_bh(df: DataFrame, name: str, p: str, alpha: float = 0.05, q: float = 0.10) -> DataFrame:
    """(name, p, holm, bh): step-down and step-up rejections of a family of tests, ties by name."""
    w = Window.orderBy(p, name)  # a family of tests
    rows = df.select(name, p, F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("m"))
    ok = rows.withColumn("h", F.min((F.col(p) <= F.lit(alpha) / (F.col("m") - F.col("r") + 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.max(F.when(F.col(p) <= F.lit(q) * F.col("r") / F.col("m"), F.col("r"))).over(Window.partitionBy())
    return ok.select(name, p, (F.col("h") == 1).alias("holm"), (F.col("r") <= F.coalesce(cut, F.lit(0))).alias("bh"))


def pareto_frontier(df: DataFrame, name: str, costs: list[str]) -> DataFrame:
    """Rows that no other beats: none is at most as dear in all costs and cheaper in one. For small tables of candidates."""
    o = df.select(F.col(name).alias("__name"), *(F.col(c).alias(f"__cost_{c}") for c in costs))
    no_worse = [F.col(f"__cost_{c}") <= F.col(c) for c in costs]
    better = [F.col(f"__cost_{c}") < F.col(c) for c in costs]
    some = better[0]
    for b in better[1:]:
        some = some | b
    rule = some
    for n in no_worse:
        rule = rule & n
    return df.join(F.broadcast(o) if df.limit(10_001).count() <= 10_000 else o, rule, "left_anti")


def best_with_tie(df: DataFrame, by: list[str], cost: str, prefer: str, within: float = 0.01) -> DataFrame:
    """Per group the row of least `prefer` among those whose cost is less than `within` above the best."""
    w = Window.partitionBy(*by)
    close = df.withColumn("__best", F.min(cost).over(w)).where((F.col(cost) - F.col("__best")) / F.col("__best") < within)
    return close.withColumn("__r", F.row_number().over(w.orderBy(prefer, cost))).where("__r = 1").drop("__r", "__best")


def saturation_point(df: DataFrame, by: list[str], level: str, cost: str, least_gain: float = 0.01) -> DataFrame:
    """(by, level): the first level whose doubling gains less than least_gain; null if every doubling gains more."""
    nxt = df.select(*by, (F.col(level) / 2).alias(level), F.col(cost).alias("__next"))
    gains = df.join(nxt, [*by, level], "left").withColumn("__g", (F.col(cost) - F.col("__next")) / F.col(cost))
    return gains.groupBy(*by).agg(F.min(F.when(F.col("__g") < least_gain, F.col(level))).alias(level))


def is_monotonic(df: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """(by, monotonic): whether the value never rises from one level to the next."""
    w = Window.partitionBy(*by).orderBy(level)
    return df.withColumn("__p", F.lag(value).over(w)).groupBy(*by).agg(F.bool_and(F.col("__p").isNull() | (F.col(value) <= F.col("__p"))).alias("monotonic"))


def nearest_scale(df: DataFrame, value: Column, scenarios: dict[str, float]) -> DataFrame:
    """df with scenario: the one whose size is nearest on a log scale, ties by name."""
    ranked = F.array_min(F.array(*(F.struct(F.abs(F.log(value) - F.lit(math.log(v))).alias("d"), F.lit(n).alias("n")) for n, v in sorted(scenarios.items()))))
    return df.withColumn("scenario", ranked["n"])


def schedule(steps: DataFrame, step: str, kind: str, total: int, warmup: int, decay_start: int = 0, floor: float = 0.1) -> DataFrame:
    """steps with multiplier: warm-up then constant, cosine, or flat with a square-root decay (wsd)."""
    s = F.col(step)
    up = (s + 1) / F.lit(float(max(1, warmup)))
    part = lambda start: F.least(F.lit(1.0), (s - start) / F.lit(float(max(1, total - start))))
    if kind == "constant":
        value = F.lit(1.0)
    elif kind == "cosine":
        value = F.when(s < warmup, up).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * part(warmup))))
    elif kind == "wsd":
        value = F.when(s < warmup, up).when(s < decay_start, 1.0).otherwise(floor + (1 - floor) * (1 - F.sqrt(part(decay_start))))
    else:
        raise ValueError(f"unknown schedule {kind}")
    return steps.withColumn("multiplier", value)


def experiment_plan(sizes: DataFrame, passes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(size, passes, seed, name): every run of three small configuration tables."""
    return sizes.crossJoin(passes).crossJoin(seeds).withColumn("name", F.format_string("m0-%s-e%d-s%d", "size", "passes", "seed"))
