"""Queries over audit rows: metrics, ranks, differences, intervals and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalogue import RECORDS_SQL, query
from skein.operators import statistics as ST
from skein.operators.latest import latest_per_key
from skein.sources.manifest import records
from skein.sources.tables import table
from skein.storage import written

S, D = SparkSession, DataFrame
ROWS_SQL = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY audit_row_id ORDER BY audited_at DESC NULLS LAST, nll_nats DESC NULLS LAST, bpb DESC NULLS LAST) AS rn FROM audit_documents WHERE audit_row_id IS NOT NULL) WHERE rn = 1), u AS (SELECT *, regexp_extract(run_name, '^(m[01])_', 1) AS arm, regexp_extract(run_name, '^m[01]_(.*)$', 1) AS pair, regexp_extract(run_name, '_([0-9]+m)_', 1) AS size, regexp_extract(run_name, '_p([0-9]+)_', 1)::BIGINT AS passes FROM a)"


def audits(spark: S, sf: str) -> D:
    """Audit rows, each once: the latest delivery."""
    rows = table(spark, sf, "audit_documents")
    rows = latest_per_key(rows, "audit_row_id", F.col("audited_at").desc_nulls_last(), F.col("nll_nats").desc_nulls_last(), F.col("bpb").desc_nulls_last())
    part = lambda p: F.regexp_extract("run_name", p, 1)
    return rows.withColumns({"arm": part("^(m[01])_"), "pair": part("^m[01]_(.*)$"), "size": part("_([0-9]+m)_"), "passes": part("_p([0-9]+)_").cast("long")})


@query(f"WITH {ROWS_SQL}, s AS (SELECT run_name, sum(nll_nats) AS nll, sum(tokens) AS t, sum(utf8_bytes) AS b FROM u WHERE nll_nats IS NOT NULL GROUP BY run_name) SELECT run_name, round(nll, 3) AS sum_nll_nats, t::BIGINT AS valid_tokens, b::BIGINT AS utf8_bytes, round(nll / t, 6) AS mean_nll, round(exp(nll / t), 4) AS perplexity, round(nll / ln(2) / b, 6) AS bits_per_byte FROM s")
def run_metric_block(spark: S, sf: str) -> D:
    m = ST.metric_block(audits(spark, sf), ["run_name"])
    return m.select("run_name", F.round("sum_nll_nats", 3).alias("sum_nll_nats"), "valid_tokens", "utf8_bytes", F.round("mean_nll", 6).alias("mean_nll"), F.round("perplexity", 4).alias("perplexity"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query(f"WITH {ROWS_SQL}, {RECORDS_SQL} SELECT r.source, round(sum(nll_nats) / ln(2) / sum(utf8_bytes), 6) AS pooled_bpb, count(*) AS rows FROM u JOIN rec r USING (document_id) WHERE nll_nats IS NOT NULL GROUP BY r.source")
def pooled_bpb_by_source(spark: S, sf: str) -> D:
    rows = audits(spark, sf).where("nll_nats is not null").join(records(spark, sf, "source"), "document_id")
    return rows.groupBy("source").agg(F.round(F.sum("nll_nats") / ST.LN2 / F.sum("utf8_bytes"), 6).alias("pooled_bpb"), F.count("*").alias("rows"))


@query(f"WITH {ROWS_SQL}, d AS (SELECT run_name, -bpb AS s, is_member AS m FROM u WHERE bpb IS NOT NULL AND is_member IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY run_name ORDER BY s) + (count(*) OVER (PARTITION BY run_name, s) - 1) / 2.0 AS rk FROM d), g AS (SELECT run_name, count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n0, sum(rk) FILTER (m) AS w FROM r GROUP BY run_name) SELECT run_name, n1 AS members, n0 AS others, round((w - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0), 6) AS auc FROM g")
def membership_auc(spark: S, sf: str) -> D:
    return ST.membership_auc(audits(spark, sf), ["run_name"], -F.col("bpb"), "is_member").withColumn("auc", F.round("auc", 6))


@query(f"WITH {ROWS_SQL}, d AS (SELECT run_name, bpb FROM u WHERE bpb IS NOT NULL), r AS (SELECT run_name, bpb, rank() OVER (PARTITION BY run_name ORDER BY bpb) + (count(*) OVER (PARTITION BY run_name, bpb) - 1) / 2.0 AS rk FROM d) SELECT run_name, round(bpb, 6) AS bpb, count(*) AS n, max(rk) AS rank FROM r GROUP BY run_name, r.bpb")
def bpb_mid_ranks(spark: S, sf: str) -> D:
    return ST.mid_ranks(audits(spark, sf), ["run_name"], "bpb").withColumn("bpb", F.round("bpb", 6))


@query(f"WITH {ROWS_SQL}, i AS (SELECT * FROM u WHERE bpb IS NOT NULL AND is_member AND probe_group IS NOT NULL AND probe_group <> 'Z'), z AS (SELECT size, bpb FROM u WHERE bpb IS NOT NULL AND probe_group = 'Z') SELECT size, audit_row_id, round(log2(((SELECT count(*) FROM z WHERE z.size = i.size) + 1)::DOUBLE / (1 + (SELECT count(*) FROM z WHERE z.size = i.size AND z.bpb <= i.bpb))), 6) AS exposure FROM i WHERE EXISTS (SELECT 1 FROM z WHERE z.size = i.size)")
def exposure_bits(spark: S, sf: str) -> D:
    """Exposure of probed members against untouched controls of the same size."""
    control = F.coalesce(F.col("probe_group") == "Z", F.lit(False))
    inserted = F.coalesce(F.col("is_member"), F.lit(False)) & F.col("probe_group").isNotNull() & ~control
    e = ST.exposure(audits(spark, sf), ["size"], "bpb", inserted, control)
    return e.where("controls > 0").select("size", "audit_row_id", F.round("exposure", 6).alias("exposure"))




@query(f"WITH {ROWS_SQL}, m0 AS (SELECT document_id, probe_group, avg(bpb) AS v FROM u WHERE arm = 'm0' AND probe_group IS NOT NULL GROUP BY ALL), m1 AS (SELECT document_id, avg(bpb) AS v FROM u WHERE arm = 'm1' GROUP BY ALL), g AS (SELECT probe_group, count(*) AS n, avg(m0.v - m1.v) AS mean FROM m0 JOIN m1 USING (document_id) WHERE m0.v - m1.v IS NOT NULL GROUP BY probe_group), s AS (SELECT max(mean) FILTER (probe_group = 'Z') AS z, max(mean) FILTER (probe_group = 'C') AS c FROM g) SELECT probe_group, n, round(mean - z, 6) AS benefit, round((mean - z) / nullif(c - z, 0), 6) AS tau FROM g, s WHERE probe_group <> 'Z'")
def did_benefit(spark: S, sf: str) -> D:
    """Mean drop from the first to the second arm per probe group, less that of the untouched group."""
    u = audits(spark, sf)
    a = u.where("arm = 'm0' and probe_group is not null").groupBy("document_id", "probe_group").agg(F.avg("bpb").alias("v"))
    b = u.where("arm = 'm1'").groupBy("document_id").agg(F.avg("bpb").alias("v"))
    d = ST.paired_benefits(a, b, ["document_id"], "probe_group", "v")
    return d.select("probe_group", "n", F.round("benefit", 6).alias("benefit"), F.round("tau", 6).alias("tau"))


@query()
def tau_intervals(spark: S, sf: str) -> D:
    """Interval of each probe group's tau, documents resampled within groups."""
    u = audits(spark, sf)
    a = u.where("arm = 'm0' and probe_group is not null").groupBy("document_id", "probe_group").agg(F.avg("bpb").alias("v"))
    b = u.where("arm = 'm1'").groupBy("document_id").agg(F.avg("bpb").alias("v"))
    t = ST.tau_bootstrap(a, b, ["document_id"], "probe_group", "v")
    return t.select("probe_group", "draws", *(F.round(c, 6).alias(c) for c in ("low", "high")))


@query(f"WITH {ROWS_SQL}, {RECORDS_SQL} SELECT coalesce(nullif(lower(regexp_extract(r.dedup_cluster_id, '[0-9a-fA-F]{{16}}')), ''), u.document_id) AS cluster, round(sum(nll_nats), 3) AS nll, sum(utf8_bytes)::BIGINT AS bytes FROM u JOIN rec r USING (document_id) WHERE nll_nats IS NOT NULL GROUP BY 1")
def cluster_sums(spark: S, sf: str) -> D:
    rows = _clustered(spark, sf)
    return rows.groupBy("cluster").agg(F.round(F.sum("nll_nats"), 3).alias("nll"), F.sum("utf8_bytes").alias("bytes"))


def _clustered(spark: S, sf: str) -> D:
    c = F.coalesce(F.nullif(F.lower(F.regexp_extract("dedup_cluster_id", "([0-9a-fA-F]{16})", 1)), F.lit("")), F.col("document_id")).alias("cluster")
    return audits(spark, sf).where("nll_nats is not null").join(records(spark, sf, "dedup_cluster_id"), "document_id").select("*", c)


@query()
def cluster_bootstrap_gain(spark: S, sf: str) -> D:
    """Relative gain in pooled bits per byte of the second arm over the first: interval and one-sided p over clusters."""
    rows = _clustered(spark, sf).withColumns({f"{v}_{m}": F.when(F.col("arm") == m, F.col(c)).otherwise(0.0) for m in ("m0", "m1") for v, c in (("nll", "nll_nats"), ("size", "utf8_bytes"))})
    draws = written(ST.bootstrap_sums(rows, "cluster", ["nll_m0", "size_m0", "nll_m1", "size_m1"]))
    gain = draws.withColumn("gain", 1 - (F.col("nll_m1") / F.col("size_m1")) / (F.col("nll_m0") / F.col("size_m0")))
    return ST.interval(gain, "gain").crossJoin(ST.one_sided_p(gain, "gain", 0.0)).select(*(F.round(c, 6).alias(c) for c in ("low", "high", "p")))


@query(f"WITH {ROWS_SQL}, g AS (SELECT run_name, 1.0 / (1 + count(*) FILTER (bpb < 1.0)) AS p FROM u GROUP BY run_name), r AS (SELECT *, row_number() OVER (ORDER BY p, run_name) AS k, count(*) OVER () AS m FROM g), h AS (SELECT *, min(CASE WHEN p <= 0.05 / (m - k + 1) THEN 1 ELSE 0 END) OVER (ORDER BY p, run_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok, max(k) FILTER (p <= 0.10 * k / m) OVER () AS cut FROM r) SELECT run_name, round(p, 6) AS p, ok = 1 AS holm, k <= coalesce(cut, 0) AS bh FROM h")
def holm_and_bh(spark: S, sf: str) -> D:
    """Multiplicity control over one p-value a run."""
    g = audits(spark, sf).groupBy("run_name").agg((F.lit(1.0) / (1 + F.count_if(F.col("bpb") < 1.0))).alias("p"))
    return ST.holm_and_bh(g, "run_name", "p").withColumn("p", F.round("p", 6))


_RUNS = "runs AS (SELECT run_name, size, passes, sum(nll_nats) / ln(2) / sum(utf8_bytes) AS bpb, avg(tokens / nullif(utf8_bytes, 0)) AS tpb, count(*) AS n FROM u WHERE nll_nats IS NOT NULL GROUP BY ALL)"


def _runs(spark: S, sf: str) -> D:
    u = audits(spark, sf).where("nll_nats is not null")
    return written(u.groupBy("run_name", "size", "passes").agg((F.sum("nll_nats") / F.log(F.lit(2.0)) / F.sum("utf8_bytes")).alias("bpb"), F.avg(F.col("tokens") / F.nullif("utf8_bytes", F.lit(0))).alias("tpb"), F.count("*").alias("n")))


@query(f"WITH {ROWS_SQL}, {_RUNS}, k AS (SELECT run_name, round(bpb, 6) AS bpb, round(tpb, 6) AS tpb, n FROM runs) SELECT run_name FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.bpb <= a.bpb AND b.tpb <= a.tpb AND b.n <= a.n AND (b.bpb < a.bpb OR b.tpb < a.tpb OR b.n < a.n))")
def pareto_runs(spark: S, sf: str) -> D:
    rows = _runs(spark, sf).select("run_name", F.round("bpb", 6).alias("bpb"), F.round("tpb", 6).alias("tpb"), "n")
    return ST.pareto_frontier(rows, "run_name", ["bpb", "tpb", "n"]).select("run_name")


@query(f"WITH {ROWS_SQL}, {_RUNS}, c AS (SELECT *, min(bpb) OVER (PARTITION BY size) AS best FROM runs) SELECT size, arg_min(run_name, (passes, bpb)) AS run_name FROM c WHERE (bpb - best) / best < 0.01 GROUP BY size")
def best_run_with_tie(spark: S, sf: str) -> D:
    """The run of fewest passes among those within one percent of the best of its size."""
    return ST.best_with_tie(_runs(spark, sf), ["size"], "bpb", "passes").select("size", "run_name")


_LEVELS = "lv AS (SELECT size, passes, sum(nll_nats) / ln(2) / sum(utf8_bytes) AS bpb FROM u WHERE nll_nats IS NOT NULL AND arm = 'm1' GROUP BY ALL)"


def _levels(spark: S, sf: str) -> D:
    u = audits(spark, sf).where("nll_nats is not null and arm = 'm1'")
    return written(u.groupBy("size", "passes").agg((F.sum("nll_nats") / F.log(F.lit(2.0)) / F.sum("utf8_bytes")).alias("bpb")))


@query(f"WITH {ROWS_SQL}, {_LEVELS} SELECT a.size, min(a.passes) FILTER ((a.bpb - b.bpb) / a.bpb < 0.01) AS passes FROM lv a LEFT JOIN lv b ON a.size = b.size AND b.passes = 2 * a.passes GROUP BY a.size")
def saturation_passes(spark: S, sf: str) -> D:
    """The first number of passes whose doubling gains less than one percent."""
    s = ST.saturation_point(_levels(spark, sf).withColumn("passes", F.col("passes").cast("double")), ["size"], "passes", "bpb")
    return s.withColumn("passes", F.col("passes").cast("long"))


@query(f"WITH {ROWS_SQL}, {_LEVELS}, w AS (SELECT size, bpb, lag(bpb) OVER (PARTITION BY size ORDER BY passes) AS p FROM lv) SELECT size, bool_and(p IS NULL OR bpb <= p) AS monotonic FROM w GROUP BY size")
def monotonic_in_passes(spark: S, sf: str) -> D:
    return ST.is_monotonic(_levels(spark, sf), ["size"], "passes", "bpb")


@query(f"WITH {ROWS_SQL}, d AS (SELECT size, row_number() OVER (PARTITION BY size ORDER BY tokens, audit_row_id) AS rx, row_number() OVER (PARTITION BY size ORDER BY bpb, audit_row_id) AS ry FROM u WHERE tokens IS NOT NULL AND bpb IS NOT NULL) SELECT size, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM d GROUP BY size")
def spearman_tokens_bpb(spark: S, sf: str) -> D:
    return ST.spearman(audits(spark, sf), ["size"], "tokens", "bpb", "audit_row_id").withColumn("rho", F.round("rho", 6))


@query()
def spearman_passes_bpb(spark: S, sf: str) -> D:
    """Rank correlation of passes and bits per byte over the runs of a size, with its permutation p."""
    s = ST.spearman_permutation(_runs(spark, sf), ["size"], "passes", "bpb", "run_name")
    return s.select("size", "n", *(F.round(c, 6).alias(c) for c in ("rho", "p")))


_X = "CASE probe_group WHEN 'C' THEN 1.0 WHEN 'B90' THEN 0.9 WHEN 'B80' THEN 0.8 WHEN 'B65' THEN 0.65 WHEN 'B50' THEN 0.5 END"


@query(f"WITH {ROWS_SQL}, d AS (SELECT probe_group AS g, {_X} AS x, bpb AS y FROM u WHERE probe_group IS NOT NULL), s AS (SELECT g, sum(x * y) AS xy, sum(x * x) AS xx, avg(x) AS mx, avg(y) AS my FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY g), t AS (SELECT sum(xy) AS txy, sum(xx) AS txx FROM s) SELECT g AS probe_group, round((txy - xy) / nullif(txx - xx, 0), 6) AS slope, round((txy - xy) / nullif(txx - xx, 0) * mx, 6) AS predicted, round(my, 6) AS observed FROM s, t")
def leave_one_group_out(spark: S, sf: str) -> D:
    x = F.create_map(*(F.lit(v) for kv in {"C": 1.0, "B90": 0.9, "B80": 0.8, "B65": 0.65, "B50": 0.5}.items() for v in kv))
    rows = audits(spark, sf).where("probe_group is not null").select("probe_group", F.try_element_at(x, F.col("probe_group")).alias("x"), F.col("bpb").alias("y"))
    out = ST.leave_one_out_slopes(rows, "probe_group", "x", "y")
    return out.select("probe_group", *(F.round(c, 6).alias(c) for c in ("slope", "predicted", "observed")))


@query(f"WITH {ROWS_SQL} SELECT round(sum(utf8_bytes * {_X} * 0.02) / nullif(sum(utf8_bytes), 0), 6) AS adjustment FROM u WHERE {_X} IS NOT NULL")
def leak_adjustment(spark: S, sf: str) -> D:
    x = F.create_map(*(F.lit(v) for kv in {"C": 1.0, "B90": 0.9, "B80": 0.8, "B65": 0.65, "B50": 0.5}.items() for v in kv))
    rows = audits(spark, sf).where("probe_group is not null").withColumn("x", F.try_element_at(x, F.col("probe_group"))).where("x is not null")
    return ST.weighted_adjustment(rows, "utf8_bytes", "x", 0.02).select(F.round("adjustment", 6).alias("adjustment"))


@query(f"WITH {ROWS_SQL} SELECT run_name, count(*) AS n, arg_min(s, (d, s)) AS scenario FROM (SELECT run_name, max(t) AS t0, unnest([1000, 10000, 100000]) AS k FROM (SELECT run_name, sum(tokens) AS t FROM u GROUP BY run_name) GROUP BY run_name), LATERAL (SELECT abs(ln(t0::DOUBLE) - ln(k::DOUBLE)) AS d, CASE k WHEN 1000 THEN 'a_small' WHEN 10000 THEN 'b_medium' ELSE 'c_large' END AS s) GROUP BY run_name")
def nearest_scenario(spark: S, sf: str) -> D:
    """The size scenario nearest to each run's tokens on a log scale."""
    t = audits(spark, sf).groupBy("run_name").agg(F.sum("tokens").alias("t"))
    return ST.nearest_scale(t, F.col("t").cast("double"), {"a_small": 1000.0, "b_medium": 10000.0, "c_large": 100000.0}).select("run_name", F.lit(3).cast("long").alias("n"), "scenario")


@query(f"WITH {ROWS_SQL}, o AS (SELECT run_name, CASE WHEN tokens >= 96 THEN bpb < 1.0 END AS got FROM u WHERE is_member) SELECT run_name, count(got) AS eligible, count(*) FILTER (got) AS extracted, round(count(*) FILTER (got)::DOUBLE / nullif(count(got), 0), 6) AS rate FROM o GROUP BY run_name")
def extractability_rate(spark: S, sf: str) -> D:
    """Members of 96 tokens and more that cost less than one bit a byte: stands for outcomes of decoding, which the table doesn't have."""
    rows = audits(spark, sf).where("is_member").select("run_name", F.when(F.col("tokens") >= 96, F.col("bpb") < 1.0).alias("got"))
    return ST.extractability(rows, ["run_name"], "got").withColumn("rate", F.round("rate", 6))


@query()
def mean_bpb_interval(spark: S, sf: str) -> D:
    """Mean bits per byte of the audit rows, and its interval by resampling rows."""
    m = ST.bootstrap_mean(audits(spark, sf), "audit_row_id", "bpb")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"WITH {ROWS_SQL}, d AS (SELECT probe_group AS g, {_X} AS x, bpb AS y FROM u WHERE probe_group IS NOT NULL), s AS (SELECT g, sum(x * y) AS xy, sum(x * x) AS xx, avg(x) AS mx, avg(y) AS my FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY g), t AS (SELECT sum(xy) AS txy, sum(xx) AS txx FROM s), l AS (SELECT round((txy - xy) / nullif(txx - xx, 0) * mx, 6) AS predicted, round(my, 6) AS observed FROM s, t) SELECT count(*) AS groups, round(avg(abs(predicted - observed)), 6) AS mae, round(regr_slope(observed, predicted), 6) AS calibration_slope FROM l")
def calibrated_leakage(spark: S, sf: str) -> D:
    """How well the slope of the other groups predicts each group: mean error and slope of observed on predicted."""
    c = ST.calibration_summary(leave_one_group_out(spark, sf))
    return c.select("groups", *(F.round(x, 6).alias(x) for x in ("mae", "calibration_slope")))
