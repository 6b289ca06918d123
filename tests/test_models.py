"""Count-based models and statistics against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.functions import tokens as K
from skein.operators import ngrams, sweep
from skein.operators import statistics as ST


def documents(seed, n, v=12):
    rng = random.Random(seed)
    return [(f"d{i}", [f"t{(j * j + rng.randrange(4)) % v}" for j in range(rng.randrange(0, 60))]) for i in range(n)]


def kneser_ney(train, order, v):
    """Probability of a token after a history, by the definition."""
    raw = {n: Counter(tuple(t[i : i + n]) for _, t in train for i in range(len(t) - n + 1)) for n in range(1, order + 2)}
    tables = {}
    for n in range(1, order + 1):
        c = raw[n] if n == order else Counter(g[1:] for g in raw[n + 1])
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        total, types = defaultdict(int), defaultdict(int)
        for g, x in c.items():
            total[g[:-1]] += x
            types[g[:-1]] += 1
        tables[n] = c, total, types, ones / (ones + 2 * twos) if ones else 0.5

    def p(history, token):
        out = 1 / v
        for n, (c, total, types, d) in tables.items():
            ctx = tuple(history[len(history) - n + 1 :]) if n > 1 else ()
            if len(ctx) == n - 1 and len(history) >= n - 1 and ctx in total:
                out = max(c[(*ctx, token)] - d, 0) / total[ctx] + d * types[ctx] / total[ctx] * out
        return out

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(spark, order):
    train, held = documents(1, 40), documents(2, 12, 15)
    a, b = (spark.createDataFrame(x, "id string, t array<string>") for x in (train, held))
    p = kneser_ney(train, order, 20)
    got = {r.id: r for r in ngrams.kneser_ney_scores(b, "id", "t", ngrams.kneser_ney_tables(a, "t", order), 20).collect()}
    for i, t in held:
        if len(t) < 2:
            assert i not in got
            continue
        want = sum(-math.log(p(t[max(0, k - order + 1) : k], t[k])) for k in range(1, len(t)))
        assert got[i].nll == pytest.approx(want) and got[i].targets == len(t) - 1
    vocabulary = [f"t{i}" for i in range(12)]
    assert sum(p(["t0", "t1"], w) for w in vocabulary) <= 1 + 1e-9


def test_add_k(spark):
    train, held = documents(3, 20), documents(4, 6)
    joint, total = Counter(), Counter()
    for _, t in train:
        for i, w in enumerate(t):
            c = tuple(t[max(0, i - 2) : i])
            joint[(*c, w)] += 1
            total[c] += 1
    a, b = (spark.createDataFrame(x, "id string, t array<string>") for x in (train, held))
    got = {r.id: r.nll for r in ngrams.add_k_scores(a, b, "id", "t", 3, 12, 0.1).collect()}
    for i, t in held:
        if len(t) > 1:
            want = sum(-math.log((joint[(*t[max(0, k - 2) : k], t[k])] + 0.1) / (total[tuple(t[max(0, k - 2) : k])] + 1.2)) for k in range(1, len(t)))
            assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("orders, named, chunk, hot", [([3, 4, 5, 6], 5, 100, 2), ([2, 4], 0, 1 << 20, 0), ([2, 5], 15, 300, 15), ([2], 6, 300, 3)])
def test_order_sweep(spark, monkeypatch, orders, named, chunk, hot):
    monkeypatch.setattr(sweep, "CHUNK", chunk)
    train, held = documents(1, 40), documents(2, 12, 15)
    df = spark.createDataFrame([(True, t) for _, t in train] + [(False, t) for _, t in held] + [(True, None)], "training boolean, w array<string>")
    coded = sweep.word_codes(df, "w", [f"t{i}" for i in range(named)]).where("low is not null")
    got = {r.order: r for r in sweep.order_sweep(coded, orders, 20, hot).collect()}
    assert sorted(got) == orders
    for n in orders:
        p = kneser_ney(train, n, 20)
        want = sum(-math.log(p(t[max(0, k - n + 1) : k], t[k])) for _, t in held for k in range(1, len(t)))
        assert got[n].nll == pytest.approx(want) and got[n].targets == sum(max(0, len(t) - 1) for _, t in held)


def test_order_sweep_without_training_or_held_out_documents(spark):
    coded = sweep.word_codes(spark.createDataFrame([(False, ["a", "b", "a"])], "training boolean, w array<string>"), "w", ["a"])
    assert [(r.order, r.targets, round(r.nll, 6)) for r in sweep.order_sweep(coded, [3, 4], 20).collect()] == [(n, 2, round(2 * math.log(20), 6)) for n in (3, 4)]
    assert [tuple(r) for r in sweep.order_sweep(coded.where("training"), [3], 20).collect()] == [(3, None, None)]


def test_metric_block(spark):
    df = spark.createDataFrame([("a", math.log(2) * 2, 1, 8), ("a", None, 5, 5), ("b", 1.0, 0, 0)], "g string, nll_nats double, tokens long, utf8_bytes long")
    got = {r.g: r for r in ST.metric_block(df, ["g"]).collect()}
    assert got["a"].bits_per_byte == pytest.approx(0.25) and got["a"].perplexity == pytest.approx(4) and got["b"].mean_nll is None and got["b"].bits_per_byte is None


def test_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [("r", rng.randrange(9) / 4, rng.random() < 0.4) for _ in range(200)] + [("tie", 1.0, True), ("tie", 1.0, False), ("one", 1.0, True), ("r", None, True), ("r", 1.0, None)]
    got = {r.g: r.auc for r in ST.membership_auc(spark.createDataFrame(rows, "g string, s double, m boolean"), ["g"], F.col("s"), "m").collect()}
    mem, oth = ([s for g, s, m in rows if g == "r" and s is not None and m is x] for x in (True, False))
    want = sum((a > b) + (a == b) / 2 for a in mem for b in oth) / len(mem) / len(oth)
    assert got["r"] == pytest.approx(want) and got["tie"] == 0.5 and got["one"] is None


def test_exposure(spark):
    rows = [("g", float(i), "c") for i in range(1, 100)] + [("g", 0.5, "low"), ("g", 1000.0, "high")]
    df = spark.createDataFrame(rows, "g string, loss double, kind string")
    got = {r.kind: r.exposure for r in ST.exposure(df, ["g"], "loss", F.col("kind") != "c", F.col("kind") == "c").collect()}
    assert got["low"] == pytest.approx(math.log2(100)) and got["high"] == pytest.approx(0)


def test_paired_benefits(spark):
    a = spark.createDataFrame([("z", "Z", 1.0), ("c", "C", 1.0), ("b", "B", 1.0)], "k string, g string, v double")
    b = spark.createDataFrame([("z", 0.9), ("c", 0.5), ("b", 0.7)], "k string, v double")
    got = {r.g: (round(r.benefit, 9), round(r.tau, 9)) for r in ST.paired_benefits(a, b, ["k"], "g", "v").collect()}
    assert got == {"C": (0.4, 1.0), "B": (0.2, 0.5)}


def test_holm_and_bh(spark):
    ps = {"a": 0.001, "b": 0.02, "c": 0.03, "d": 0.2}
    got = {r.n: (r.holm, r.bh) for r in ST.holm_and_bh(spark.createDataFrame(list(ps.items()), "n string, p double"), "n", "p").collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, True), "d": (False, False)}


def test_pareto_ties_and_levels(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 2), ("c", 2, 3), ("d", 2, 2), ("n", 9, 1)], "name string, n int, m int")
    assert {r.name for r in ST.pareto_frontier(df, "name", ["n", "m"]).collect()} == {"a", "b", "d", "n"}
    runs = spark.createDataFrame([("s", 0.1, 1.0), ("s", 0.01, 1.005), ("s", 0.001, 1.2)], "size string, lr double, cost double")
    assert ST.best_with_tie(runs, ["size"], "cost", "lr").first().lr == 0.01
    lv = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, 1.5), ("s", 4.0, 1.49), ("s", 8.0, 1.6)], "size string, p double, v double")
    assert ST.saturation_point(lv, ["size"], "p", "v").first().p == 2.0
    assert ST.is_monotonic(lv, ["size"], "p", "v").first().monotonic is False


def test_bootstrap(spark):
    rng = random.Random(6)
    rows = [(f"c{i % 80}", rng.gauss(1, 0.3), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, v double, n double")
    draws = ST.bootstrap_sums(df, "c", ["v", "n"], 400).withColumn("mean", F.col("v") / F.col("n"))
    r = ST.interval(draws, "mean").first()
    mean = sum(x[1] for x in rows) / 400
    assert draws.count() == 400 and r.low < mean < r.high and r.high - r.low < 0.12
    again = ST.bootstrap_sums(df.repartition(7), "c", ["v", "n"], 400).agg(F.sum("v")).first()[0]
    assert again == pytest.approx(draws.agg(F.sum("v")).first()[0])
    assert ST.one_sided_p(draws, "mean", 0.0).first().p == pytest.approx(1 / 401)


def test_slopes_and_ranks(spark):
    rows = [("a", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 3.0, 6.0), ("c", None, 1.0)]
    loo = ST.leave_one_out_slopes(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y")
    assert all(r.slope == pytest.approx(2) for r in loo.collect()) and ST.calibration_summary(loo).first().mae == pytest.approx(0)
    df = spark.createDataFrame([("g", i, float(i), float(-i)) for i in range(9)], "g string, id int, x double, y double")
    assert ST.spearman(df, ["g"], "x", "y", "id").first().rho == pytest.approx(-1)
    ranks = {r.x: r.rank for r in ST.mid_ranks(spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 5.0, None)], "g string, x double"), ["g"], "x").collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_schedules(spark):
    at = lambda kind, **k: [r.multiplier for r in ST.schedule(spark.range(100).withColumnRenamed("id", "s"), "s", kind, 100, 5, **k).orderBy("s").collect()]
    assert at("constant") == [1.0] * 100
    w = at("wsd", decay_start=80)
    assert w[0] == pytest.approx(0.2) and w[5:80] == [1.0] * 75 and w[99] < w[90] < 1
    c = at("cosine")
    assert c[5] == pytest.approx(1.0) and c[99] < 0.11
    with pytest.raises(ValueError):
        at("other")


def test_tokens_round_trip(spark):
    texts = ["A ring, 5.3 mag", "Звезда и 星", "", "<|endoftext|> is text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", "x", K.token_ids(F.col("x")).alias("ids"), K.token_count(F.col("x")).alias("n"))
    rows = df.withColumn("back", K.token_text(F.col("ids"))).orderBy("i").collect()
    assert [r.back for r in rows] == texts and [r.n for r in rows] == [len(r.ids or []) for r in rows]


def test_bootstrap_takes_ten_thousand_resamples(spark):
    rows = spark.createDataFrame([(f"c{i}", 1.0 + i % 3, 2.0) for i in range(40)], "c string, a double, b double")
    draws = ST.bootstrap_sums(rows, "c", ["a", "b"]).withColumn("gain", F.col("a") / F.col("b"))
    assert draws.agg(F.count("*"), F.countDistinct("resample")).first()[:] == (10_000, 10_000)
    assert ST.one_sided_p(draws, "gain", 0.0).first().p == 1 / 10_001


def test_tau_interval_holds_the_point_and_narrows(spark):
    rng = random.Random(3)
    drop = {"Z": 0.0, "C": 1.0, "B50": 0.5}
    rows = [(f"{g}{i}", g, 5 + d + rng.gauss(0, 0.2), 5.0) for g, d in drop.items() for i in range(200)]
    df = spark.createDataFrame(rows, "k string, g string, x double, y double")
    a, b = df.select("k", "g", F.col("x").alias("v")), df.select("k", F.col("y").alias("v"))
    got = {r.g: r for r in ST.tau_bootstrap(a, b, ["k"], "g", "v").collect()}
    point = {r.g: r.tau for r in ST.paired_benefits(a, b, ["k"], "g", "v").collect()}
    assert set(got) == {"C", "B50"} and got["B50"].draws == 10_000
    assert got["C"].low == got["C"].high == 1.0
    assert got["B50"].low < point["B50"] < got["B50"].high and 0.02 < got["B50"].high - got["B50"].low < 0.12


def test_permutation_p_of_spearman(spark):
    rows = [("up", i, i * i) for i in range(9)] + [("down", i, -i) for i in range(9)] + [("four", i, y) for i, y in enumerate((1, 0, 3, 2))] + [("one", 1, 1)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {r.g: r for r in ST.spearman_permutation(df, ["g"], "x", "y", "x").collect()}
    assert got["up"].rho == pytest.approx(1) and got["up"].p < 0.001 and got["down"].p == 1
    assert got["four"].rho == pytest.approx(0.6) and got["four"].p == pytest.approx(5 / 24, abs=0.02)  # 5 of 24 orders reach 0.6
    assert got["one"].rho is None and got["one"].p is None


def test_extractability(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "r string, x boolean")
    assert {tuple(r) for r in ST.extractability(df, ["r"], "x").collect()} == {("a", 2, 1, 0.5), ("b", 0, 0, None)}
