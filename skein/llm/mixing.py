"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are put in a random but fixed order. A document's
virtual finish time is the number of its source's tokens up to and including
it, divided by the source's weight; a second pass over the source goes on
where the first ended. Taking documents in the order of finish times and
stopping at the budget gives every source its share. Cumulative tokens come
from sums over hash ranges of the order, so no source, however large, is
summed up in one task.

The virtual time at which the budget runs out follows from the sources' sums
alone. Whatever has finished by then is taken; only documents that finish
soon after, a few of each source, are put in order by a range sort over
sampled bounds and cut off at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.tokens import TOKENIZER, token_count
from skein.operators.packing import offsets
from skein.storage import written

#: Ranges of the shuffled order that are summed up first; a range of a source with 10**12 documents holds 10**8 / 1.6.
RANGES = 1 << 14


def _running(df: DataFrame, by: list[str], at: Column, order: list[Column], value: str, ranges: int = RANGES) -> DataFrame:
    """df with `upto`: the sum of value over all rows of the same `by` up to and including this one in the order of (at, order).

    at: the range number of the row, rising with the order. Sums of whole
    ranges are added up per `by`; only within a range are rows ordered.
    """
    rows = df.withColumn("__r", at)
    per = rows.groupBy(*by, "__r").agg(F.sum(value).alias("__s"))
    before = per.select(*by, "__r", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__r")) - F.col("__s")).alias("__before"))
    inner = Window.partitionBy(*by, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, [*by, "__r"]).withColumn("upto", F.col("__before") + F.sum(value).over(inner)).drop("__r", "__before")


def _time_at(plan: DataFrame, total: float) -> float:
    """The virtual time by which the sources have given `total` tokens: each gives its share of the time until it is used up.

    plan: (source, t, share, cap), one row a source. Between the times at
    which sources are used up the sum is a straight line, so one running sum
    over the sources in that order finds the line and the time on it.
    """
    end = F.when(F.col("cap").isNotNull(), F.col("cap") * F.col("t") / F.col("share"))
    ends = plan.select("source", "share", end.alias("end"), (F.col("cap") * F.col("t")).alias("most"))
    all_share = ends.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]
    w = Window.orderBy(F.col("end"), "source").rowsBetween(Window.unboundedPreceding, 0)  # one row a source
    lines = ends.where("end is not null").select("end", F.sum("most").over(w).alias("gone"), (F.lit(all_share) - F.sum("share").over(w)).alias("going"))
    # all that is given at each end: what is used up by then and the time's share of the rest
    last = lines.where(F.col("gone") + F.greatest(F.col("going"), F.lit(0.0)) * F.col("end") < F.lit(total)).agg(F.max_by(F.struct("gone", "going", "end"), F.struct("end", "gone"))).first()[0]
    gone, going, at = (float(last["gone"]), float(last["going"]), float(last["end"])) if last is not None else (0.0, float(all_share), 0.0)
    return max(at, (total - gone) / going) if going > 1e-12 else at


def mixed(docs: DataFrame, targets: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17012) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (id, source, tokens, repeats) and the report (source, target_share, tokens, share, documents, available_tokens, max_repeats).

    targets: (source, target_weight, max_repeats) with one row a source; null
    max_repeats is no cap. Weights are scaled to sum to one over the sources
    that have tokens; sources without documents, without a target or with a
    weight not above zero contribute nothing (the former are in the report).
    Without a budget it is the largest at which every source can still have
    its share within its cap, or all tokens if no source has a cap. With a
    larger one, sources at their cap are used up and the rest share what is
    left of the order, so actual shares differ, as the report shows. Documents
    with null source, id or no tokens are never chosen; repeated rows of an id
    count as one.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and source is not null")
    wanted = targets.where("source is not null and target_weight > 0").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("cap"))
    counted = rows.join(wanted.select("source"), "source", "left_semi").select("id", "source", token_count(F.col("text"), tokenizer).alias("tokens")).where("tokens > 0")
    kept = written(counted.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("id", "d.source", "d.tokens"))
    have = kept.groupBy("source").agg(F.sum("tokens").alias("t")).join(wanted, "source").select("source", "t", "w", "cap")
    # a running total a source, over the shuffled order
    spot = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    rank = F.floor((F.shiftrightunsigned(spot, 1) / F.lit(float(1 << 63))) * RANGES)
    ordered = _running(kept.withColumn("spot", F.shiftrightunsigned(spot, 1)), ["source"], rank, [F.col("spot"), F.col("id")], "tokens")
    norm = have.agg(F.sum("w").alias("all_w"), F.sum("t").alias("all_t"), F.min(F.col("cap") * F.col("t") / F.col("w")).alias("reach")).first()
    if norm is None or norm.all_w is None:
        total = 0.0
    else:
        full = float(norm.all_t) if norm.reach is None else float(norm.reach) * float(norm.all_w)
        total = float(budget) if budget is not None else full
    all_w = float(norm.all_w) if norm and norm.all_w else 1.0
    plan = written(have.withColumn("share", F.col("w") / F.lit(all_w)))
    v = _time_at(plan, total)
    # whole passes that are over by then, and what of the next pass is
    whole = F.least(F.floor(F.lit(v) * F.col("share") / F.col("t")), F.coalesce("cap", F.lit(1 << 62)))
    passes = plan.withColumn("done", whole).withColumn("more", F.col("cap").isNull() | (F.col("done") < F.col("cap")))
    timed = ordered.join(passes.select("source", "t", "share", "cap", "done", "more"), "source").withColumn("finish", (F.col("done") * F.col("t") + F.col("upto")) / F.col("share"))
    timed = written(timed.select("id", "source", "tokens", "t", "share", "cap", "done", "finish", (F.col("more") & (F.col("finish") <= F.lit(v))).alias("taken"), "more"))
    sums = timed.groupBy("source").agg(F.max("tokens").alias("largest"), F.first("share").alias("share"), F.max("more").alias("more"), F.sum(F.col("tokens") * (F.col("done") + F.col("taken").cast("long"))).alias("spent"))
    after = sums.agg(F.coalesce(F.sum("spent"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("more"), F.col("largest"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("more"), F.col("share"))), F.lit(0.0))).first()
    left = max(0, int(total) - int(after[0]))
    # by the time `until`, what goes on has finished far more than what is left, even if half of it is used up meanwhile
    until = v + (2.0 * left + 4.0 * float(after[1])) / float(after[2]) if after[2] else v
    rounds = F.sequence(F.lit(0), (F.floor(F.lit(until - v) * F.col("share") / F.col("t")) + 1).cast("int"))
    again = lambda p: F.struct(p.alias("pass"), (F.col("finish") + p * F.col("t") / F.col("share")).alias("at"))
    near = timed.where("more").where(F.col("finish") <= F.lit(until))  # in its first round already, or never
    soon = near.select("id", "source", "tokens", F.explode(F.transform(rounds, again)).alias("p"), "cap", "done")
    soon = soon.where((F.col("p.at") > F.lit(v)) & (F.col("p.at") <= F.lit(until)) & (F.col("cap").isNull() | (F.col("done") + F.col("p.pass") < F.col("cap"))))
    queue = offsets(soon.select("id", F.struct("p.at", "source", "id", "p.pass").alias("place"), "tokens"), "place", F.col("tokens"))
    partial = queue.where(F.col("offset") + F.col("tokens") <= left).groupBy("id").agg(F.count("*").alias("extra"))
    repeats = (F.col("done") + F.col("taken").cast("long") + F.coalesce("extra", F.lit(0))).cast("long")
    chosen = written(timed.join(partial, "id", "left").select("id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0"))
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("documents"))
    grand = got.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 0
    report = wanted.join(plan.select("source", "t", "share"), "source", "left").join(got, "source", "left").select(
        "source",
        F.round(F.coalesce("share", F.lit(0.0)), 6).alias("target_share"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.lit(float(max(grand, 1))), 6).alias("share"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        F.coalesce("t", F.lit(0)).cast("long").alias("available_tokens"),
        F.col("cap").alias("max_repeats"),
    )
    return chosen, report
