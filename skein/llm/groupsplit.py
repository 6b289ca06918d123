"""Splits that keep related records together, over a persisted component table.

Records are related through shared keys (a cluster, a source record). Every
key links its records to their least one; pointer jumping then contracts the
links: each round joins every pointer with the pointer it points to and moves
roots of linked records to the least root met. What is kept is two tables,
(id, component, split) and (key, component). The next delivery brings new
records only: they meet old ones by their keys, only components that they
touch are contracted anew, and merges are carried over to both tables.
Components that have one split keep it, new ones fill what the proportions
lack, and components merged from different splits are quarantined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import written

PROPORTIONS = {"train": 0.91, "validation": 0.03, "test": 0.03, "probe": 0.02, "cloze_reserve": 0.01}
BUCKETS = 1 << 16


def components_by_keys(df: DataFrame, id: str, keys: list[Column], existing: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(id, component): the least id among all that are connected through equal non-null keys.

    existing: an earlier (id, component); its components are kept together.
    Ids given twice are one node with all their keys; null ids are dropped.
    A key held by very many records costs one grouped minimum, not pairs.
    """
    rows = df.select(F.col(id).cast("string").alias("id"), *(k.alias(f"k{i}") for i, k in enumerate(keys))).where("id is not null")
    star = None
    for i in range(len(keys)):
        part = rows.where(F.col(f"k{i}").isNotNull()).select("id", F.col(f"k{i}").alias("k"))
        least = part.groupBy("k").agg(F.min("id").alias("root"))
        links = part.join(least, "k").where("id <> root").select("id", "root")
        star = links if star is None else star.unionByName(links)
    if existing is not None:
        old = existing.where("id <> component").select(F.greatest("id", "component").alias("id"), F.least("id", "component").alias("root"))
        star = old if star is None else star.unionByName(old)
        rows = rows.select("id").union(existing.select("id")).union(existing.select(F.col("component").alias("id")))
    edges = written(star.distinct())
    parent = written(rows.select("id").distinct().join(edges.groupBy("id").agg(F.min("root").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("parent")))
    for _ in range(rounds):
        # jump: the parent's parent
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        jumped = parent.join(up, "parent").select("id", F.col("grand").alias("parent"))
        # hook: over every edge whose ends point apart, the greater parent takes the lesser
        ends = edges.join(jumped.select("id", F.col("parent").alias("p")), "id").join(jumped.select(F.col("id").alias("root"), F.col("parent").alias("q")), "root").where("p <> q")
        hooks = ends.select(F.greatest("p", "q").alias("id"), F.least("p", "q").alias("h")).groupBy("id").agg(F.min("h").alias("h"))
        new = written(jumped.join(hooks, "id", "left").select("id", F.least("parent", F.coalesce("h", "parent")).alias("parent")))
        changed = new.join(parent.select("id", F.col("parent").alias("old")), "id").where("parent <> old").limit(1).count()
        parent = new
        if not changed:
            return parent.select("id", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


@dataclass
class Components:
    """records: (id, component, split), each id once; keys: (key, component), each key once. Write both to keep them."""

    records: DataFrame
    keys: DataFrame

    def written(self) -> Components:
        return Components(written(self.records), written(self.keys))


def updated(rows: DataFrame, id: str, keys: list[Column], split: str, state: Components | None = None) -> Components:
    """The component tables with the delivered rows (id, split and what the keys are made of) added.

    Without a state the rows are the first delivery. An id delivered again
    takes its new split and adds its new keys to those it had: components
    grow and merge, they are never parted. Null ids are dropped.
    """
    named = [F.when(k.isNotNull(), F.to_json(F.struct(F.lit(i).alias("n"), k.alias("k")))) for i, k in enumerate(keys)]
    new = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(split).alias("split"), F.array_compact(F.array(*named)).alias("ks"))
    keyed = new.select("id", F.explode("ks").alias("key")).distinct()
    old = None
    if state is not None:
        old = written(keyed.join(state.keys, "key").select("id", "component").union(new.select("id").join(state.records.select("id", "component"), "id")).distinct())
    comp = components_by_keys(rows, id, keys, old)
    records = new.groupBy("id").agg(F.max("split").alias("split")).join(comp, "id").select("id", "component", "split")
    table = keyed.join(comp, "id").groupBy("key").agg(F.min("component").alias("component"))
    if state is None:
        return Components(records, table)
    moved = comp.select(F.col("id").alias("component"), F.col("component").alias("now")).where("component <> now")
    now = lambda df: df.join(moved, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    kept = now(state.records.join(new.select("id"), "id", "left_anti")).select("id", "component", "split")
    return Components(kept.union(records), now(state.keys.join(keyed.select("key"), "key", "left_anti")).select("key", "component").union(table))


def assign_splits(table: DataFrame, proportions: dict[str, float] | None = None, seed: int = 17012) -> DataFrame:
    """(id, component, old_split, split, state) from (id, component, split); no component gets two splits.

    split names outside the proportions, null among them, count as none. A
    component whose records have one known split keeps it for all of them
    (state kept); one with none is new and gets a split that the proportions
    lack (new); one with several is in conflict, and its records are assigned
    as if new, as one, but marked torn so that they can be held back
    (quarantined). Deficits are filled in the order of a keyed hash of the
    component through prefix sums over 65,536 hash buckets, the largest
    table that is ordered as a whole.
    """
    proportions = proportions or PROPORTIONS
    known = F.when(F.col("split").isin(*proportions), F.col("split"))
    rows = table.withColumn("known", known)
    comps = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("known").alias("lo"), F.max("known").alias("hi"))
    comps = comps.withColumn("state", F.when(F.col("lo").isNull(), "new").when(F.col("lo") == F.col("hi"), "kept").otherwise("quarantined"))
    held = {r["lo"]: r["n"] for r in comps.where("state = 'kept'").groupBy("lo").agg(F.sum("n").alias("n")).collect()}
    total = comps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    scale = sum(proportions.values())
    lacks = {s: max(0.0, total * p / scale - held.get(s, 0)) for s, p in proportions.items()}
    whole = sum(lacks.values())
    at, bounds = 0.0, []
    for s in proportions:
        at += (lacks[s] / whole) if whole else proportions[s] / scale
        bounds.append((s, at))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(BUCKETS))
    free = comps.where("state <> 'kept'").withColumn("bucket", bucket)
    sums = free.groupBy("bucket").agg(F.sum("n").alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    sums = sums.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    inner = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "component"), "component").rowsBetween(Window.unboundedPreceding, -1)
    placed = free.join(sums, "bucket").withColumn("u", (F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("n") / 2) / F.col("all"))
    choice = F.lit(bounds[-1][0])
    for s, upto in reversed(bounds[:-1]):
        choice = F.when(F.col("u") < upto, s).otherwise(choice)
    chosen = placed.select("component", choice.alias("new_split"))
    return rows.join(comps.select("component", "lo", "state"), "component").join(chosen, "component", "left").select("id", "component", F.col("split").alias("old_split"), F.when(F.col("state") == "kept", F.col("lo")).otherwise(F.col("new_split")).alias("split"), "state")


def torn_groups(table: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """(component, n, splits) of the components whose records have at least two of the splits."""
    known = F.when(F.col("split").isin(*(splits or PROPORTIONS)), F.col("split"))
    return table.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(known)).alias("splits")).where("size(splits) > 1")
