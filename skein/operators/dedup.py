"""Exact and near duplicates, shared paragraphs, clusters and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import hashes as H
from skein.functions import text as X
from skein.operators.components import connected_components
from skein.storage import written


def exact_edges(df: DataFrame, id: str = "document_id", digest: str = "sha") -> DataFrame:
    """(a, b): every document with its least equal one; a star a group, whatever its size."""
    first = df.groupBy(digest).agg(F.min(id).alias("a"))
    return df.join(first, digest).where(F.col("a") != F.col(id)).select("a", F.col(id).alias("b"))


def signatures(df: DataFrame, id: str = "document_id", text: str = "text", n: int = 64, words: int = 5, digest: str = "blake2s") -> DataFrame:
    return df.select(F.col(id), H.minhash(F.coalesce(F.col(text), F.lit("")), words, n, digest=digest).alias("sig"))


def band_pairs(sigs: DataFrame, id: str = "document_id", bands: int = 16) -> DataFrame:
    """(a, b), a < b: documents that agree in all rows of a band, each pair once.

    Documents of equal signature meet as one: only the least of them is
    paired, and the others are linked to it, so a large group of copies gives
    a star instead of all its pairs.
    """
    keyed = sigs.select(F.col(id).alias("id"), "sig", F.xxhash64("sig").alias("s"))
    least = keyed.groupBy("s").agg(F.min("id").alias("lead"))
    star = keyed.join(least, "s").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    own = keyed.join(least.select(F.col("lead").alias("id")), "id", "left_semi")
    rows = F.size("sig") / bands
    key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", (i * rows + 1).cast("int"), rows.cast("int")))))
    b = own.select("id", key.alias("band"))
    met = b.select("band", F.col("id").alias("a")).join(b.select("band", F.col("id").alias("b")), "band").where("a < b").select("a", "b").distinct()
    return met.union(star)


def near_pairs(sigs: DataFrame, id: str = "document_id", bands: int = 16, threshold: float = 0.8) -> DataFrame:
    """(a, b, estimate) of the band pairs whose signatures agree in at least the threshold's share."""
    s = sigs.select(F.col(id).alias("id"), "sig")
    both = band_pairs(sigs, id, bands).join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", H.agreement(F.col("sa"), F.col("sb")).alias("estimate")).where(F.col("estimate") >= threshold)


def entity_links(df: DataFrame, id: str = "document_id", title: str = "title") -> DataFrame:
    """(a, b): documents whose title, without its qualifier or after ' of ', is another document's title.

    Case is ignored; the least id bears a title; the first stem that is a
    title counts, and a document isn't linked to itself.
    """
    t = df.select(F.col(id).alias("id"), F.col(title).alias("title")).where("title is not null")
    parts = F.split("title", " of ")
    qualified = F.regexp_extract("title", r"^(.+?) \([^)]*\)$", 1)
    several = F.size(parts) > 1
    raw = F.array_compact(F.array(F.when(qualified != "", qualified), F.when(several, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " of ")), F.when(several, F.element_at(parts, -1))))
    stem = F.transform(raw, lambda s: F.lower(F.regexp_replace(F.trim(s), "^(?i:the) ", "")))
    stems = t.select("id", F.posexplode(F.filter(stem, lambda s: s != "")).alias("pos", "stem"))
    names = t.groupBy(F.lower("title").alias("stem")).agg(F.min("id").alias("other"))
    return stems.join(names, "stem").where("other <> id").groupBy("id").agg(F.min_by("other", "pos").alias("other")).select(F.col("id").alias("a"), F.col("other").alias("b"))


def clusters(ids: DataFrame, edges: list[DataFrame], id: str = "document_id") -> DataFrame:
    """(document_id, root): connected components over all edges whose ends are known; the least id is the root."""
    known = ids.select(F.col(id).alias("id"))
    e = edges[0].select("a", "b")
    for more in edges[1:]:
        e = e.union(more.select("a", "b"))
    e = e.join(known.select(F.col("id").alias("a")), "a", "left_semi").join(known.select(F.col("id").alias("b")), "b", "left_semi")
    comp = connected_components(e, "a", "b")
    return known.join(comp, F.col("id") == F.col("node"), "left").select(F.col("id").alias("document_id"), F.coalesce("component", "id").alias("root"))


def cluster_manifest(members: DataFrame, scored: DataFrame) -> DataFrame:
    """(dedup_cluster_id, n, representative_id, member_ids) of (document_id, root).

    The id is the hash of the sorted members. The representative has the best
    score, then the longest text, then the least id; scored: (document_id,
    score, chars). A cluster's members are listed in its row, as the manifest
    demands; clusters are components of near-duplicates.
    """
    rows = members.join(scored, "document_id")
    best = F.min_by("document_id", F.struct((-F.col("score")).alias("s"), (-F.col("chars")).alias("c"), F.col("document_id").alias("d")))
    by = rows.groupBy("root").agg(F.sort_array(F.collect_list("document_id")).alias("member_ids"), best.alias("representative_id"), F.count("*").alias("n"))
    return by.select(F.concat(F.lit("cluster_"), F.substring(H.sha256(F.array_join("member_ids", "\n")), 1, 16)).alias("dedup_cluster_id"), "n", "representative_id", "member_ids")


def representatives(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of every group in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__r = 1").drop("__r")


def block_frequency(df: DataFrame, id: str = "document_id", text: str = "text", least_chars: int = 80) -> DataFrame:
    """(block, documents, owner): long paragraphs, the documents that have them, and the least of those."""
    own = df.select(F.col(id).alias("id"), F.explode(F.array_distinct(X.blocks(F.col(text)))).alias("block")).where(F.length("block") >= least_chars)
    return own.groupBy("block").agg(F.count("*").alias("documents"), F.min("id").alias("owner"))


def keep_one_owner(df: DataFrame, id: str = "document_id", text: str = "text", least_chars: int = 80, least_text: int = 200) -> DataFrame:
    """(id, text, removed, collapsed): texts without long paragraphs that a lesser document has as well.

    The owner keeps all its copies of a paragraph, others lose all theirs. A
    text that loses nothing stays as it is, letter for letter. collapsed: what
    is left is shorter than least_text. Paragraphs are looked up by hash, so
    only positions travel, not paragraphs.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    parts = rows.select("id", F.posexplode(X.blocks(F.col("text"))).alias("pos", "block")).where(F.length("block") >= least_chars).select("id", "pos", F.sha2("block", 256).alias("h"))
    shared = parts.groupBy("h").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner <> last")
    lost = parts.join(shared, "h").where("id <> owner").groupBy("id").agg(F.collect_list("pos").alias("lost"))
    kept = F.filter(X.blocks(F.col("text")), lambda b, i: ~F.array_contains("lost", i))
    out = rows.join(lost, "id", "left").withColumn("new", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n\n")))
    return out.select("id", F.col("new").alias("text"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("removed"), (F.col("lost").isNotNull() & (F.length("new") < least_text)).alias("collapsed"))


def nearest_agreement(queries: DataFrame, against: DataFrame, id: str = "document_id", bands: int = 32) -> DataFrame:
    """(id, nearest): the best signature agreement of each query with any row it shares a band with; 0 without one.

    With two rows a band, a pair of agreement 0.3 is met with probability 0.95
    and one of 0.5 with 0.9999, so nearest is exact where it matters.
    """
    rows = F.size("sig") / bands
    key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", (i * rows + 1).cast("int"), rows.cast("int")))))
    q, a = queries.select(F.col(id).alias("q"), "sig"), against.select(F.col(id).alias("t"), "sig")
    met = q.select("q", key.alias("band")).join(a.select("t", key.alias("band")), "band").select("q", "t").distinct()
    scored = met.join(q.withColumnRenamed("sig", "sq"), "q").join(a.withColumnRenamed("sig", "st"), "t").groupBy("q").agg(F.max(H.agreement(F.col("sq"), F.col("st"))).alias("nearest"))
    return q.select("q").join(scored, "q", "left").select(F.col("q").alias("id"), F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


def split_overlaps(rows: DataFrame, blocks: DataFrame, least_blocking: int = 400, listed: int = 20) -> DataFrame:
    """(pool_a, pool_b, cluster_overlap, block_overlap, substantial_overlap, clusters, leaked) of every pair of splits that share something.

    rows: (split, cluster); blocks: (split, hash, chars). Both are reduced to
    distinct (split, key) before they are joined on the key, so at most a
    handful of rows of a key meet. leaked: common clusters, or common blocks
    of least_blocking characters; clusters lists the first of the common ones.
    """

    def common(df: DataFrame, key: str, more: list[Column] = []) -> DataFrame:
        d = df.where(F.col(key).isNotNull() & F.col("split").isNotNull()).groupBy("split", key).agg(F.lit(1).alias("one"), *more)
        b = d.select(F.col("split").alias("pool_b"), key)
        return d.withColumnRenamed("split", "pool_a").join(b, key).where("pool_a < pool_b")

    met = written(common(rows, "cluster").select("pool_a", "pool_b", "cluster"))
    first = met.withColumn("__r", F.row_number().over(Window.partitionBy("pool_a", "pool_b").orderBy("cluster"))).where(F.col("__r") <= listed)  # each task keeps `listed` before rows are moved
    names = first.groupBy("pool_a", "pool_b").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))
    a = met.groupBy("pool_a", "pool_b").agg(F.count("*").alias("cluster_overlap")).join(names, ["pool_a", "pool_b"])
    b = common(blocks, "hash", [F.max("chars").alias("chars")]).groupBy("pool_a", "pool_b").agg(F.count("*").alias("block_overlap"), F.count_if(F.col("chars") >= least_blocking).alias("substantial_overlap"))
    both = a.join(b, ["pool_a", "pool_b"], "full")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("pool_a", "pool_b", n("cluster_overlap"), n("block_overlap"), n("substantial_overlap"), F.array_join(F.coalesce("clusters", F.array().cast("array<string>")), ",").alias("clusters"), (F.coalesce("cluster_overlap", "substantial_overlap", F.lit(0)) + F.coalesce("substantial_overlap", F.lit(0)) > 0).alias("leaked"))
