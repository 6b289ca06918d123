"""From acquired payloads, dumps and listings to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import hashes as H
from skein.functions import text as X
from skein.functions.markup import html_prose, wikitext_prose
from skein.storage import written

PAGES = "struct<query:struct<pages:map<string,struct<pageid:bigint,title:string,missing:string,revisions:array<struct<revid:bigint,timestamp:string,content:string,slots:struct<main:map<string,string>>>>>>,normalized:array<struct<from:string,to:string>>,redirects:array<struct<from:string,to:string>>>>"


def select_dump(dump: DataFrame, ids: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Dump rows whose id is in ids or whose title is in titles; all rows if neither is given."""
    rows = dump.select("id", "url", "title", "text")
    if ids is None and titles is None:
        return rows
    a = rows.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else None
    if titles is None:
        return a
    t = titles.select("title").distinct()
    b = rows.join(t, "title", "left_semi")
    if a is None:
        return b
    return a.unionByName(b.join(ids.select("id").distinct(), "id", "left_anti"))


def snapshot_time(config: Column) -> Column:
    """The stamp of a dump's name, 20231101.en, as a time: 2023-11-01T00:00:00Z."""
    return F.regexp_replace(config, r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3T00:00:00Z")


def dump_records(rows: DataFrame, source: str, config: str, revision: str, retrieved_at: str, dataset: str = "dump") -> DataFrame:
    """Dump rows as records: ids with the stamp, revisions that name the dataset."""
    stamp = config.split(".")[0]
    return rows.select(
        X.safe_id(F.lit(source), F.concat(F.col("id").cast("string"), F.lit(f"_{stamp}"))).alias("document_id"),
        F.lit(source).alias("source"),
        F.col("id").cast("string").alias("source_record_id"),
        "title",
        F.col("url").alias("canonical_url"),
        F.lit(f"{dataset}@{revision[:12]}:{config}").alias("revision_id"),
        snapshot_time(F.lit(config)).alias("published_at"),
        F.lit(retrieved_at).alias("retrieved_at"),
        F.col("text").alias("raw_text"),
        F.lit("dump_plaintext").alias("text_format"),
        H.sha256(F.col("text")).alias("raw_sha256"),
    )


def payload_records(df: DataFrame, payload: str, source: str, retrieved_at: str) -> tuple[DataFrame, DataFrame]:
    """Records and problems (title, problem) of revision payloads in JSON.

    A payload without pages, a missing page, one without revision and one
    without content is a problem. Content is the main slot's `content`, else
    its `*`, else the revision's own.
    """
    q = df.select(F.from_json(F.col(payload), PAGES).alias("p")).select(F.col("p.query.pages").alias("pages"))
    pages = q.select(F.explode_outer(F.map_values("pages")).alias("page"))
    rev = F.get("page.revisions", F.lit(0))
    main = rev["slots"]["main"]
    content = F.coalesce(F.try_element_at(main, F.lit("content")), F.try_element_at(main, F.lit("*")), rev["content"])
    rows = pages.withColumns({"rev": rev, "content": content}).withColumn(
        "problem",
        F.when(F.col("page").isNull(), "no pages").when(F.col("page.missing").isNotNull(), "missing").when(F.col("rev").isNull(), "no revision").when(F.coalesce(F.col("content"), F.lit("")) == "", "empty content"),
    )
    good = rows.where("problem is null").select(
        X.safe_id(F.lit(source), F.concat(F.col("page.pageid").cast("string"), F.lit("_"), F.col("rev.revid").cast("string"))).alias("document_id"),
        F.lit(source).alias("source"),
        F.col("page.pageid").cast("string").alias("source_record_id"),
        F.col("page.title").alias("title"),
        F.col("rev.revid").cast("string").alias("revision_id"),
        F.col("rev.timestamp").alias("published_at"),
        F.lit(retrieved_at).alias("retrieved_at"),
        F.col("content").alias("raw_text"),
        H.sha256(F.col("content")).alias("raw_sha256"),
    )
    return good, rows.where("problem is not null").select(F.col("page.title").alias("title"), "problem")


def resolved_titles(df: DataFrame, payload: str, titles: DataFrame, hops: int = 5) -> DataFrame:
    """(title, resolved): titles followed through normalisations and redirects, redirects first, at most `hops` times."""
    p = df.select(F.from_json(F.col(payload), PAGES)["query"].alias("q"))
    step = lambda c, rank: p.select(F.inline(c)).select(F.col("from").alias("f"), F.col("to").alias("t"), F.lit(rank).alias("rank"))
    moves = step("q.redirects", 0).union(step("q.normalized", 1)).groupBy("f").agg(F.min_by("t", "rank").alias("t"))
    now = titles.select("title", F.col("title").alias("resolved")).distinct()
    for _ in range(hops):
        now = now.join(moves, F.col("resolved") == F.col("f"), "left").select("title", F.coalesce("t", "resolved").alias("resolved"))
    return now


def latest_before(df: DataFrame, key: str, at: str, cutoff: Column, values: list[str]) -> DataFrame:
    """For every key the values of its last row at or before the cutoff: a grouped maximum, no sort."""
    top = F.max_by(F.struct(*values), F.struct(F.col(at), *values))
    return df.where(F.col(at) <= cutoff).groupBy(key).agg(F.max(at).alias(at), top.alias("v")).select(key, at, "v.*")


def extracted(df: DataFrame, source: str = "source", raw: str = "raw_text", format: str = "text_format") -> DataFrame:
    """df with extracted: the raw text as prose, by format and kind of source.

    The rows are written once, however they came about; each kind is parsed
    on its own part of them, so that no row goes through a parser in Python
    that it doesn't need.
    """
    kind = (
        F.when(F.coalesce(F.col(format), F.lit("")) == "dump_plaintext", "plain")
        .when(F.col(source).contains("wikipedia"), "wiki")
        .when(F.col(source).contains("openstax") & F.col(raw).contains("<"), "html")
        .otherwise("other")
    )
    rows = written(df.withColumn("__kind", kind))
    parts = {"plain": X.cut_trailing_sections(F.col(raw)), "wiki": wikitext_prose(F.col(raw)), "html": html_prose(F.col(raw)), "other": F.col(raw)}
    out = None
    for k, c in parts.items():
        part = rows.where(F.col("__kind") == k).withColumn("extracted", c)
        out = part if out is None else out.unionByName(part)
    return out.drop("__kind")


def sections(df: DataFrame, tree: str) -> DataFrame:
    """(id, title, position) of the leaves of nested contents trees in JSON, however deep; titles without tags."""
    node = "struct<id:string,title:string,contents:array<string>>"
    now = written(df.select(F.from_json(F.col(tree), node).alias("n"), F.array().cast("array<int>").alias("path")))
    leaves = now.where("n.contents is null and n.id is not null")
    while True:
        inner = now.where("n.contents is not null").select("path", F.posexplode("n.contents").alias("i", "c"))
        now = written(inner.select(F.from_json("c", node).alias("n"), F.concat("path", F.array("i")).alias("path")))
        if not now.limit(1).count():
            break
        leaves = leaves.union(now.where("n.contents is null and n.id is not null"))
    title = F.trim(F.regexp_replace(F.regexp_replace("n.title", "<[^>]*>", ""), "\n", " "))
    return leaves.select("n.id", title.alias("title"), F.array_join(F.transform("path", lambda i: F.lpad(i.cast("string"), 4, "0")), ".").alias("position"))


def section_records(leaves: DataFrame, pages: DataFrame, source: str, edition: str, retrieved_at: str) -> DataFrame:
    """Leaf sections (id, title, position) and their pages (id, url, html) as records, in the order of the book; sections without a page have none."""
    rows = leaves.join(pages.select("id", "url", "html"), "id").where(F.col("html").isNotNull())
    return rows.select(
        X.safe_id(F.lit(source), F.concat("id", F.lit(f"_{edition}"))).alias("document_id"),
        F.lit(source).alias("source"),
        F.col("id").alias("source_record_id"),
        "title",
        F.col("url").alias("canonical_url"),
        F.lit(edition).alias("revision_id"),
        F.lit(retrieved_at).alias("retrieved_at"),
        F.col("html").alias("raw_text"),
        H.sha256(F.col("html")).alias("raw_sha256"),
        "position",
    )


def latest_by_title(df: DataFrame, payload: str, titles: DataFrame, source: str, retrieved_at: str) -> DataFrame:
    """(requested, records): the record each requested title comes to, through normalisations and redirects; titles without one are left out.

    Of several payloads with one title the latest revision counts.
    """
    good, _ = payload_records(df, payload, source, retrieved_at)
    one = good.groupBy("title").agg(F.max_by(F.struct(*good.columns), F.struct("published_at", "revision_id", "document_id")).alias("r"))
    reached = resolved_titles(df, payload, titles)
    return reached.join(one, F.col("resolved") == one["title"]).select(reached["title"].alias("requested"), "r.*")


def category_walk(listing: DataFrame, root: str, max_depth: int, excluded: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Categories (title, depth) and pages (title, depth, category) reached from the root, breadth first.

    listing: (parent_category, ns, title, list_position), 14 a category, 0 a
    page. A title counts where it is met first: at the least depth, there in
    the least category by name, then the least position. Excluded titles are
    neither listed nor opened; categories at max_depth are listed, not opened.
    Every level is a join on the frontier and an anti-join with what is known,
    so loops end.
    """
    rows = listing.where("parent_category is not null and title is not null").select("parent_category", "ns", "title", "list_position")
    if excluded is not None:
        rows = rows.where(~excluded)
    rows = written(rows.groupBy("parent_category", "ns", "title").agg(F.min("list_position").alias("list_position")))
    spark = listing.sparkSession
    seen = spark.range(1).select(F.lit(root).alias("title"), F.lit(0).cast("long").alias("depth"))
    frontier, pages = seen, None
    for d in range(max_depth):
        met = rows.join(frontier.select(F.col("title").alias("parent_category")), "parent_category")
        found = met.where("ns = 0").groupBy("title").agg(F.min_by("parent_category", F.struct("parent_category", "list_position")).alias("category")).select("title", F.lit(d + 1).cast("long").alias("depth"), "category")
        pages = written(found if pages is None else pages.union(found.join(pages, "title", "left_anti")))
        frontier = written(met.where("ns = 14").select("title").distinct().join(seen, "title", "left_anti").select("title", F.lit(d + 1).cast("long").alias("depth")))
        seen = seen.union(frontier)
        if not frontier.limit(1).count():
            break
    return seen, pages if pages is not None else spark.createDataFrame([], "title string, depth long, category string")
