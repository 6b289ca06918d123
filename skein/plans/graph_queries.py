"""Queries over category listings and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalogue import RECORDS_SQL, query
from skein.operators import ingest
from skein.operators import quality as Q
from skein.sources.manifest import records
from skein.sources.tables import table

S, D = SparkSession, DataFrame
PATTERNS = [r"\bprobes\b", r"\bsheet\b", "notes$"]
DEPTH = 4


def _excluded_sql(c: str) -> str:
    return " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in PATTERNS)


def root_of(spark: S, sf: str) -> str:
    """The listing's largest category, ties to the least name."""
    rows = table(spark, sf, "category_listing").where("ns = 14").groupBy("parent_category").agg(F.countDistinct("title").alias("n"))
    return rows.orderBy(F.desc("n"), "parent_category").first()[0]


_WALK = (
    "WITH RECURSIVE r0 AS (SELECT parent_category AS root FROM category_listing WHERE ns = 14 GROUP BY 1 ORDER BY count(DISTINCT title) DESC, 1 LIMIT 1), "
    f"l AS (SELECT DISTINCT parent_category AS p, ns, title AS t FROM category_listing WHERE parent_category IS NOT NULL AND title IS NOT NULL AND NOT ({_excluded_sql('title')})), "
    f"w AS (SELECT root AS t, 0::BIGINT AS d FROM r0 UNION SELECT l.t, w.d + 1 FROM w JOIN l ON l.p = w.t AND l.ns = 14 WHERE w.d < {DEPTH}), "
    "c AS (SELECT t AS title, min(d) AS depth FROM w GROUP BY t)"
)


@query(f"{_WALK} SELECT title, depth FROM c")
def category_walk(spark: S, sf: str) -> D:
    rows = table(spark, sf, "category_listing")
    seen, _ = ingest.category_walk(rows, root_of(spark, sf), DEPTH, Q.first_matching_pattern(F.col("title"), PATTERNS).isNotNull())
    return seen.select("title", "depth")


@query(f"{_WALK}, pg AS (SELECT l.t AS title, c.depth + 1 AS depth, c.title AS category FROM c JOIN l ON l.p = c.title AND l.ns = 0 WHERE c.depth < {DEPTH}) SELECT title, min(depth) AS depth, arg_min(category, (depth, category)) AS category FROM pg GROUP BY title")
def category_pages(spark: S, sf: str) -> D:
    rows = table(spark, sf, "category_listing")
    _, pages = ingest.category_walk(rows, root_of(spark, sf), DEPTH, Q.first_matching_pattern(F.col("title"), PATTERNS).isNotNull())
    return pages.select("title", "depth", "category")


@query("SELECT pattern, count(*) AS titles FROM (SELECT DISTINCT title, CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{p}'" for p in PATTERNS) + " END AS pattern FROM category_listing) WHERE pattern IS NOT NULL GROUP BY pattern")
def excluded_titles(spark: S, sf: str) -> D:
    """Titles by the first pattern that excludes them."""
    rows = table(spark, sf, "category_listing").select("title").distinct()
    return rows.select(Q.first_matching_pattern(F.col("title"), PATTERNS).alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("titles"))


PAYLOADS = [
    '{"query":{"pages":{"7":{"pageid":7,"title":"Comet","revisions":[{"revid":71,"timestamp":"2023-01-02T00:00:00Z","slots":{"main":{"content":"A comet."}}}]},"8":{"pageid":8,"title":"Halo","revisions":[{"revid":81,"timestamp":"2023-01-03T00:00:00Z","slots":{"main":{"*":"A halo."}}}]}},"redirects":[{"from":"Comets","to":"Comet"}],"normalized":[{"from":"comets","to":"Comets"}]}}',
    '{"query":{"pages":{"-1":{"title":"Nowhere","missing":""},"9":{"pageid":9,"title":"Bare"},"10":{"pageid":10,"title":"Old","revisions":[{"revid":101,"timestamp":"2022-01-01T00:00:00Z","content":"Old form."}]},"11":{"pageid":11,"title":"Void","revisions":[{"revid":111,"timestamp":"2022-01-01T00:00:00Z","slots":{"main":{"content":""}}}]}}}}',
    '{"batchcomplete":""}',
]


def payloads(spark: S) -> D:
    return spark.createDataFrame([(p,) for p in PAYLOADS], "payload string")


@query("SELECT * FROM (VALUES ('doc_wiki_7_71', 'Comet', '71'), ('doc_wiki_8_81', 'Halo', '81'), ('doc_wiki_10_101', 'Old', '101')) t(document_id, title, revision_id)")
def payload_records(spark: S, sf: str) -> D:
    """Revision payloads as records: payloads come from a service, so a few literal ones stand for them."""
    return ingest.payload_records(payloads(spark), "payload", "wiki", "2024-01-01T00:00:00Z")[0].select("document_id", "title", "revision_id")


@query("SELECT * FROM (VALUES ('Nowhere', 'missing'), ('Bare', 'no revision'), ('Void', 'empty content'), (NULL, 'no pages')) t(title, problem)")
def payload_problems(spark: S, sf: str) -> D:
    return ingest.payload_records(payloads(spark), "payload", "wiki", "2024-01-01T00:00:00Z")[1]


@query("SELECT * FROM (VALUES ('comets', 'Comet'), ('Comets', 'Comet'), ('Halo', 'Halo')) t(title, resolved)")
def resolved_titles(spark: S, sf: str) -> D:
    titles = spark.createDataFrame([("comets",), ("Comets",), ("Halo",)], "title string")
    return ingest.resolved_titles(payloads(spark), "payload", titles)


def record_payloads(spark: S, sf: str) -> D:
    """A revision payload for every record: pages are numbered by a hash of the id, revisions by the number in theirs; titles written with underscores are normalised."""
    r = records(spark, sf, "title", "revision_id", "published_at", "text")
    page = F.shiftrightunsigned(F.xxhash64("document_id"), 1)
    revid = F.nullif(F.regexp_extract("revision_id", "([0-9]+)$", 1), F.lit("")).cast("long")
    main = F.create_map(F.lit("content"), F.coalesce("text", F.lit("")))
    revision = F.struct(revid.alias("revid"), F.col("published_at").alias("timestamp"), F.struct(main.alias("main")).alias("slots"))
    pages = F.create_map(page.cast("string"), F.struct(page.alias("pageid"), "title", F.array(revision).alias("revisions")))
    moves = F.when(F.col("title").contains(" "), F.array(F.struct(F.translate("title", " ", "_").alias("from"), F.col("title").alias("to"))))
    return r.select(F.to_json(F.struct(F.struct(pages.alias("pages"), moves.alias("normalized")).alias("query"))).alias("payload"))


@query(f"WITH {RECORDS_SQL} SELECT title, nullif(regexp_extract(revision_id, '([0-9]+)$', 1), '') AS revision_id, sha256(text) AS raw_sha256 FROM rec WHERE text IS NOT NULL AND text <> ''")
def table_payload_records(spark: S, sf: str) -> D:
    """The records of the table's own payloads."""
    return ingest.payload_records(record_payloads(spark, sf), "payload", "wiki", "2024-01-01T00:00:00Z")[0].select("title", "revision_id", "raw_sha256")


@query(f"WITH {RECORDS_SQL} SELECT title, 'empty content' AS problem FROM rec WHERE text IS NULL OR text = ''")
def table_payload_problems(spark: S, sf: str) -> D:
    return ingest.payload_records(record_payloads(spark, sf), "payload", "wiki", "2024-01-01T00:00:00Z")[1]


@query(f"WITH {RECORDS_SQL}, t AS (SELECT DISTINCT replace(title, ' ', '_') AS title FROM category_listing WHERE title IS NOT NULL), m AS (SELECT DISTINCT title AS resolved, replace(title, ' ', '_') AS title FROM rec WHERE title LIKE '% %') SELECT t.title, coalesce(m.resolved, t.title) AS resolved FROM t LEFT JOIN m USING (title)")
def table_resolved_titles(spark: S, sf: str) -> D:
    """The listing's titles, written with underscores, followed through the table's payloads."""
    titles = table(spark, sf, "category_listing").where("title is not null").select(F.translate("title", " ", "_").alias("title"))
    return ingest.resolved_titles(record_payloads(spark, sf), "payload", titles)
