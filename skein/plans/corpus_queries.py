"""Queries over the corpus's manifest and texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalogue import RECORDS_SQL, query
from skein.functions import hashes as H
from skein.functions import text as X
from skein.operators import dedup, ingest
from skein.operators import quality as Q
from skein.sources.manifest import SPLITS, SplitReader, contract_violations, manifest_view, records, split_name
from skein.sources.jsonl import pending
from skein.sources.tables import table
from skein.storage import written

S, D = SparkSession, DataFrame
#: Thresholds of the corpus; language is scored on few words, since records are short.
T = Q.Thresholds(least_language=0.5)
CUTOFF, KEY, ALGORITHM = "2023-11-01T00:00:00Z", "skein-splits", "v1"
APPROVED = ("wikipedia_en_astronomy", "openstax_astronomy_2e", "kestrel_ridge_bulletin", "orrery_school_pages", "tarn_observatory_notes", "plate_vault_letters", "lyra_forum_digest")

W = X.WHITE


def strip_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{W}]+', ''), '[{W}]+$', '')"


def blocks_sql(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n[{W}]*\n'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def lines_sql(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\r\n|[\n\r\x{{B}}\x{{C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def words_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^{W}]+')"


def grams_sql(w: str) -> str:
    return f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) <= 5 THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' ')) END"


FUNCTION_LIST = "[" + ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS) + "]"
SPLIT_LIST = "(" + ", ".join(f"'{s}'" for s in SPLITS) + ")"
ASSESSED_SQL = f"""{RECORDS_SQL},
m AS (SELECT document_id, source, title, published_at, split, dedup_cluster_id, coalesce(text, '') AS t FROM rec),
a AS (SELECT *, regexp_extract_all(lower(regexp_replace(t, '[^A-Za-z]+', ' ', 'g')), '[a-z]+') AS w, length(regexp_replace(t, '[{W}]+', '', 'g')) AS visible, length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters, {lines_sql('t')} AS ln, len({blocks_sql('t')}) AS n_blocks, len(regexp_extract_all(t, '[<>{{}}]|\\[\\[|\\]\\]')) AS marks FROM m),
b AS (SELECT *, CASE WHEN len(w) >= 20 THEN least(1.0, len(list_filter(w, lambda x: list_contains({FUNCTION_LIST}, x)))::DOUBLE / len(w) / 0.35) ELSE 0.0 END AS ls, CASE WHEN visible > 0 THEN letters::DOUBLE / visible ELSE 0.0 END AS alpha FROM a),
c AS (SELECT *, list_filter([CASE WHEN length(t) < 200 THEN 'too_short' END, CASE WHEN n_blocks < 2 THEN 'too_few_paragraphs' END, CASE WHEN alpha < 0.65 THEN 'low_alpha_ratio' END, CASE WHEN (CASE WHEN length(t) > 0 THEN marks::DOUBLE / length(t) ELSE 1.0 END) > 0.02 THEN 'markup_contamination' END, CASE WHEN (CASE WHEN len(ln) > 0 THEN 1 - len(list_distinct(ln))::DOUBLE / len(ln) ELSE 0.0 END) > 0.35 THEN 'repeated_lines' END, CASE WHEN ls < 0.5 THEN 'low_language_score' END, CASE WHEN source NOT IN ({", ".join(f"'{s}'" for s in APPROVED)}) THEN 'source_not_approved' END, CASE WHEN NOT coalesce(TRY_CAST(published_at AS TIMESTAMPTZ) <= TIMESTAMPTZ '{CUTOFF}', source = 'openstax_astronomy_2e') THEN 'post_cutoff' END], lambda x: x IS NOT NULL) AS reasons FROM b),
assessed AS (SELECT *, len(reasons) = 0 AS accepted, CASE WHEN len(reasons) = 0 THEN ls * alpha * ln(greatest(length(t), 2)) ELSE 0.0 END AS qs FROM c)"""


def assessed(spark: S, sf: str, *more: str) -> D:
    """The records with their reasons, verdicts and scores."""
    rows = records(spark, sf, "source", "title", "published_at", "split", "dedup_cluster_id", "text", *more)
    known = F.coalesce(Q.within_cutoff(F.col("published_at"), CUTOFF, F.col("source") == "openstax_astronomy_2e"), F.lit(False))
    extra = [F.when(~F.col("source").isin(*APPROVED), "source_not_approved"), F.when(~known, "post_cutoff")]
    return Q.assess(rows, "text", T, extra)


@query(f"WITH {ASSESSED_SQL} SELECT document_id, array_to_string(reasons, ',') AS reasons, accepted, round(ls, 6) AS language_score, round(qs, 6) AS quality_score FROM assessed")
def doc_quality_assess(spark: S, sf: str) -> D:
    return assessed(spark, sf).select("document_id", F.array_join("reasons", ",").alias("reasons"), "accepted", F.round("language_score", 6).alias("language_score"), F.round("quality_score", 6).alias("quality_score"))


@query(f"WITH {ASSESSED_SQL} SELECT reason, count(*) AS documents FROM (SELECT unnest(reasons) AS reason FROM assessed) GROUP BY reason")
def rejection_reason_counts(spark: S, sf: str) -> D:
    return Q.reason_counts(assessed(spark, sf))


@query(
    f"WITH {ASSESSED_SQL}, s AS (SELECT *, list_has_any(reasons, ['source_not_approved', 'post_cutoff']) AS outside FROM assessed) "
    "SELECT * FROM (SELECT 'input' AS stage, 0::BIGINT AS position, count(*) AS documents, coalesce(sum(strlen(t)), 0)::BIGINT AS bytes FROM s "
    "UNION ALL SELECT 'with_text', 1, count(*) FILTER (t <> ''), coalesce(sum(strlen(t)) FILTER (t <> ''), 0)::BIGINT FROM s "
    "UNION ALL SELECT 'source_and_cutoff', 2, count(*) FILTER (NOT outside), coalesce(sum(strlen(t)) FILTER (NOT outside), 0)::BIGINT FROM s "
    "UNION ALL SELECT 'accepted', 3, count(*) FILTER (accepted), coalesce(sum(strlen(t)) FILTER (accepted), 0)::BIGINT FROM s)"
)
def stage_funnel(spark: S, sf: str) -> D:
    outside = F.arrays_overlap("reasons", F.array(F.lit("source_not_approved"), F.lit("post_cutoff")))
    t = F.coalesce("text", F.lit(""))
    return Q.funnel(assessed(spark, sf), {"input": (F.lit(True), t), "with_text": (t != "", t), "source_and_cutoff": (~outside, t), "accepted": (F.col("accepted"), t)})


@query(f"WITH {ASSESSED_SQL}, v AS (SELECT a.accepted, len(r.rejection_reasons) = 0 AS label FROM assessed a JOIN rec r USING (document_id)) SELECT count(label) AS labelled, count(*) FILTER (label AND NOT accepted) AS false_rejects, count(*) FILTER (NOT label AND accepted) AS missed_rejects FROM v")
def quality_calibration(spark: S, sf: str) -> D:
    return Q.calibration(assessed(spark, sf, "rejection_reasons"), F.when(F.col("rejection_reasons").isNotNull(), F.size("rejection_reasons") == 0))


def _hmac_sql(message: str) -> str:
    key = KEY.encode().ljust(64, b"\0")
    i, o = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    inner = f"unhex(sha256(unhex('{i}') || encode({message})))"
    return f"('0x' || substr(sha256(unhex('{o}') || {inner}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


def _split_sql(u: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {b} THEN '{n}'" for n, b in bounds[:-1]) + f" ELSE '{bounds[-1][0]}' END"


_GROUP = "coalesce(dedup_cluster_id, document_id)"
_U = _hmac_sql(f"'{ALGORITHM}|' || {_GROUP}")


@query(f"WITH {RECORDS_SQL} SELECT document_id, round({_U}, 9) AS u, {_split_sql(_U, H.FIVE_WAY)} AS pool, {_split_sql(_U, H.THREE_WAY)} AS split3 FROM rec")
def hmac_split_assignment(spark: S, sf: str) -> D:
    group = F.coalesce("dedup_cluster_id", "document_id")
    u = H.unit_interval(KEY, F.concat(F.lit(f"{ALGORITHM}|"), group))
    return records(spark, sf, "dedup_cluster_id").select("document_id", F.round(u, 9).alias("u"), H.keyed_split(KEY, ALGORITHM, group).alias("pool"), H.keyed_split(KEY, ALGORITHM, group, H.THREE_WAY).alias("split3"))


@query(
    f"WITH {ASSESSED_SQL}, x AS (SELECT CASE WHEN accepted THEN {_split_sql(_U, H.FIVE_WAY)} ELSE 'excluded' END AS split, t FROM assessed) "
    f"SELECT s.split, count(x.t) AS documents, coalesce(sum(len({words_sql('x.t')})), 0)::BIGINT AS words, coalesce(sum(strlen(x.t)), 0)::BIGINT AS utf8_bytes FROM (SELECT unnest([{', '.join(repr(s) for s in SPLITS)}]) AS split) s LEFT JOIN x USING (split) GROUP BY s.split"
)
def split_stats(spark: S, sf: str) -> D:
    """Assessed documents, assigned by their cluster, counted per split; splits without documents have zeros."""
    pool = F.when(F.col("accepted"), H.keyed_split(KEY, ALGORITHM, F.coalesce("dedup_cluster_id", "document_id"))).otherwise("excluded")
    t = F.coalesce("text", F.lit(""))
    per = assessed(spark, sf).groupBy(pool.alias("split")).agg(F.count("*").alias("documents"), F.sum(X.word_count(t)).alias("words"), F.sum(F.octet_length(t)).alias("utf8_bytes"))
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(per, "split", "left").select("split", z("documents"), z("words"), z("utf8_bytes"))


@query(
    f"WITH {RECORDS_SQL}, k AS (SELECT document_id, sha256(text) AS sha FROM rec WHERE text IS NOT NULL AND text <> ''), g AS (SELECT sha, min(document_id) AS root, count(*) AS n, 'cluster_' || substr(sha256(array_to_string(list_sort(list(document_id)), chr(10))), 1, 16) AS cluster FROM k GROUP BY sha HAVING count(*) > 1) SELECT k.document_id, g.root, g.n, g.cluster FROM k JOIN g USING (sha)"
)
def exact_dup_clusters(spark: S, sf: str) -> D:
    rows = records(spark, sf, "text").where("text is not null and text <> ''").select("document_id", H.sha256(F.col("text")).alias("sha"))
    g = rows.groupBy("sha").agg(F.min("document_id").alias("root"), F.count("*").alias("n"), F.sort_array(F.collect_list("document_id")).alias("m")).where("n > 1")
    g = g.select("sha", "root", "n", F.concat(F.lit("cluster_"), F.substring(H.sha256(F.array_join("m", "\n")), 1, 16)).alias("cluster"))
    return rows.join(g, "sha").select("document_id", "root", "n", "cluster")


@query(f"WITH {RECORDS_SQL}, w AS (SELECT {words_sql('lower(text)')} AS w FROM rec WHERE text IS NOT NULL), g AS (SELECT unnest({grams_sql('w')}) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 3")
def word_ngram_counts(spark: S, sf: str) -> D:
    return records(spark, sf, "text").where("text is not null").select(F.explode(X.word_ngrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3")


@query(
    f"WITH {RECORDS_SQL}, k AS (SELECT document_id, lower(regexp_extract(dedup_cluster_id, '[0-9a-fA-F]{{16}}')) AS c, {words_sql('lower(text)')} AS w FROM rec WHERE text IS NOT NULL), g AS (SELECT document_id, c, {grams_sql('w')} AS g FROM k WHERE c <> ''), x AS (SELECT a.document_id AS a, b.document_id AS b, len(list_intersect(a.g, b.g)) AS i, len(list_distinct(list_concat(a.g, b.g))) AS u FROM g a JOIN g b ON a.c = b.c AND a.document_id < b.document_id) SELECT a, b, round(CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END, 6) AS jaccard FROM x"
)
def cluster_pair_jaccard(spark: S, sf: str) -> D:
    """Exact similarity of the members of each recorded cluster, of which there are few to a cluster."""
    c = F.lower(F.regexp_extract("dedup_cluster_id", "([0-9a-fA-F]{16})", 1))
    g = written(records(spark, sf, "dedup_cluster_id", "text").where(F.col("text").isNotNull() & (c != "")).select("document_id", c.alias("c"), F.array_distinct(X.word_ngrams(F.col("text"))).alias("g")))
    a, b = g.select(F.col("document_id").alias("a"), "c", F.col("g").alias("ga")), g.select(F.col("document_id").alias("b"), "c", F.col("g").alias("gb"))
    return a.join(b, "c").where("a < b").select("a", "b", F.round(X.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


_AB = H.minhash_coefficients(64)
SIGS_SQL = (
    f"p AS (SELECT unnest(range(0, 64)) AS i, unnest([{', '.join(str(a) for a, _ in _AB)}]::UBIGINT[]) AS a, unnest([{', '.join(str(b) for _, b in _AB)}]::UBIGINT[]) AS b), "
    f"w AS (SELECT document_id, {words_sql('lower(text)')} AS w FROM rec WHERE text IS NOT NULL), g AS (SELECT document_id, ('0x' || substr(md5(unnest(list_distinct({grams_sql('w')}))), 1, 8))::UBIGINT AS h FROM w), "
    "s AS (SELECT document_id, i, min((a::UHUGEINT * h + b) % 4294967296)::BIGINT AS v FROM g CROSS JOIN p GROUP BY ALL), "
    "sig AS (SELECT document_id, list(v ORDER BY i) AS sig FROM s GROUP BY document_id), "
    "bd AS (SELECT document_id, k, sig[4 * k + 1:4 * k + 4] AS band FROM sig, (SELECT unnest(range(0, 16)) AS k)), "
    "cand AS (SELECT DISTINCT x.document_id AS a, y.document_id AS b FROM bd x JOIN bd y ON x.k = y.k AND x.band = y.band AND x.document_id < y.document_id), "
    "near AS (SELECT c.a, c.b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2]))::DOUBLE / 64 AS estimate FROM cand c JOIN sig x ON c.a = x.document_id JOIN sig y ON c.b = y.document_id)"
)


def _signatures(spark: S, sf: str) -> D:
    rows = records(spark, sf, "text").where(F.col("text").rlike(r"(?U)\S"))
    return written(dedup.signatures(rows, digest="md5"))


@query(f"WITH {RECORDS_SQL}, {SIGS_SQL} SELECT document_id, md5(array_to_string(sig, ',')) AS signature, sig[1] AS first FROM sig")
def minhash_signatures(spark: S, sf: str) -> D:
    return _signatures(spark, sf).select("document_id", F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("signature"), F.element_at("sig", 1).alias("first"))


@query(
    f"WITH RECURSIVE {RECORDS_SQL}, {SIGS_SQL}, e AS (SELECT a, b FROM near WHERE estimate >= 0.8 UNION SELECT b, a FROM near WHERE estimate >= 0.8), r AS (SELECT document_id AS n, document_id AS m FROM sig UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n AS document_id, min(m) AS root, count(*) AS cluster_size FROM r GROUP BY n"
)
def near_dup_components(spark: S, sf: str) -> D:
    """Documents with the least id of their component over near-duplicate pairs, and the component's size."""
    sigs = _signatures(spark, sf)
    c = dedup.clusters(sigs, [dedup.near_pairs(sigs)])
    n = c.groupBy("root").agg(F.count("*").alias("cluster_size"))
    return c.join(n, "root").select("document_id", "root", "cluster_size")


@query(f"WITH RECURSIVE {RECORDS_SQL}, {SIGS_SQL}, e AS (SELECT a, b FROM near WHERE estimate >= 0.8 UNION SELECT b, a FROM near WHERE estimate >= 0.8), r AS (SELECT document_id AS n, document_id AS m FROM sig UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), k AS (SELECT min(m) AS root, count(*) AS n FROM r GROUP BY r.n), q AS (SELECT root, count(*) AS n FROM k GROUP BY root) SELECT n AS cluster_size, count(*) AS clusters FROM q GROUP BY n")
def cluster_size_histogram(spark: S, sf: str) -> D:
    sigs = _signatures(spark, sf)
    c = dedup.clusters(sigs, [dedup.near_pairs(sigs)])
    return c.groupBy("root").agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("clusters"))


@query()
def corpus_clusters(spark: S, sf: str) -> D:
    """The cluster manifest: exact, near and lead-entity links of accepted records, content-addressed ids, representatives.

    Scored as the corpus is built: the score of the text as acquired with the
    length after shared paragraphs were removed.
    """
    rows = written(assessed(spark, sf).where("accepted").select("document_id", "title", "text", "quality_score"))
    kept = written(dedup.keep_one_owner(rows, "document_id", "text", 80, T.least_chars).where("not collapsed").select(F.col("id").alias("document_id"), "text"))
    near = dedup.near_pairs(written(dedup.signatures(kept)))
    exact = dedup.exact_edges(kept.select("document_id", H.sha256(F.col("text")).alias("sha")))
    links = dedup.entity_links(rows.join(kept.select("document_id"), "document_id", "left_semi"))
    members = dedup.clusters(kept, [near, exact, links])
    scored = kept.select("document_id", F.length("text").alias("chars")).join(rows.select("document_id", F.col("quality_score").alias("score")), "document_id")
    return dedup.cluster_manifest(members, scored).withColumn("member_ids", F.array_join("member_ids", ","))


def _stem(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), '^(?i:the) ', ''))"



@query(
    f"WITH {RECORDS_SQL}, t AS (SELECT document_id, title, string_split(title, ' of ') AS p, regexp_extract(title, '^(.+?) \\([^)]*\\)$', 1) AS q FROM rec WHERE title IS NOT NULL), "
    f"s AS (SELECT document_id, list_filter([CASE WHEN q <> '' THEN {_stem('q')} END, CASE WHEN len(p) > 1 THEN {_stem("array_to_string(p[2:], ' of ')")} END, CASE WHEN len(p) > 1 THEN {_stem('p[len(p)]')} END], lambda x: x IS NOT NULL AND x <> '') AS st FROM t), "
    "u AS (SELECT document_id, unnest(st) AS stem, generate_subscripts(st, 1) AS pos FROM s), n AS (SELECT lower(title) AS stem, min(document_id) AS other FROM t GROUP BY 1) "
    "SELECT document_id AS a, arg_min(other, pos) AS b FROM u JOIN n USING (stem) WHERE other <> document_id GROUP BY document_id"
)
def lead_entity_links(spark: S, sf: str) -> D:
    return dedup.entity_links(records(spark, sf, "title"))


@query(f"WITH {ASSESSED_SQL}, g AS (SELECT document_id, lower(regexp_extract(dedup_cluster_id, '[0-9a-fA-F]{{16}}')) AS c, qs, length(t) AS n FROM assessed) SELECT c AS cluster, document_id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY qs DESC, n DESC, document_id) AS r FROM g WHERE c <> '') WHERE r = 1")
def cluster_representatives(spark: S, sf: str) -> D:
    c = F.lower(F.regexp_extract("dedup_cluster_id", "([0-9a-fA-F]{16})", 1))
    rows = assessed(spark, sf).select(c.alias("cluster"), "document_id", "quality_score", F.length(F.coalesce("text", F.lit(""))).alias("n")).where("cluster <> ''")
    return dedup.representatives(rows, "cluster", [F.desc("quality_score"), F.desc("n"), F.asc("document_id")]).select("cluster", "document_id")


@query(f"WITH {RECORDS_SQL}, b AS (SELECT document_id, unnest(list_distinct({blocks_sql('text')})) AS block FROM rec WHERE text IS NOT NULL) SELECT md5(block) AS block, count(*) AS documents, min(document_id) AS owner FROM b WHERE length(block) >= 80 GROUP BY b.block HAVING count(*) > 1")
def shared_paragraph_frequency(spark: S, sf: str) -> D:
    return dedup.block_frequency(records(spark, sf, "text")).where("documents > 1").select(F.md5("block").alias("block"), "documents", "owner")


@query(
    f"WITH {RECORDS_SQL}, b AS (SELECT document_id, {blocks_sql('text')} AS bl, text FROM rec), u AS (SELECT document_id, unnest(bl) AS block, generate_subscripts(bl, 1) AS pos FROM b), sh AS (SELECT block, min(document_id) AS owner FROM u WHERE length(block) >= 80 GROUP BY block HAVING min(document_id) <> max(document_id)), "
    "k AS (SELECT u.document_id, string_agg(u.block, chr(10) || chr(10) ORDER BY pos) FILTER (sh.owner IS NULL OR sh.owner = u.document_id) AS kept, count(*) FILTER (sh.owner <> u.document_id) AS removed FROM u LEFT JOIN sh USING (block) GROUP BY u.document_id) "
    "SELECT b.document_id, md5(CASE WHEN coalesce(removed, 0) = 0 THEN text ELSE coalesce(kept, '') END) AS text_md5, coalesce(removed, 0) AS removed, coalesce(removed, 0) > 0 AND length(coalesce(kept, '')) < 200 AS collapsed FROM b LEFT JOIN k USING (document_id)"
)
def shared_paragraph_owner_dedup(spark: S, sf: str) -> D:
    out = dedup.keep_one_owner(records(spark, sf, "text"))
    return out.select(F.col("id").alias("document_id"), F.md5("text").alias("text_md5"), "removed", F.coalesce("collapsed", F.lit(False)).alias("collapsed"))


@query(
    f"WITH {RECORDS_SQL}, k AS (SELECT document_id, lower(trim(split)) AS split, nullif(lower(regexp_extract(dedup_cluster_id, '[0-9a-fA-F]{{16}}')), '') AS c, text FROM rec WHERE lower(trim(split)) IN {SPLIT_LIST} AND lower(trim(split)) <> 'excluded'), "
    f"b AS (SELECT DISTINCT split, sha256(block) AS h, length(block) AS n FROM (SELECT split, unnest({blocks_sql('text')}) AS block FROM k WHERE text IS NOT NULL) WHERE length(block) >= 80), cl AS (SELECT DISTINCT split, c FROM k WHERE c IS NOT NULL), "
    "x AS (SELECT p.split AS pool_a, q.split AS pool_b, count(*) AS n, array_to_string(list_sort(list(p.c))[1:20], ',') AS cs FROM cl p JOIN cl q ON p.c = q.c AND p.split < q.split GROUP BY ALL), "
    "y AS (SELECT p.split AS pool_a, q.split AS pool_b, count(*) AS n, count(*) FILTER (p.n >= 400) AS big FROM b p JOIN b q ON p.h = q.h AND p.split < q.split GROUP BY ALL) "
    "SELECT pool_a, pool_b, coalesce(x.n, 0) AS cluster_overlap, coalesce(y.n, 0) AS block_overlap, coalesce(y.big, 0) AS substantial_overlap, coalesce(x.cs, '') AS clusters, coalesce(x.n, 0) + coalesce(y.big, 0) > 0 AS leaked FROM x FULL JOIN y USING (pool_a, pool_b)"
)
def cross_split_leakage(spark: S, sf: str) -> D:
    c = F.nullif(F.lower(F.regexp_extract("dedup_cluster_id", "([0-9a-fA-F]{16})", 1)), F.lit(""))
    k = records(spark, sf, "split", "dedup_cluster_id", "text").withColumn("split", split_name()).where(F.col("split").isin(*SPLITS[:-1]))
    blocks = k.select("split", F.explode(X.blocks(F.col("text"))).alias("b")).where(F.length("b") >= 80).select("split", H.sha256(F.col("b")).alias("hash"), F.length("b").alias("chars"))
    return dedup.split_overlaps(k.select("split", c.alias("cluster")), blocks)


@query("SELECT pool_a, pool_b, count(*) AS audits, count(*) FILTER (leaked IS DISTINCT FROM (cluster_overlap_count > 0 OR substantial_paragraph_overlap_count > 0)) AS contradicted, count(*) FILTER (leaked IS NULL) AS without_verdict FROM (SELECT DISTINCT audit_id, lower(trim(pool_a)) AS pool_a, lower(trim(pool_b)) AS pool_b, leaked, cluster_overlap_count, substantial_paragraph_overlap_count FROM leakage_audit) GROUP BY pool_a, pool_b")
def leakage_reaudit(spark: S, sf: str) -> D:
    """Recorded verdicts against what their own counts say."""
    own = (F.col("cluster_overlap_count") > 0) | (F.col("substantial_paragraph_overlap_count") > 0)
    rows = table(spark, sf, "leakage_audit").select("audit_id", split_name("pool_a").alias("pool_a"), split_name("pool_b").alias("pool_b"), "leaked", "cluster_overlap_count", "substantial_paragraph_overlap_count").distinct()
    return rows.groupBy("pool_a", "pool_b").agg(F.count("*").alias("audits"), F.count_if(~F.col("leaked").eqNullSafe(own)).alias("contradicted"), F.count_if(F.col("leaked").isNull()).alias("without_verdict"))


@query(f"WITH {RECORDS_SQL} SELECT document_id, 'doc_' || lower(regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_' || regexp_replace(regexp_replace(source_record_id, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_id FROM rec")
def safe_document_ids(spark: S, sf: str) -> D:
    return records(spark, sf, "source", "source_record_id").select("document_id", X.safe_id(F.col("source"), F.col("source_record_id")).alias("safe_id"))


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS documents, coalesce(sum(strlen(text)), 0)::BIGINT AS utf8_bytes FROM rec WHERE lower(trim(split)) = 'train' AND text IS NOT NULL")
def sealed_reader_train(spark: S, sf: str) -> D:
    return SplitReader(records(spark, sf, "split", "text").where("text is not null")).training_bytes()


@query(f"WITH {RECORDS_SQL} SELECT lower(trim(split)) AS split, coalesce(license_id, '') AS license_id, source, count(*) AS documents, count(*) FILTER (published_at > '2023-11-01') AS after_cutoff FROM rec GROUP BY ALL")
def source_license_counts(spark: S, sf: str) -> D:
    return records(spark, sf, "split", "license_id", "source", "published_at").groupBy(split_name().alias("split"), F.coalesce("license_id", F.lit("")).alias("license_id"), "source").agg(F.count("*").alias("documents"), F.count_if(F.col("published_at") > "2023-11-01").alias("after_cutoff"))


@query(f"WITH {RECORDS_SQL} SELECT document_id, source, lower(trim(split)) AS split, array_to_string(author_attribution, '|') AS authors, license_id, array_to_string(quality_flags, '|') AS quality_flags, is_representative FROM rec WHERE lower(trim(split)) <> 'excluded'")
def manifest_projection(spark: S, sf: str) -> D:
    cols = [c for c in ("source", "source_record_id", "title", "canonical_url", "revision_id", "published_at", "author_attribution", "license_id", "license_url", "rights_notes", "raw_sha256", "clean_sha256", "pipeline_version", "language_score", "quality_flags", "dedup_cluster_id", "split", "rejection_reasons", "is_representative", "quality_score")]
    rows = manifest_view(records(spark, sf, *cols).withColumn("retrieved_at", F.lit(None).cast("string")))
    return rows.where(split_name() != "excluded").select("document_id", "source", split_name().alias("split"), F.array_join("author_attribution", "|").alias("authors"), "license_id", F.array_join("quality_flags", "|").alias("quality_flags"), "is_representative")


@query(f"WITH {RECORDS_SQL} SELECT document_id, source, array_to_string(rejection_reasons, ',') AS reasons FROM rec WHERE lower(trim(split)) = 'excluded'")
def excluded_view(spark: S, sf: str) -> D:
    return records(spark, sf, "source", "split", "rejection_reasons").where(split_name() == "excluded").select("document_id", "source", F.array_join("rejection_reasons", ",").alias("reasons"))


_REQUIRED = ["document_id", "source", "source_record_id", "title", "canonical_url", "revision_id", "retrieved_at", "author_attribution", "license_id", "license_url", "rights_notes", "raw_sha256", "clean_sha256", "pipeline_version", "language_score", "quality_flags", "dedup_cluster_id", "split"]


@query(
    "SELECT * FROM (SELECT 'document_id_form' AS rule, count(*) FILTER (NOT regexp_matches(document_id, '^doc_[a-z0-9_]+_[A-Za-z0-9._-]+$')) AS violations FROM astronomy_sample "
    + "".join(f"UNION ALL SELECT '{c}_form', count(*) FILTER (NOT regexp_matches({c}, '^[0-9a-f]{{64}}$')) FROM astronomy_sample " for c in ("raw_sha256", "clean_sha256"))
    + f"UNION ALL SELECT 'language_score_range', count(*) FILTER (NOT language_score BETWEEN 0 AND 1) FROM astronomy_sample UNION ALL SELECT 'split_name', count(*) FILTER (split NOT IN {SPLIT_LIST}) FROM astronomy_sample "
    + "UNION ALL SELECT 'missing_required', count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in _REQUIRED) + ") FROM astronomy_sample)"
)
def manifest_contract(spark: S, sf: str) -> D:
    return contract_violations(table(spark, sf, "astronomy_sample"))


@query(f"WITH {RECORDS_SQL} SELECT source, count(*) AS kept, count(*) FILTER (TRY_CAST(published_at AS TIMESTAMPTZ) IS NULL) AS without_time FROM rec WHERE coalesce(TRY_CAST(published_at AS TIMESTAMPTZ) <= TIMESTAMPTZ '{CUTOFF}', source = 'openstax_astronomy_2e') GROUP BY source")
def temporal_cutoff(spark: S, sf: str) -> D:
    from skein.operators.latest import utc_instant

    rows = records(spark, sf, "source", "published_at").where(Q.within_cutoff(F.col("published_at"), CUTOFF, F.col("source") == "openstax_astronomy_2e"))
    return rows.groupBy("source").agg(F.count("*").alias("kept"), F.count_if(utc_instant("published_at").isNull()).alias("without_time"))


@query(f"WITH {RECORDS_SQL} SELECT source, count(*) AS documents FROM rec WHERE source IN ({', '.join(repr(s) for s in APPROVED)}) GROUP BY source")
def allowlisted_sources(spark: S, sf: str) -> D:
    dim = spark.createDataFrame([(s,) for s in APPROVED], "source string")
    return records(spark, sf, "source").join(dim, "source", "left_semi").groupBy("source").agg(F.count("*").alias("documents"))


@query(f"WITH {RECORDS_SQL} SELECT title, min(document_id) AS document_id FROM category_listing WHERE ns = 0 AND document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM rec WHERE text IS NOT NULL AND lower(trim(split)) <> 'excluded') GROUP BY title")
def pending_anti_join(spark: S, sf: str) -> D:
    """Listed documents whose text isn't in the corpus yet: not delivered, without text, or left out."""
    done = records(spark, sf, "split", "text").where((split_name() != "excluded") & F.col("text").isNotNull())
    wanted = table(spark, sf, "category_listing").where("ns = 0 and document_id is not null")
    return pending(wanted, done, "document_id").groupBy("title").agg(F.min("document_id").alias("document_id"))


@query("SELECT source, source_record_id, strftime(max(p) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS published, arg_max(revision_id, (p, revision_id)) AS revision_id FROM (SELECT *, TRY_CAST(published_at AS TIMESTAMPTZ) AS p FROM astronomy_sample) WHERE p <= TIMESTAMPTZ '2022-01-01T00:00:00Z' AND revision_id IS NOT NULL GROUP BY source, source_record_id")
def asof_latest_revision(spark: S, sf: str) -> D:
    """The last revision of each source record at or before a time."""
    from skein.operators.latest import utc_instant

    rows = table(spark, sf, "astronomy_sample").where("revision_id is not null").select(F.struct("source", "source_record_id").alias("k"), utc_instant("published_at").alias("p"), "revision_id")
    out = ingest.latest_before(rows, "k", "p", F.to_timestamp(F.lit("2022-01-01T00:00:00Z")), ["revision_id"])
    return out.select("k.source", "k.source_record_id", F.date_format("p", "yyyy-MM-dd HH:mm:ss").alias("published"), "revision_id")


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_props_json(spark: S, sf: str) -> D:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_DUMP = "dump AS (SELECT DISTINCT source_record_id AS id, canonical_url AS url, title, text FROM astronomy_sample WHERE text IS NOT NULL), want AS (SELECT DISTINCT title FROM category_listing WHERE ns = 0)"


@query(f"WITH {_DUMP} SELECT 'doc_dump_' || id || '_20231101' AS document_id, title, url AS canonical_url, '2023-11-01T00:00:00Z' AS published_at, sha256(text) AS raw_sha256 FROM dump WHERE title IN (SELECT title FROM want) OR id IN (SELECT source_record_id FROM astronomy_sample WHERE source = 'comet_desk_wire')")
def dump_selection(spark: S, sf: str) -> D:
    """Dump rows by listed titles or by ids, as records with the dump's stamp."""
    rows = table(spark, sf, "astronomy_sample")
    dump = rows.where("text is not null").select(F.col("source_record_id").alias("id"), F.col("canonical_url").alias("url"), "title", "text").distinct()
    ids = rows.where("source = 'comet_desk_wire'").select(F.col("source_record_id").alias("id"))
    picked = ingest.select_dump(dump, ids, table(spark, sf, "category_listing").where("ns = 0").select("title"))
    return ingest.dump_records(picked, "dump", "20231101.en", "0123456789abcdef", "2024-01-01T00:00:00Z").select("document_id", "title", "canonical_url", "published_at", "raw_sha256")


_PLAIN = "[" + ", ".join(f"'{n}'" for n in X.PLAIN_TRAILING_SECTIONS) + "]"


@query(
    f"WITH {RECORDS_SQL}, l AS (SELECT document_id, text, string_split(text, chr(10)) AS ln, list_transform(string_split(text, chr(10)), lambda x: lower({strip_sql('x')})) AS low FROM rec WHERE text IS NOT NULL), "
    f"c AS (SELECT document_id, text, ln, list_min(list_filter(range(1, len(ln) + 1), lambda i: list_contains({_PLAIN}, low[i]) AND (i = 1 OR low[i - 1] = ''))) AS n FROM l) "
    "SELECT document_id, md5(CASE WHEN n IS NULL THEN text ELSE coalesce(array_to_string(ln[1:n - 1], chr(10)), '') END) AS cut_md5, "
    rf"md5(array_to_string(list_filter(ln, lambda x: NOT regexp_matches(x, '^\s*(\{{\||\|\}}|\|-|\|\+|!|\|)') AND NOT regexp_matches(x, '^\s*[*#|:;-]+\s*$')), chr(10))) AS lines_md5 FROM c"
)
def plain_text_rules(spark: S, sf: str) -> D:
    """Texts up to their first trailing section, and without lines of tables and bullets."""
    t = F.col("text")
    return records(spark, sf, "text").where("text is not null").select("document_id", F.md5(X.cut_trailing_sections(t)).alias("cut_md5"), F.md5(X.drop_table_lines(t)).alias("lines_md5"))


@query()
def extracted_text_stats(spark: S, sf: str) -> D:
    """Raw texts parsed by kind of source, normalised, and counted."""
    rows = records(spark, sf, "source", "text").where("text is not null").select("document_id", "source", F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("text_format"))
    out = ingest.extracted(rows).withColumn("clean", X.normalized(F.col("extracted")))
    return out.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.octet_length("raw_text")).alias("raw_bytes"), F.sum(F.octet_length("clean")).alias("clean_bytes"), F.count_if(F.sha2("clean", 256) != F.sha2("raw_text", 256)).alias("changed"))


@query(f"WITH {RECORDS_SQL}, w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM rec WHERE lower(trim(split)) = 'train' AND text IS NOT NULL) SELECT word, count(*) AS n FROM w WHERE length(word) > 1 GROUP BY word HAVING count(*) >= 5")
def word_type_vocabulary(spark: S, sf: str) -> D:
    from skein.operators.probes import vocabulary

    return vocabulary(SplitReader(records(spark, sf, "split", "text").where("text is not null")).training_texts(), 5)


def fixture_digest(ids: list[str]) -> str:
    """Order-independent hash of a set of ids."""
    return hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
