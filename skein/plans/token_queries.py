"""Queries over token sequences: packing, count-based models, tokenizer metrics, probe sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalogue import RECORDS_SQL, query
from skein.functions import text as X
from skein.functions import tokens as K
from skein.operators import ngrams, packing, probes, sweep
from skein.operators import statistics as ST
from skein.operators.latest import latest_per_key, utc_instant
from skein.plans.corpus_queries import SPLIT_LIST, words_sql
from skein.sources.manifest import SPLITS, SplitReader, records, split_name
from skein.sources.tables import table
from skein.storage import written

S, D = SparkSession, DataFrame
V = 20_000
ORDERS, REGISTERED = [3, 4, 5, 6], 5
TOK = f"tok AS (SELECT document_id, lower(trim(split)) AS split, {words_sql('text')} AS w, strlen(text) AS bytes FROM rec WHERE text IS NOT NULL)"
#: Word lengths stand for token ids: integers that SQL can make as well.
IDS = "list_transform(w, lambda x: length(x)::INTEGER)"


_PARTS = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT), 0)::HUGEINT AS p{i}" for i in range(8))
_DIGEST = "sha256(n || '|' || " + " || '|' || ".join(f"p{i}" for i in range(8)) + ")"


def _tokens(spark: S, sf: str, split: str | None = None) -> D:
    rows = records(spark, sf, "split", "text").where("text is not null")
    rows = rows.where(split_name() == split) if split else rows
    return written(rows.select("document_id", X.words(F.col("text")).alias("w"), F.octet_length("text").alias("bytes")))


_WINDOWS = (
    f"WITH {RECORDS_SQL}, {TOK}, d AS (SELECT document_id, {IDS} AS ids, bytes, len(w) AS n FROM tok), o AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d), "
    "t AS (SELECT document_id, off + unnest(range(0, n + 1)) AS pos, unnest(list_concat(ids, [-1])) AS tok, unnest(range(0, n + 1)) AS i, bytes, n FROM o), "
    "x AS (SELECT *, (pos // 256)::BIGINT AS \"window\", CASE WHEN i < n THEN bytes // n + CASE WHEN i < bytes % n THEN 1 ELSE 0 END ELSE 0 END AS b FROM t)"
)


@query(f"{_WINDOWS} SELECT \"window\", sum(b)::BIGINT AS byte_count, count(*) AS tokens, sum(tok)::BIGINT AS token_sum, count(DISTINCT document_id) AS documents, (count(*) - 1)::BIGINT AS targets, md5(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS digest FROM x GROUP BY \"window\"")
def token_windows_256(spark: S, sf: str) -> D:
    """Packed windows: their bytes, tokens, loss targets and content."""
    rows = _tokens(spark, sf).select("document_id", F.transform("w", lambda x: F.length(x)).alias("ids"), "bytes")
    w = packing.pack(rows, "document_id", "ids", "bytes", -1, -2)
    real = F.filter(F.col("input_ids"), lambda t: t != -2)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("window", "byte_count", F.size(real).cast("long").alias("tokens"), total(real).alias("token_sum"), F.size(F.array_distinct("document_ids")).cast("long").alias("documents"), total("loss_mask").alias("targets"), F.md5(F.array_join(F.transform(real, lambda t: t.cast("string")), ",")).alias("digest"))


@query(f"{_WINDOWS} SELECT tok AS token, count(*) AS n FROM x GROUP BY tok")
def packed_token_stream(spark: S, sf: str) -> D:
    """Tokens recovered from packed windows, pads left out."""
    rows = _tokens(spark, sf).select("document_id", F.transform("w", lambda x: F.length(x)).alias("ids"), "bytes")
    return packing.token_stream(packing.pack(rows, "document_id", "ids", "bytes", -1, -2)).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS_SQL}, {TOK}, s AS (SELECT document_id, w, unnest(CASE WHEN len(w) > 1 THEN range(0, len(w) - 1, 63) ELSE []::BIGINT[] END) AS b FROM tok) SELECT document_id AS id, (b // 63)::BIGINT AS chunk, len(w[b + 1:b + 64]) AS n, w[b + 1] AS first FROM s")
def overlapping_chunks(spark: S, sf: str) -> D:
    c = packing.overlapping_chunks(_tokens(spark, sf), "document_id", "w", 64)
    return c.select("id", F.col("chunk").cast("long").alias("chunk"), F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"))


def _g(n: int) -> str:
    return f"unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)"


_HEAD, _TAIL = "regexp_replace(gram, ' ?[^ ]+$', '')", "regexp_replace(gram, '^[^ ]+ ?', '')"
_KN = (
    f"WITH {RECORDS_SQL}, {TOK}, tr AS (SELECT * FROM tok WHERE split = 'train'), g3 AS (SELECT gram, count(*) AS c FROM (SELECT {_g(3)} AS gram FROM tr) GROUP BY gram), g2r AS (SELECT DISTINCT gram FROM (SELECT {_g(2)} AS gram FROM tr)), "
    f"g2 AS (SELECT {_TAIL} AS gram, count(*) AS c FROM g3 GROUP BY 1), g1 AS (SELECT {_TAIL} AS gram, count(*) AS c FROM g2r GROUP BY 1), "
    + ", ".join(f"c{n} AS (SELECT {_HEAD} AS x, sum(c) AS total, count(*) AS types FROM g{n} GROUP BY 1), d{n} AS (SELECT CASE WHEN count(*) FILTER (c = 1) > 0 THEN count(*) FILTER (c = 1)::DOUBLE / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) ELSE 0.5 END AS d FROM g{n})" for n in (1, 2, 3))
)


@query(f"{_KN} SELECT 3 AS n, count(*) AS grams, sum(c)::BIGINT AS total, (SELECT round(d, 9) FROM d3) AS discount FROM g3 UNION ALL SELECT 2, count(*), sum(c)::BIGINT, (SELECT round(d, 9) FROM d2) FROM g2 UNION ALL SELECT 1, count(*), sum(c)::BIGINT, (SELECT round(d, 9) FROM d1) FROM g1")
def kneser_ney_counts(spark: S, sf: str) -> D:
    """Sizes and discounts of the tables of each order, fitted on training words."""
    out = None
    for n, (own, _, d) in enumerate(ngrams.kneser_ney_tables(_tokens(spark, sf, "train"), "w", 3), start=1):
        s = own.agg(F.lit(n).alias("n"), F.count("*").alias("grams"), F.sum("c").alias("total"), F.lit(round(d, 9)).alias("discount"))
        out = s if out is None else out.union(s)
    return out


_SCORE = (
    f"{_KN}, v AS (SELECT document_id, w, unnest(range(2, len(w) + 1)) AS i FROM tok WHERE split = 'validation' AND len(w) > 1), r0 AS (SELECT document_id, w[greatest(1, i - 2):i] AS h, 1.0::DOUBLE / {V} AS p FROM v), "
    "p1 AS (SELECT e.document_id, e.h, CASE WHEN k.total IS NOT NULL THEN greatest(coalesce(q.c, 0) - dd.d, 0) / k.total + dd.d * k.types / k.total * p ELSE p END AS p FROM r0 e LEFT JOIN g1 q ON q.gram = e.h[len(e.h)] LEFT JOIN c1 k ON k.x = '' CROSS JOIN d1 dd), "
    "p2 AS (SELECT e.document_id, e.h, CASE WHEN k.total IS NOT NULL THEN greatest(coalesce(q.c, 0) - dd.d, 0) / k.total + dd.d * k.types / k.total * p ELSE p END AS p FROM p1 e LEFT JOIN g2 q ON q.gram = e.h[len(e.h) - 1] || ' ' || e.h[len(e.h)] LEFT JOIN c2 k ON k.x = e.h[len(e.h) - 1] CROSS JOIN d2 dd), "
    "p3 AS (SELECT e.document_id, e.h, CASE WHEN len(e.h) = 3 AND k.total IS NOT NULL THEN greatest(coalesce(q.c, 0) - dd.d, 0) / k.total + dd.d * k.types / k.total * p ELSE p END AS p FROM p2 e LEFT JOIN g3 q ON len(e.h) = 3 AND q.gram = array_to_string(e.h, ' ') LEFT JOIN c3 k ON len(e.h) = 3 AND k.x = e.h[1] || ' ' || e.h[2] CROSS JOIN d3 dd)"
)


@query(f"{_SCORE} SELECT document_id AS id, count(*) AS targets, round(sum(-ln(p)), 4) AS nll FROM p3 GROUP BY 1")
def kneser_ney_nll(spark: S, sf: str) -> D:
    """Validation records under an interpolated trigram model of the training words."""
    tables = ngrams.kneser_ney_tables(_tokens(spark, sf, "train"), "w", 3)
    return ngrams.kneser_ney_scores(_tokens(spark, sf, "validation"), "document_id", "w", tables, V).withColumn("nll", F.round("nll", 4))


def kneser_ney_sql(order: int, train: str, cases: str) -> str:
    """Common table expressions up to p{order} (id, h, p): train has token lists w, cases (id, h) each case with its history."""
    runs = lambda n: f"unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)"
    out = [f"g{order} AS (SELECT gram, count(*) AS c FROM (SELECT {runs(order)} AS gram FROM {train}) GROUP BY gram)"]
    for n in range(order - 1, 0, -1):
        longer = f"g{order}" if n == order - 1 else f"(SELECT DISTINCT {runs(n + 1)} AS gram FROM {train})"
        out.append(f"g{n} AS (SELECT {_TAIL} AS gram, count(*) AS c FROM {longer} GROUP BY 1)")
    before = cases
    for n in range(1, order + 1):
        out.append(f"c{n} AS (SELECT {_HEAD} AS x, sum(c) AS total, count(*) AS types FROM g{n} GROUP BY 1)")
        out.append(f"d{n} AS (SELECT CASE WHEN count(*) FILTER (c = 1) > 0 THEN count(*) FILTER (c = 1)::DOUBLE / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) ELSE 0.5 END AS d FROM g{n})")
        at = f"array_to_string(e.h[len(e.h) - {n - 1}:], ' ')"
        p = "e.p" if n > 1 else f"1.0::DOUBLE / {V}"
        out.append(
            f"p{n} AS (SELECT e.id, e.h, CASE WHEN len(e.h) >= {n} AND k.total IS NOT NULL THEN greatest(coalesce(q.c, 0) - dd.d, 0) / k.total + dd.d * k.types / k.total * {p} ELSE {p} END AS p FROM {before} e "
            f"LEFT JOIN g{n} q ON len(e.h) >= {n} AND q.gram = {at} LEFT JOIN c{n} k ON len(e.h) >= {n} AND k.x = regexp_replace({at}, ' ?[^ ]+$', '') CROSS JOIN d{n} dd)"
        )
        before = f"p{n}"
    return ", ".join(out)


_REGISTERED = f"WITH {RECORDS_SQL}, {TOK}, tr AS (SELECT w FROM tok WHERE split = 'train'), v AS (SELECT document_id AS id, w, unnest(range(2, len(w) + 1)) AS i FROM tok WHERE split = 'validation' AND len(w) > 1), h AS (SELECT id, w[greatest(1, i - {REGISTERED - 1}):i] AS h FROM v), "


@query(f"{_REGISTERED}{kneser_ney_sql(REGISTERED, 'tr', 'h')} SELECT id, count(*) AS targets, round(sum(-ln(p)), 4) AS nll FROM p{REGISTERED} GROUP BY id")
def kneser_ney_registered_nll(spark: S, sf: str) -> D:
    """Validation records under the model of the registered order."""
    tables = ngrams.kneser_ney_tables(_tokens(spark, sf, "train"), "w", REGISTERED)
    return ngrams.kneser_ney_scores(_tokens(spark, sf, "validation"), "document_id", "w", tables, V).withColumn("nll", F.round("nll", 4))


@query(
    f"{_WINDOWS}, sg AS (SELECT x.\"window\", x.document_id, list(x.tok::VARCHAR ORDER BY pos) AS w FROM x JOIN rec USING (document_id) WHERE lower(trim(rec.split)) = 'validation' GROUP BY ALL), tr AS (SELECT list_concat(list_transform(ids, lambda t: t::VARCHAR), ['-1']) AS w FROM d JOIN rec USING (document_id) WHERE lower(trim(rec.split)) = 'train'), "
    f"v AS (SELECT \"window\" AS id, w, unnest(range(2, len(w) + 1)) AS i FROM sg WHERE len(w) > 1), h AS (SELECT id, w[greatest(1, i - 2):i] AS h FROM v), {kneser_ney_sql(3, 'tr', 'h')} SELECT id AS \"window\", count(*) AS targets, round(sum(-ln(p)), 4) AS nll FROM p3 GROUP BY id"
)
def kneser_ney_window_nll(spark: S, sf: str) -> D:
    """Packed windows of which validation records have a part, under a trigram model: histories end where a window or a segment begins."""
    tokens = _tokens(spark, sf).select("document_id", F.transform("w", lambda x: F.length(x)).alias("ids"), "bytes")
    split = written(records(spark, sf, "split").select("document_id", split_name().alias("split")))
    named = F.transform(F.concat("ids", F.array(F.lit(-1))), lambda t: t.cast("string"))
    train = tokens.join(split.where("split = 'train'"), "document_id").select(named.alias("w"))
    parts = ngrams.segments(packing.pack(tokens, "document_id", "ids", "bytes", -1, -2)).join(split.where("split = 'validation'"), "document_id", "left_semi")
    parts = written(parts.select(F.concat_ws(":", F.col("window").cast("string"), "segment").alias("part"), "w"))
    scores = ngrams.kneser_ney_scores(parts, "part", "w", ngrams.kneser_ney_tables(train, "w", 3), V)
    return scores.groupBy(F.substring_index("id", ":", 1).cast("long").alias("window")).agg(F.sum("targets").alias("targets"), F.round(F.sum("nll"), 4).alias("nll"))


def _coded(spark: S, sf: str) -> tuple[D, int]:
    """(training, low, beside) of the training and validation records: the codes of their words; and how many words are spread.

    Words are coded in the scan, so that the choice of each document's last
    delivery, the same as that of `records`, moves codes and no texts.
    """
    rows = table(spark, sf, "astronomy_sample").select("document_id", "retrieved_at", "split", "text")
    wanted = split_name().isin("train", "validation")
    frequent, hot = sweep.frequent_words(rows.where(wanted).select(F.explode(X.words(F.col("text"))).alias("word")))
    narrow = rows.where("document_id is not null").select("document_id", utc_instant("retrieved_at").alias("at"), F.xxhash64(*rows.columns).alias("tie"), split_name().alias("split"), F.when(wanted, X.words(F.col("text"))).alias("w"))
    last = latest_per_key(sweep.word_codes(narrow, "w", frequent), "document_id", F.col("at").desc_nulls_last(), F.col("tie"))
    return last.where("split in ('train', 'validation') and low is not null").select((F.col("split") == "train").alias("training"), "low", "beside"), hot


@query()
def kneser_ney_order_sweep(spark: S, sf: str) -> D:
    """Held-out cost of orders 3 to 6; the least is the order to take."""
    docs, hot = _coded(spark, sf)
    s = sweep.order_sweep(docs, ORDERS, V, hot)
    return s.select("order", "targets", F.round("nll", 4).alias("nll"))


@query(
    f"WITH {RECORDS_SQL}, {TOK}, a AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM tok WHERE split = 'train'), j AS (SELECT array_to_string(w[greatest(1, i - 1):i], ' ') AS gram, count(*) AS c FROM a GROUP BY 1), x AS (SELECT {_HEAD} AS ctx, sum(c) AS total FROM j GROUP BY 1), "
    f"v AS (SELECT document_id, w, unnest(range(2, len(w) + 1)) AS i FROM tok WHERE split = 'validation' AND len(w) > 1) SELECT document_id AS id, count(*) AS targets, round(sum(-ln((coalesce(c, 0) + 0.1) / (coalesce(total, 0) + 0.1 * {V}))), 4) AS nll FROM v LEFT JOIN j ON j.gram = w[i - 1] || ' ' || w[i] LEFT JOIN x ON x.ctx = w[i - 1] GROUP BY document_id"
)
def add_k_bigram_nll(spark: S, sf: str) -> D:
    return ngrams.add_k_scores(_tokens(spark, sf, "train"), _tokens(spark, sf, "validation"), "document_id", "w", 2, V).withColumn("nll", F.round("nll", 4))


@query(f"WITH {RECORDS_SQL}, {TOK}, p AS (SELECT split, list_sort(list(len(w))) AS s, sum(len(w)) AS t, sum(bytes) AS b FROM tok WHERE split IS NOT NULL GROUP BY split) SELECT split, round(t / b, 6) AS tokens_per_byte, round(t / len(s), 6) AS mean, s[(floor(0.5 * (len(s) - 1)) + 1)::BIGINT] AS p50, s[(floor(0.95 * (len(s) - 1)) + 1)::BIGINT] AS p95 FROM p")
def tokenizer_length_metrics(spark: S, sf: str) -> D:
    """Tokens a byte, mean and floor-index percentiles of tokens a document; lengths are counted first, so a split's sorted array is as long as its lengths are different."""
    rows = records(spark, sf, "split", "text").where("text is not null and split is not null").select(split_name().alias("split"), X.word_count(F.col("text")).cast("long").alias("n"), F.octet_length("text").cast("long").alias("b"))
    return K.length_metrics(rows, "split", "n", "b")


@query()
def bpe_token_counts(spark: S, sf: str) -> D:
    """Tokens and bytes a source by a public byte-level vocabulary."""
    rows = table(spark, sf, "documents").select("source", "text", K.token_count(F.col("text")).alias("tokens"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("utf8_bytes"))


@query()
def probe_groups(spark: S, sf: str) -> D:
    """Probe records dealt into groups of one size; those whose title recurs have a sibling."""
    r = records(spark, sf, "split", "title").where(split_name() == "probe")
    twice = records(spark, sf, "title").groupBy("title").agg(F.count("*").alias("n"))
    rows = r.join(twice, "title", "left").select("document_id", (F.coalesce("n", F.lit(0)) > 1).alias("sib"))
    return probes.deal_groups(rows, "document_id", "sib", 500, 5, 17012)


@query()
def edited_siblings(spark: S, sf: str) -> D:
    """Probe records edited towards the similarity of their group; rows within tolerance and their similarities."""
    rows = records(spark, sf, "split", "text").where((split_name() == "probe") & F.col("text").rlike(r"(?U)(\S+\s+){20}"))
    target = F.element_at(F.array(*(F.lit(t) for t in (0.9, 0.8, 0.65, 0.5))), (F.pmod(F.xxhash64("document_id"), F.lit(4)) + 1).cast("int"))
    words = [w for w in X.FUNCTION_WORDS if len(w) > 3]
    made = probes.edited_siblings(rows.withColumn("target", target), "document_id", "text", "target", words, 17012)
    return made.select(F.concat(F.lit("sib_"), "id").alias("sibling_id"), F.round("jaccard", 6).alias("jaccard"), "substitutions", "within_tolerance")


def _canaries(spark: S, sf: str) -> D:
    vocabulary = [r.word for r in probes.vocabulary(SplitReader(records(spark, sf, "split", "text").where("text is not null")).training_texts(), 20).select("word").collect()]
    return probes.canary_copies(probes.canaries(spark, sorted(vocabulary), [1, 4, 16], 8, 99, 32, 17012))


@query()
def canary_copies(spark: S, sf: str) -> D:
    """Inserted canaries as often as their multiplicity says, of words that training texts have."""
    return _canaries(spark, sf).select("canary_id", "copy")


@query()
def sibling_sets(spark: S, sf: str) -> D:
    """Siblings of probe records by group: exact copies, accepted training records of the same title, and edits."""
    r = records(spark, sf, "split", "title", "text", "is_representative").where("text is not null")
    held = written(r.where((split_name() == "probe") & F.col("text").rlike(r"(?U)(\S+\s+){20}")).select("document_id", "title", "text"))
    train = written(r.where(split_name() == "train").select("document_id", "title", "text", F.coalesce("is_representative", F.lit(False)).alias("accepted")))
    audit = written(probes.sibling_audit(held, train).select("document_id", "sibling_id", (F.col("reason") == "accepted").alias("sib")))
    groups = probes.deal_groups(audit, "document_id", "sib", 500, 5, 17012).join(held.select(F.col("document_id").alias("id"), "text"), "id")
    matches = audit.where("sib").select(F.col("document_id").alias("id"), F.col("sibling_id").alias("s")).join(train.select(F.col("document_id").alias("s"), "text"), "s")
    made = probes.sibling_sets(groups, matches, [w for w in X.FUNCTION_WORDS if len(w) > 3], 17012)
    return made.select("sibling_id", "document_id", "group", "source", F.sha2("text", 256).alias("sha256"), F.round("jaccard", 6).alias("jaccard"), "substitutions", "within_tolerance")


@query()
def canary_positions(spark: S, sf: str) -> D:
    """Where canary copies stand in the shuffled training documents."""
    train = records(spark, sf, "split", "text").where((split_name() == "train") & F.col("text").isNotNull()).select(F.col("document_id").alias("id"), "text")
    made = probes.packing_order(train, _canaries(spark, sf), 17012)
    return made.where(F.col("id").startswith("canary_")).select("id", "position")


@query()
def fraction_subsets(spark: S, sf: str) -> D:
    """Count and digest of a quarter and an eighth of the training documents."""
    train = written(records(spark, sf, "split", "text").where((split_name() == "train") & F.col("text").isNotNull()).select(F.col("document_id").alias("id")))
    out = None
    for f in (4, 8):
        d = probes.set_digest(probes.fraction_subset(train, f, 17012), "id").withColumn("fraction", F.lit(f))
        out = d if out is None else out.union(d)
    return out


@query(f"WITH {RECORDS_SQL}, k AS (SELECT lower(trim(split)) AS split, sha256(document_id) AS h FROM rec), s AS (SELECT split, count(*) AS n, {_PARTS} FROM k WHERE split IN {SPLIT_LIST} GROUP BY split) SELECT split, n, {_DIGEST} AS digest FROM s")
def training_set_digest(spark: S, sf: str) -> D:
    """Count and order-independent digest of each split's documents."""
    rows = records(spark, sf, "split").select("document_id", split_name().alias("split")).where(F.col("split").isin(*SPLITS))
    return probes.set_digest(rows, "document_id", ["split"])


@query()
def epoch_positions(spark: S, sf: str) -> D:
    """Where training documents stand in the third epoch, with those of the probe set among them, from the hundredth place on."""
    r = records(spark, sf, "split").select("document_id", split_name().alias("split"))
    return probes.epoch_order(r.where("split = 'train'"), 3, 17012, r.where("split = 'probe'"), "document_id", 100)


@query("SELECT * FROM (SELECT unnest(range(0, 100)) AS step) s, LATERAL (SELECT round(CASE WHEN step < 5 THEN (step + 1) / 5.0 WHEN step < 80 THEN 1.0 ELSE 0.1 + 0.9 * (1 - sqrt(least(1.0, (step - 80) / 20.0))) END, 9) AS multiplier)")
def rate_schedule(spark: S, sf: str) -> D:
    return ST.schedule(spark.range(100).withColumnRenamed("id", "step"), "step", "wsd", 100, 5, 80).withColumn("multiplier", F.round("multiplier", 9))


@query("SELECT s AS size, p AS passes, e AS seed, 'm0-' || s || '-e' || p || '-s' || e AS name FROM (SELECT unnest(['4m', '10m', '29m']) AS s), (SELECT unnest([1, 2, 4, 8]) AS p), (SELECT unnest([0, 1, 2]) AS e)")
def experiment_plan(spark: S, sf: str) -> D:
    t = lambda v, c: spark.createDataFrame([(x,) for x in v], c)
    return ST.experiment_plan(t(["4m", "10m", "29m"], "size string"), t([1, 2, 4, 8], "passes int"), t([0, 1, 2], "seed int"))


_TYPES = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]+'))"


@query(
    f"WITH {RECORDS_SQL}, p AS (SELECT document_id, title, text FROM rec WHERE lower(trim(split)) <> 'train'), c AS (SELECT title, max(document_id) AS sid FROM rec WHERE lower(trim(split)) = 'train' AND title IS NOT NULL GROUP BY title), "
    f"j AS (SELECT p.document_id, p.title, c.sid, {_TYPES.format('p.text')} AS a, {_TYPES.format('r.text')} AS b, coalesce(r.is_representative, FALSE) AS ok FROM p LEFT JOIN c USING (title) LEFT JOIN rec r ON r.document_id = c.sid), "
    "o AS (SELECT *, CASE WHEN sid IS NOT NULL THEN CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END END AS overlap FROM j) "
    "SELECT document_id, title, sid AS sibling_id, round(overlap, 6) AS overlap, CASE WHEN sid IS NULL THEN 'missing' WHEN NOT ok THEN 'quality' WHEN overlap > 0.8 THEN 'overlap' ELSE 'accepted' END AS reason FROM o"
)
def sibling_audit(spark: S, sf: str) -> D:
    """Held-out records and training records of the same title."""
    r = records(spark, sf, "split", "title", "text", "is_representative")
    out = probes.sibling_audit(r.where(split_name() != "train").select("document_id", "title", "text"), r.where(split_name() == "train").select("document_id", "title", "text", F.coalesce("is_representative", F.lit(False)).alias("accepted")))
    return out.withColumn("overlap", F.round("overlap", 6))


@query(
    f"WITH {RECORDS_SQL}, r AS (SELECT lower(trim(split)) AS s, document_id, sha256(text) AS t FROM rec WHERE len({words_sql('text')}) >= 96), k AS (SELECT s, sha256(s || ':' || document_id || ':' || t) AS h FROM r WHERE s IN ('validation', 'test', 'probe', 'cloze_reserve')), "
    f"g AS (SELECT coalesce(s, 'all') AS section, count(*) AS n, {_PARTS} FROM k GROUP BY ROLLUP (s)) SELECT section, n, {_DIGEST} AS digest FROM g"
)
def evaluation_bundle(spark: S, sf: str) -> D:
    """Counts and digests of the held-out sets of records with at least 96 words, and of all together."""
    r = records(spark, sf, "split", "text").where(X.word_count(F.col("text")) >= 96).select("document_id", split_name().alias("split"), F.sha2("text", 256).alias("sha256"))
    return probes.bundle({s: r.where(F.col("split") == s) for s in ("validation", "test", "probe", "cloze_reserve")})


@query()
def sibling_similarity_summary(spark: S, sf: str) -> D:
    """Similarities of edited siblings by their target."""
    rows = records(spark, sf, "split", "text").where((split_name() == "validation") & F.col("text").rlike(r"(?U)(\S+\s+){40}"))
    words = [w for w in X.FUNCTION_WORDS if len(w) > 3]
    out = None
    for name, target in (("B90", 0.9), ("B80", 0.8), ("B65", 0.65), ("B50", 0.5)):
        s = probes.edited_siblings(rows.withColumn("target", F.lit(target)), "document_id", "text", "target", words, 17012).withColumn("group", F.lit(name))
        out = s if out is None else out.union(s)
    s = probes.similarity_summary(out, "group", "jaccard", "within_tolerance")
    return s.select("group", "n", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")), "outside")


@query(f"WITH {RECORDS_SQL} SELECT (SELECT count(*) FROM (SELECT title FROM rec INTERSECT SELECT title FROM category_listing)) AS both_sides, (SELECT count(*) FROM (SELECT title FROM rec UNION SELECT title FROM category_listing)) AS either, (SELECT count(*) FROM (SELECT title FROM rec EXCEPT SELECT title FROM category_listing)) AS records_only, (SELECT count(*) FROM (SELECT title FROM rec UNION ALL SELECT title FROM category_listing)) AS all_rows")
def title_set_operations(spark: S, sf: str) -> D:
    """Titles of records and of listings as sets and as bags."""
    a, b = records(spark, sf, "title").select("title"), table(spark, sf, "category_listing").select("title")
    n = lambda df, c: df.agg(F.count("*").alias(c))
    parts = [n(a.intersect(b), "both_sides"), n(a.union(b).distinct(), "either"), n(a.subtract(b), "records_only"), n(a.unionByName(b), "all_rows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query(f"WITH {RECORDS_SQL} SELECT document_id FROM rec WHERE lower(trim(split)) = 'train' ORDER BY sha256('17012|' || document_id), document_id LIMIT 500")
def seeded_sample(spark: S, sf: str) -> D:
    """500 training records, or all if there are fewer, the same in every run."""
    return probes.sampled(records(spark, sf, "split").where(split_name() == "train").select("document_id"), "document_id", 500, 17012)
