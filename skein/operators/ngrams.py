"""Count-based language models as tables: add-k and interpolated Kneser-Ney.

A document is an array of tokens (as strings without blanks). N-grams are
their tokens joined by a blank, never across documents. Counts are grouped
sums with partial counts before the shuffle; scoring counts equal cases first
and then joins one table an order, on the n-gram or its context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import written


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def head(gram: Column) -> Column:
    """The n-gram without its last token; empty for one token."""
    return F.regexp_replace(gram, r" ?[^ ]+$", "")


def tail(gram: Column) -> Column:
    return F.regexp_replace(gram, r"^[^ ]+ ?", "")


def counts(docs: DataFrame, tokens: str, n: int) -> DataFrame:
    """(gram, c) of all runs of n tokens."""
    return docs.select(F.explode(grams(F.col(tokens), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))


def kneser_ney_tables(docs: DataFrame, tokens: str, order: int) -> list[tuple[DataFrame, DataFrame, float]]:
    """For every length up to order: (gram, c), (context, total, types) and the discount.

    The longest n-grams have their counts, shorter ones the number of
    different tokens that come before them. The discount is n1 / (n1 + 2 n2),
    or 0.5 without an n1.
    """
    out = []
    longer = written(counts(docs, tokens, order))
    for n in range(order, 0, -1):
        own = longer if n == order else written(longer.groupBy(tail(F.col("gram")).alias("gram")).agg(F.count("*").alias("c")))
        once, twice = own.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        contexts = own.groupBy(head(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        out.append((own, contexts, once / (once + 2 * twice) if once else 0.5))
        if n > 1:  # all n-grams of this length, for what precedes the shorter ones
            longer = own if n == order else written(counts(docs, tokens, n).select("gram", "c"))
    return out[::-1]


def cases(docs: DataFrame, id: str, tokens: str, order: int) -> DataFrame:
    """(id, gram, length, n): every token but a document's first with up to order - 1 before it, equal ones counted."""
    t = F.col(tokens)
    each = F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(2), F.size(t)), lambda i: F.array_join(F.slice(t, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))), " "))).otherwise(F.array().cast("array<string>"))
    return docs.select(F.col(id).alias("id"), F.explode(each).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n")).withColumn("length", F.size(F.split("gram", " ")))


def kneser_ney_scores(docs: DataFrame, id: str, tokens: str, tables: list[tuple[DataFrame, DataFrame, float]], vocabulary: int) -> DataFrame:
    """(id, targets, nll): every document's tokens but the first, under the model.

    From 1 / vocabulary upwards, each order interpolates its discounted count
    with the order below. A context that was never seen, or a history that is
    too short, leaves the lower order's probability as it is.
    """
    order = len(tables)
    case = written(cases(docs, id, tokens, order))
    now = case.select("gram", "length").distinct().withColumn("p", F.lit(1.0 / vocabulary))
    for n, (own, contexts, d) in enumerate(tables, start=1):
        # the last n tokens
        suffix = F.when(F.col("length") >= n, F.regexp_extract("gram", rf"((?:[^ ]+ ){{{n - 1}}}[^ ]+)$", 1))
        rows = now.withColumn("g", suffix).withColumn("x", head(F.col("g")))
        rows = rows.join(own.select(F.col("gram").alias("g"), "c"), "g", "left").join(contexts.select(F.col("context").alias("x"), "total", "types"), "x", "left")
        mixed = F.greatest(F.coalesce("c", F.lit(0)) - F.lit(d), F.lit(0.0)) / F.col("total") + F.lit(d) * F.col("types") / F.col("total") * F.col("p")
        now = rows.select("gram", "length", F.when(F.col("g").isNotNull() & F.col("total").isNotNull(), mixed).otherwise(F.col("p")).alias("p"))
    return case.join(now.select("gram", "p"), "gram").groupBy("id").agg(F.sum("n").alias("targets"), F.sum(-F.log("p") * F.col("n")).alias("nll"))


def segments(windows: DataFrame) -> DataFrame:
    """(window, segment, document_id, w): each document's part of each packed window, as tokens; pads are left out."""
    z = F.arrays_zip(F.col("input_ids").alias("t"), F.col("segment_ids").alias("s"))
    parts = F.transform("document_ids", lambda d, i: F.struct(i.alias("segment"), d.alias("document_id"), F.transform(F.filter(z, lambda x: x["s"] == i), lambda x: x["t"].cast("string")).alias("w")))
    return windows.select("window", F.inline(parts))


def add_k_scores(train: DataFrame, held_out: DataFrame, id: str, tokens: str, order: int, vocabulary: int, k: float = 0.1) -> DataFrame:
    """(id, targets, nll) under (count + k) / (context count + k * vocabulary).

    At a document's start contexts are as short as they are, and count as
    contexts of their own; a document's first token isn't scored.
    """
    t = F.col(tokens)
    each = lambda first: F.when(F.size(t) >= first, F.transform(F.sequence(F.lit(first), F.size(t)), lambda i: F.array_join(F.slice(t, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))), " "))).otherwise(F.array().cast("array<string>"))
    joint = train.select(F.explode(each(1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    context = joint.groupBy(head(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"))
    case = cases(held_out, id, tokens, order).withColumn("context", head(F.col("gram")))
    rows = case.join(joint, "gram", "left").join(context, "context", "left")
    p = (F.coalesce("c", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * vocabulary)
    return rows.groupBy("id").agg(F.sum("n").alias("targets"), F.sum(-F.log(p) * F.col("n")).alias("nll"))
