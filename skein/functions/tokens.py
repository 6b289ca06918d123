"""Token counts and ids by public byte-level vocabularies, and tokenizer metrics."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_made: dict = {}


def encoding(path: str):
    """The vocabulary of a rank file, made once a process; strings of special tokens are ordinary text."""
    if path not in _made:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def token_ids(text: Column, path: str = TOKENIZER) -> Column:
    """The text's token ids; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        made = iter(encoding(path).encode_ordinary_batch([t for t in texts if t is not None], num_threads=1))
        return pd.Series([None if t is None else next(made) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def token_text(ids: Column, path: str = TOKENIZER) -> Column:
    """The text of token ids: what token_ids was given."""

    def run(rows: pd.Series) -> pd.Series:
        decode = encoding(path).decode
        return rows.map(lambda t: None if t is None else decode(list(map(int, t))))

    return F.pandas_udf(run, "string")(ids)


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """How many tokens the text has; 0 for null. Ids stay in Python."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(len, encoding(path).encode_ordinary_batch(texts.tolist(), num_threads=1))), dtype="int64")

    return F.pandas_udf(run, "long")(F.coalesce(text, F.lit("")))


def length_metrics(df: DataFrame, by: str, n: str, size: str) -> DataFrame:
    """(by, tokens_per_byte, mean, p50, p95) of documents with n tokens and size bytes; percentiles take the floor of share * (count - 1)."""
    c = df.groupBy(by, n).agg(F.count("*").alias("c"), F.sum(size).alias("s"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(n))  # one row a length
    rows = c.withColumn("upto", upto).withColumn("all", F.sum("c").over(Window.partitionBy(by)))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.lit(share) * (F.col("all") - 1)), F.col(n)))
    total = F.sum(F.col(n) * F.col("c"))
    return rows.groupBy(by).agg(F.round(total / F.nullif(F.sum("s"), F.lit(0)), 6).alias("tokens_per_byte"), F.round(total / F.sum("c"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def fragmentation(spark, terms: list[str], path: str = TOKENIZER) -> DataFrame:
    """(tokens_per_term): mean tokens of a list of terms, each with a blank before it as in running text."""
    df = spark.createDataFrame([(" " + t,) for t in terms], "term string")
    return df.select(token_count(F.col("term"), path).alias("n")).agg(F.avg("n").alias("tokens_per_term"))
