"""The corpus's manifest: its schema, its records, and access to their texts by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.latest import latest_per_key, utc_instant
from skein.sources.tables import table

SPLITS = ("train", "validation", "test", "probe", "cloze_reserve", "excluded")
_s, _a = T.StringType(), T.ArrayType(T.StringType())
# The manifest's columns in order, and the names of splits; text is kept apart.
MANIFEST = T.StructType(
    [
        *(T.StructField(c, _s) for c in ("document_id", "source", "source_record_id", "title", "canonical_url", "revision_id", "published_at", "retrieved_at")),
        T.StructField("author_attribution", _a),
        *(T.StructField(c, _s) for c in ("license_id", "license_url", "rights_notes", "raw_sha256", "clean_sha256", "pipeline_version")),
        T.StructField("language_score", T.DoubleType()),
        T.StructField("quality_flags", _a),
        T.StructField("dedup_cluster_id", _s),
        T.StructField("split", _s),
        T.StructField("rejection_reasons", _a),
        T.StructField("is_representative", T.BooleanType()),
        T.StructField("quality_score", T.DoubleType()),
    ]
)


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """document_id and the columns of each document's row with the latest retrieved_at."""
    rows = table(spark, folder, "astronomy_sample").select("document_id", "retrieved_at", *columns)
    return latest_per_key(rows, "document_id", utc_instant("retrieved_at").desc_nulls_last()).drop("retrieved_at")


def split_name(c: Column | str = "split") -> Column:
    """A split name as compared: trimmed, lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def manifest_view(df: DataFrame) -> DataFrame:
    """The manifest's columns in order, without the text."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST))


def contract_violations(df: DataFrame) -> DataFrame:
    """(rule, violations): rows against the closed rules of the manifest, one pass."""
    missing = [f.name for f in MANIFEST if f.name not in ("published_at", "quality_score", "is_representative", "rejection_reasons")]
    rules = {
        "document_id_form": ~F.col("document_id").rlike(r"^doc_[a-z0-9_]+_[A-Za-z0-9._-]+$"),
        "raw_sha256_form": ~F.col("raw_sha256").rlike("^[0-9a-f]{64}$"),
        "clean_sha256_form": ~F.col("clean_sha256").rlike("^[0-9a-f]{64}$"),
        "language_score_range": ~F.col("language_score").between(0, 1),
        "split_name": ~F.col("split").isin(*SPLITS),
        "missing_required": sum((F.col(c).isNull().cast("int") for c in missing), F.lit(0)) > 0,
    }
    sums = df.agg(*(F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("x")).select("x.*")


class SplitReader:
    """Texts of one split, held-out ones only for those who ask for them.

    train is open; validation, probe, cloze_reserve and excluded need
    allow_eval, test needs allow_final_eval and nothing else opens it.
    """

    def __init__(self, rows: DataFrame, texts: DataFrame | None = None) -> None:
        self.rows, self.texts = rows, texts

    def texts_of(self, split: str, allow_eval: bool = False, allow_final_eval: bool = False) -> DataFrame:
        """(document_id, text) of the split; a document without text makes the query fail."""
        if split not in SPLITS:
            raise ValueError(f"unknown split {split!r}")
        if split == "test" and not allow_final_eval or split not in ("train", "test") and not allow_eval:
            raise PermissionError(f"the split {split} is not open")
        ids = self.rows.where(split_name() == split)
        joined = ids.select("document_id", "text") if self.texts is None else ids.select("document_id").join(self.texts.select("document_id", "text"), "document_id", "left")
        return joined.select("document_id", F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text: "), "document_id"))).otherwise(F.col("text")).alias("text"))

    def training_texts(self) -> DataFrame:
        return self.texts_of("train")

    def training_bytes(self) -> DataFrame:
        return self.training_texts().agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("utf8_bytes"))
