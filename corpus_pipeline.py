"""Training text from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what it
returns as Parquet into the shared folder and reads it again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontam, mixing, neardup, pii, quality
from loomwork.llm.common import new_folder

#: SQL cannot express the stages that learn, sketch or align; they are tested against
#: brute-force versions.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item stands."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), exact_short=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars counted anew."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated towards the target weights of their sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Null or empty texts are judged by the quality stage like others, are no one's near copy and
    hold no benchmark item. Rows with one id are one document to the near-duplicate stage, which
    keeps one row of an id (null ids aside, which all stay) and of equals the one of the least
    id; mixing draws by id, for rows without one by text. Extra columns pass all stages
    unchanged, but for those named as the four that mixing adds, which it replaces. An empty
    table gives an empty one; without labels of both kinds every document is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
