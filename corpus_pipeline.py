"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, tokens.

Every stage works on all that the one before kept.  `run` writes each stage's
result to the session's shared folder and reads it again, so a lost executor
costs one stage at most.

Rows with null or empty texts stay and have no tokens; texts of any length are taken
whole.  Of equal or near texts, and of rows of one id, one row of the smallest id
stays; rows without id are nobody's copies, but go like others where they are poor or
hold a benchmark item.  Without labels nothing is rejected.  No rows give no rows.
Further columns of any name stay as they are, but for token_ids, n_tokens and
round_trip, which the last stage replaces, and n_chars, which follows the text.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.decontam import clean_documents
from sessionlens.llm.minhash import one_of_each_group
from sessionlens.llm.pii import pseudonymise, surrogate_key
from sessionlens.llm.quality import good_documents
from sessionlens.llm.sentencepiece_fst import encode
from sessionlens.llm.store import release, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over five-word shingles the smallest id stays."""
    return one_of_each_group(docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the new text."""
    out = pseudonymise(docs, surrogate_key(spark), report=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents plus token_ids, n_tokens and round_trip (the ids decode to the text; null for null)."""
    return encode(docs, check="round_trip").withColumn("n_tokens", F.coalesce(F.size("token_ids"), F.lit(0)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("pii surrogates", replace_personal_data),
    ("sentencepiece", tokenise),
]

# Stages fit models, link sets and search automata: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        release(spark)
    return docs
