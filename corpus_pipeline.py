"""A training corpus from the documents: toxicity, near duplicates, benchmark leaks, personal data, mix.

Each stage works on all rows that the one before kept, written as Parquet and read again. The first three
filter, the fourth masks personal data in the texts, the last keeps what the mix takes and says how much.

Defined results: a null or empty text is no copy, no leak, has nothing to mask and takes nothing in the mix,
so it goes in the last stage; a row with a null id is no near duplicate of any; empty tables give empty
results; columns beyond those of ``documents`` are carried along to the end, but for names that begin with
an underscore and, in the last stage, size, source_size, target and taken, which it sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasorlake.llm import decontaminate, mixing, neardup, pii, toxicity
from phasorlake.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted classifier finds toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score(docs.withColumnRenamed("score", "_given_score"), model)
    return scored.where(F.col("score") < 0.5).drop("score").withColumnRenamed("_given_score", "score").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles and 0.8 or more, the smallest id stays."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    sized = docs.drop("size", "source_size", "target", "taken").withColumn("size", mixing.word_count(F.col("text")))
    narrow = stored(sized.select("doc_id", "source", "size"), "mix-sizes")
    return mixing.mix(sized, narrow=narrow).where("taken > 0")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", masked),
    ("mixing", mixed),
]
#: A classifier is fitted and similarity is searched: not for SQL. tests/llm holds each stage but the first
#: against brute force, and the first against its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
