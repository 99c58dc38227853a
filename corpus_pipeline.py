"""The corpus pipeline: documents in, token ids out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of ``corpusflow.llm``
on all rows that it is given; ``run`` writes every stage's rows as Parquet in the shared folder and
reads them back for the next one.

Defined results: documents without a letter (null texts too) go, and those of at least ``langid.ENOUGH_LETTERS`` letters
that know far fewer n-grams of their predicted language than its own training rows do, so a language that no row is
labelled with goes even if it shares the alphabet; shorter documents with a letter stay; of near-duplicates
(five-word shingles, similarity 0.8 or more) the row with the least doc_id stays, once; secrets are masked in the text;
the mix repeats or drops whole documents; the last stage adds token ids. Empty tables pass through;
columns beyond those of ``documents`` pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import langid, minhash, mixing, secrets, viterbi
from corpusflow.llm.common import keep_as_table
from corpusflow.llm.queries import vocabulary
from corpusflow.shipping import ship

#: A document is rejected below this part of the share of known n-grams that 99 % of its language's training rows reach.
LEAST_PART = 0.6
SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; the others get the predicted one as ``lang``."""
    ship(spark)
    model = langid.fit(docs, sample=None)
    found = langid.identify(docs, model, out=("_pred", "_score", "_known"))
    # written once: the thresholds are taken from all of its labelled rows
    found = keep_as_table(found.withColumn("_letters", langid.letters(F.col("text"))), "language-found")
    least = F.lit(0.0)
    for lang, share in langid.low_shares(found, model, found=("_known", "_letters")).items():
        least = F.when(F.col("_pred") == lang, LEAST_PART * share).otherwise(least)
    foreign = (F.col("_known") < least) & (F.col("_letters") >= langid.ENOUGH_LETTERS)
    return (found.filter((F.col("_pred") != langid.NONE) & ~foreign)
            .withColumn("lang", F.col("_pred")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    ship(spark)
    return minhash.deduplicate(docs, SIMILARITY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    ship(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its target."""
    ship(spark)
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts: documents' columns and ``token_ids``."""
    ship(spark)
    return viterbi.encode(docs, vocabulary(), keep_store=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mix", mix), ("tokens", tokens)]

#: Language models and piece tables are not SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = keep_as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
