"""Queries of the numbered operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embeddings, langid, minhash, mixing, parsing, quality, rules, secrets, transducer, viterbi, warc, whitening
from .common import table

def vocabulary() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return wrap


@query("op7_mix_sources", mixing.ORACLE)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling over all documents."""
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op9_secret_scan", secrets.ORACLE)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, told from copied examples by ownership."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op2_warc_archives", warc.ORACLE)
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    root = warc.fresh_root(spark)
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: doc_id, n_tokens, token_ids, and whether the decoded text
    is the text (it is, unless the text holds the vocabulary's own blank mark)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = viterbi.decode(viterbi.encode(docs, vocabulary()), vocabulary())
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return transducer.count(table(spark, sf_dir, "documents"), vocabulary())


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; trained on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "known")


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return parsing.fingerprint(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents; sources are the hosts, languages their paths."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_minhash_dedup", minhash.ORACLE)
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return (minhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id", "kept"))


@query("op1_embedding_dedup", embeddings.ORACLE)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_quality_rules", rules.ORACLE)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table over all documents."""
    return (rules.judge(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


@query("op12_source_divergence", divergence.ORACLE)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all vectors."""
    return whitening.components_of(table(spark, sf_dir, "embeddings"))
