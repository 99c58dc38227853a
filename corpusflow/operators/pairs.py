"""Training pairs from chunks.

One ``explode`` over a CASE that builds the pairs of each chunk type; no
shuffle, so pair generation is a narrow map at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import describe, ids

# Prompt templates, and the reference's cut lengths (for callers who want its cuts).
METHOD_EXPLAIN_PREFIX = "Explain this Java method:\n\n"
METHOD_QA = ("What does the method '", "' do in class '", "'?")
METHOD_USAGE = ("How to use the ", "() method?\n\nMethod code:\n")
CLASS_EXPLAIN_PREFIX = "Explain this Java class:\n\n"
CLASS_QA = ("What is the purpose of the '", "' class?")
FILE_EXPLAIN_PREFIX = "Summarize the purpose of this Java file:\n\n"
CLASS_CUT = 1000
FILE_CUT = 800
ELLIPSIS = "..."

PAIR_COLUMNS = ["pair_id", "input_text", "output_text", "chunk_id", "pair_type", "tags",
                "created_at", "version"]
INSTRUCTION = "Explain this code"


def _pair(ordinal: int, pair_type: str, input_text: Column, output_text: Column,
          tags: list[Column]) -> Column:
    return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(pair_type).alias("pair_type"),
                    input_text.alias("input_text"), output_text.alias("output_text"),
                    F.array(*tags).alias("tags"))


def generate_pairs(chunks: DataFrame, created_at: Column | None = None, version: int = 1,
                   file_type_name: str | None = None, carry: list[str] | None = None,
                   class_cut: int | None = None, file_cut: int | None = None) -> DataFrame:
    """U4: three pairs per method, two per class, one per file chunk.

    ``file_type_name`` replaces the word "Java" in the file prompt (the
    reference always says Java); the default keeps the reference text. Class and file texts are
    whole, unless ``class_cut`` / ``file_cut`` (CLASS_CUT, FILE_CUT) name a length, after which
    ``...`` stands.
    """
    c = F.col
    code, name, kind = c("code_content"), c("chunk_name"), c("chunk_type")
    parent = c("parent_class")
    parent_or_empty = F.coalesce(parent, F.lit(""))
    desc = describe.fallback_description(c("description"), kind, name, parent, c("file_path"))
    file_prefix = FILE_EXPLAIN_PREFIX if file_type_name is None else \
        FILE_EXPLAIN_PREFIX.replace("Java", file_type_name)
    cut = lambda n: code if n is None else F.concat(F.substring(code, 1, n), F.lit(ELLIPSIS))
    method_pairs = F.array(
        _pair(1, "explain_method", F.concat(F.lit(METHOD_EXPLAIN_PREFIX), code), desc,
              [kind, F.lit("method_explanation"), parent_or_empty]),
        _pair(2, "qa", F.concat(F.lit(METHOD_QA[0]), name, F.lit(METHOD_QA[1]),
                                F.coalesce(parent, F.lit("None")), F.lit(METHOD_QA[2])), desc,
              [kind, F.lit("method_qa"), parent_or_empty]),
        _pair(3, "explain_logic", F.concat(F.lit(METHOD_USAGE[0]), name, F.lit(METHOD_USAGE[1]), code),
              describe.usage_text(code, name), [kind, F.lit("method_usage"), parent_or_empty]),
    )
    class_pairs = F.array(
        _pair(1, "explain_class", F.concat(F.lit(CLASS_EXPLAIN_PREFIX), cut(class_cut)), desc, [kind, F.lit("class_explanation")]),
        _pair(2, "qa", F.concat(F.lit(CLASS_QA[0]), name, F.lit(CLASS_QA[1])), desc,
              [kind, F.lit("class_qa")]),
    )
    file_pairs = F.array(
        _pair(1, "explain_file", F.concat(F.lit(file_prefix), cut(file_cut)), desc,
              [kind, F.lit("file_explanation")]),
    )
    per_chunk = (F.when(kind == "method", method_pairs).when(kind == "class", class_pairs)
                 .when(kind == "file", file_pairs))
    exploded = chunks.select("chunk_id", *(carry or []), F.explode(per_chunk).alias("p"))
    return exploded.select(
        ids.pair_id(c("chunk_id"), c("p.pair_type"), c("p.ordinal")).alias("pair_id"),
        c("p.input_text").alias("input_text"),
        c("p.output_text").alias("output_text"),
        "chunk_id",
        c("p.pair_type").alias("pair_type"),
        c("p.tags").alias("tags"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        F.lit(version).cast(T.IntegerType()).alias("version"),
        *(carry or []),
    )


def pairs_by_type(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3: pair counts by type (per project/version when those keys are given)."""
    keys = list(keys or [])
    return pairs.groupBy(*keys, "pair_type").agg(F.count(F.lit(1)).alias("n_pairs"))


def content_key(pairs: DataFrame, normalised: bool = False) -> Column:
    """Hash of a pair's texts; a null text is no text, and unlike any. ``normalised``: of the texts in lower case
    without blanks around them."""
    texts = [F.lower(F.trim(pairs[c])) if normalised else pairs[c] for c in ("input_text", "output_text")]
    key = F.sha2(F.concat_ws("\u0000", *[F.coalesce(t, F.lit("")) for t in texts]), 256)
    return F.concat(key, *[F.when(t.isNull(), f"-no{k}").otherwise("") for k, t in enumerate(texts)])


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with equal normalised texts, one row: the one with the least id (null last), of those
    with the least texts. All columns stay. Each partition keeps its first row of a key before the
    shuffle, so a pair that a third of all rows repeat reaches one task once a partition."""
    w = Window.partitionBy("_k").orderBy(F.asc_nulls_last("pair_id"), F.asc_nulls_last("input_text"), F.asc_nulls_last("output_text"))
    keyed = pairs.withColumn("_k", content_key(pairs, normalised=True))
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def split_train_eval(pairs: DataFrame, eval_share: float = 0.1) -> DataFrame:
    """``split`` = 'eval' for about ``eval_share`` of the distinct texts, else 'train'. The split is
    by the texts' hash: it needs no shuffle, repeats itself, and keeps equal pairs on one side."""
    cut = f"{round(eval_share * (1 << 32)):08x}"
    side = F.when(F.lit(eval_share >= 1) | (F.substring(content_key(pairs), 1, 8) < cut), F.lit("eval")).otherwise(F.lit("train"))
    return pairs.withColumn("split", side)


def export_instruction_pairs(files: DataFrame, ext: str = ".java",
                             instruction: str = INSTRUCTION) -> DataFrame:
    """(file text, constant instruction) rows for files of one extension."""
    return files.where(F.col("ext") == ext).select(
        F.col("content").alias("input"), F.lit(instruction).alias("output"))
