"""Retrieval for a whole table of questions.

The reference scans every chunk for every question. Here both sides are
exploded into (id, term) rows and joined on the term, so only pairs that
share a term meet; shared-term counts are partially aggregated before the
shuffle, and the per-question top-k is a row_number filter that Spark plans
as a WindowGroupLimit (a per-partition top-k before the exchange).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# Prompt pieces, relevance label and confidence rule.
CONTEXT_HEADER = "RELEVANT CODE CONTEXT:\n"
SNIPPET_CUT = 300
QUESTION_PREFIX = "\n\nQUESTION: "
ANSWER_SUFFIX = "\n\nANSWER:"
ANSWER_MARK = "ANSWER:"
RELEVANCE = "high"
CONF_BASE, CONF_STEP = 0.4, 0.3
TOP_K = 3
PROMPT_TOP_K = 2
# Question prompts by query type (explain_method with and without a class,
# explain_class, explain_file, explain_logic, find_related).
PROMPT_METHOD_IN_CLASS = ("Explain what the method '", "' does in the class '", "'.")
PROMPT_METHOD = ("Explain what the method '", "' does.")
PROMPT_CLASS = ("What is the purpose of the '", "' class and what are its main responsibilities?")
PROMPT_FILE = ("Summarize the purpose and main components of the file '", "'.")
PROMPT_LOGIC = "Explain the logic of this code snippet:\n\n"
PROMPT_RELATED = ("What other methods, classes, or files are related to '", "'?")

# Whitespace of ``str.split()``: ASCII controls \t-\r and \x1c-\x1f, space,
# NEL, NBSP, and the Unicode space separators and line/paragraph separators.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def terms(text: Column) -> Column:
    """Lower-cased, whitespace-split, distinct terms."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), WHITESPACE), ""))


def jaccard(a: Column, b: Column) -> Column:
    """X14 for two term arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def chunk_order(chunks: DataFrame) -> DataFrame:
    """Adds ``_ord`` (file, line, file < class < method): ties go in file order."""
    rank = F.when(F.col("chunk_type") == "file", 0).when(F.col("chunk_type") == "class", 1).otherwise(2)
    return chunks.withColumn("_ord", F.struct(F.col("file_path"), F.col("start_line"), rank.alias("k")))


def _snippet(cut: int | None) -> Column:
    """The part of a chunk that a prompt shows: ``cut`` characters, or all of it."""
    return F.col("code_content") if cut is None else F.substring("code_content", 1, cut)


def retrieval_index(chunks: DataFrame, snippet_cut: int | None = None) -> DataFrame:
    """The slim table retrieval reads: chunk id, file-order key, terms, the
    columns a citation shows and the prompt snippet (whole chunks, or ``snippet_cut`` characters
    of each, SNIPPET_CUT for the reference's). Written once to the shared folder; scoring then reads only (id, order, terms) columns."""
    return materialize(chunk_order(chunks).select(
        "chunk_id", "_ord", terms(F.concat_ws(" ", "chunk_name", "description")).alias("tc"),
        "file_path", "chunk_type", "chunk_name", _snippet(snippet_cut).alias("snippet")),
        "retrieval_index")


def _index(chunks: DataFrame) -> DataFrame:
    return chunks if "tc" in chunks.columns else retrieval_index(chunks)


def jaccard_scores(questions: DataFrame, chunks: DataFrame, qid: str = "qid", question: str = "question",
                   keep_order: bool = False) -> DataFrame:
    """J4 + F5: (qid, chunk_id, score) for every pair sharing a term (score > 0).

    The planner broadcasts the question side by its size in bytes, or joins by a shuffle, where
    AQE splits hot terms (skew join). ``keep_order`` carries the chunk's file-order key so
    the top-k needs no second pass over the chunks.
    """
    qt = questions.select(F.col(qid).alias("qid"), terms(F.col(question)).alias("_t")).select(
        "qid", F.size("_t").alias("nq"), F.explode("_t").alias("term"))
    extra = ["_ord"] if keep_order else []
    if "tc" in chunks.columns:
        src = chunks.select("chunk_id", *extra, F.col("tc").alias("_t"))
    else:
        src = (chunk_order(chunks) if keep_order else chunks).select(
            "chunk_id", *extra, terms(F.concat_ws(" ", "chunk_name", "description")).alias("_t"))
    ct = src.select("chunk_id", *extra, F.size("_t").alias("nc"), F.explode("_t").alias("term"))
    shared = ct.join(qt, "term").groupBy("qid", "chunk_id", *extra, "nq", "nc").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("qid", "chunk_id", *extra,
                         (F.col("shared") / (F.col("nq") + F.col("nc") - F.col("shared"))).alias("score"))


def retrieve_topk(scores: DataFrame, chunks: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """Best ``k`` chunks per question, score descending, ties in file order."""
    ordered = scores if "_ord" in scores.columns else \
        scores.join(chunk_order(chunks).select("chunk_id", "_ord"), "chunk_id")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("_ord"))
    return ordered.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_ord")


# A term is "hot" when more than max(HOT_MIN_DF, chunks / HOT_FRACTION) chunks
# contain it; the hot set is then at most HOT_FRACTION x (mean terms per chunk).
HOT_MIN_DF = 1000
HOT_FRACTION = 1000


def hot_terms(chunk_terms: DataFrame, hot_df: int) -> list[str]:
    """Terms in more than ``hot_df`` chunks. Counting is a partial aggregate;
    the result is bounded by (term occurrences) / ``hot_df`` and collected."""
    counts = chunk_terms.select(F.explode("tc").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return sorted(r["term"] for r in counts.where(F.col("df") > hot_df).select("term").collect())


#: Groups that a question scores first, to learn how good its best ``k`` are at least.
SEEDS = 1000


def postings(questions: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(heads, lists), tables, for questions with ``tq``. A chunk's score for any of the questions depends on
    its signature (the terms that some question asks for) and its term count ``nc`` alone. heads: the first
    ``k`` chunks in file order of each (sig, nc) group. lists: posting lists of the groups, one row per
    term of a signature: term, nc, sig, first (place of the group's first chunk)."""
    wanted = questions.select(F.explode("tq").alias("term")).distinct()
    met = (chunks.select("chunk_id", "_ord", F.size("tc").alias("nc"), F.explode("tc").alias("term"))
           .join(wanted, "term", "left_semi"))
    # a term never contains whitespace, so the space-joined signature is a unique string key
    signed = met.groupBy("chunk_id", "_ord", "nc").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("sig"))
    w = Window.partitionBy("sig", "nc").orderBy("_ord")
    heads = materialize(signed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k), "retrieval-heads")
    lists = heads.where("_r = 1").select("sig", "nc", F.col("_ord").alias("first"), F.explode(F.split("sig", " ")).alias("term"))
    return heads.drop("_r"), materialize(lists, "retrieval-lists")


def _scored(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, sig, nc, first) with the exact score."""
    shared = F.size(F.array_intersect("tq", F.split("sig", " ")))
    return (pairs.join(questions, "qid").withColumn("_s", shared)
            .select("qid", "sig", "nc", "first", (F.col("_s") / (F.size("tq") + F.col("nc") - F.col("_s"))).alias("score")))


def candidate_groups(questions: DataFrame, lists: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """(qid, sig, nc, first) of every group that may be among a question's best ``k``.

    Posting lists lie in blocks of one term and one term count. Each question first opens its rarest
    blocks, ``seeds`` groups at most; the ``k``-th best score among them, t, is a lower bound for its
    ``k``-th best of all. A chunk of ``nc`` terms that reaches t shares at least
    ``s = t (nq + nc) / (1 + t)`` of the question's ``nq`` terms, so it is in the list of one of
    the question's ``nq - s + 1`` rarest terms (whichever those are): only those blocks are opened, and none whose
    best possible score, all terms shared, is below t."""
    blocks = lists.groupBy("term", "nc").agg(F.count(F.lit(1)).alias("n"))
    asked = questions.select("qid", F.size("tq").alias("nq"), F.explode("tq").alias("term"))
    seen = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    rarity = Window.partitionBy("qid").orderBy(F.coalesce("df", F.lit(0)), "term")
    ranked = asked.join(seen, "term", "left").withColumn("place", F.row_number().over(rarity)).drop("df")
    opened = materialize(ranked.join(blocks, "term"), "retrieval-blocks")  # blocks, not their lists
    upto = Window.partitionBy("qid").orderBy("place", F.abs(F.col("nc") - F.col("nq")), "nc").rowsBetween(Window.unboundedPreceding, 0)
    early = opened.withColumn("_upto", F.sum("n").over(upto)).where(F.col("_upto") <= seeds)
    of = lambda chosen: chosen.join(lists, ["term", "nc"]).select("qid", "sig", "nc", "first").distinct()
    best = Window.partitionBy("qid").orderBy(F.desc("score"))
    least = (_scored(of(early.select("qid", "term", "nc")), questions).withColumn("_r", F.row_number().over(best))
             .where(F.col("_r") == k).select("qid", F.col("score").alias("t")))
    t = F.coalesce("t", F.lit(0.0))
    need = F.greatest(F.lit(1), F.ceil(t * (F.col("nq") + F.col("nc")) / (t + 1) - 1e-9))
    live = opened.join(least, "qid", "left").where((need <= F.least("nq", "nc")) & (F.col("place") <= F.col("nq") - need + 1))
    return of(live.select("qid", "term", "nc"))


def topk_jaccard(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, qid: str = "qid",
                 question: str = "question", seeds: int = SEEDS) -> DataFrame:
    """J4 + W1 exactly: qid, chunk_id, score, rank (1..k), ties in file order.

    Chunks that look alike to all questions are one group (``postings``), and only blocks of the posting
    lists that can hold a best ``k`` are opened (``candidate_groups``). Of the groups, the best ``k`` by score
    and first chunk hold the best ``k`` chunks, since any other group's first chunk already has ``k`` ahead of it.
    """
    q = materialize(questions.select(F.col(qid).alias("qid"), terms(F.col(question)).alias("tq")), "retrieval-questions")
    # the slim index is written once to the shared folder
    heads, lists = postings(q, _index(chunks).select("chunk_id", "_ord", "tc"), k)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("first"))
    top = (_scored(candidate_groups(q, lists, k, seeds), q).withColumn("_r", F.row_number().over(best))
           .where(F.col("_r") <= k).select("qid", "sig", "nc", "score"))
    # written, so that the planner knows how small it is, and what is joined to it stays where it lies
    return materialize(retrieve_topk(top.join(heads, ["sig", "nc"]).select("qid", "chunk_id", "_ord", "score"), k=k), "retrieval-topk")


def jaccard_summary(questions: DataFrame, chunks: DataFrame, qid: str = "qid", question: str = "question",
                    hot_df: int | None = None) -> DataFrame:
    """J4 in aggregate: per question, the number of chunks sharing a term
    (score > 0), the best score and the sum of scores, exactly, without
    enumerating pairs that share only hot terms.

    Pairs sharing a cold term are scored one by one. Every other candidate
    shares only hot terms, so its score depends on its (hot signature, term
    count) group alone: such pairs are counted per group, minus the group's
    chunks already counted through a cold term.
    """
    q = questions.select(F.col(qid).alias("qid"), terms(F.col(question)).alias("tq"))
    c = _index(chunks).select("chunk_id", "tc")
    if hot_df is None:
        hot_df = max(HOT_MIN_DF, c.count() // HOT_FRACTION)
    hot = hot_terms(c, hot_df)

    def is_hot(t: Column) -> Column:
        return t.isin(hot) if hot else F.lit(False)

    qt = q.select("qid", "tq", F.explode("tq").alias("term"))
    keyed = c.select("chunk_id", "tc", F.size("tc").alias("nc"),
                     F.array_join(F.array_sort(F.filter("tc", is_hot)), " ").alias("sig"))

    cold = (keyed.select("chunk_id", "tc", "nc", "sig", F.explode(F.filter("tc", lambda t: ~is_hot(t))).alias("term"))
            .join(qt.where(~is_hot(F.col("term"))), "term")
            .select("qid", "chunk_id", "nc", "sig", jaccard(F.col("tq"), F.col("tc")).alias("score"),
                    (F.size(F.array_intersect(F.split("sig", " "), F.col("tq"))) > 0).alias("also_hot"))
            .distinct())
    cold_stats = cold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_c"), F.sum("score").alias("sum_c"),
                                         F.max("score").alias("max_c"))
    overlap = (cold.where(F.col("also_hot") & (F.col("sig") != ""))
               .groupBy("qid", "sig", "nc").agg(F.count(F.lit(1)).alias("dup")))

    groups = (keyed.where(F.col("sig") != "").groupBy("sig", "nc").agg(F.count(F.lit(1)).alias("g_n")))
    q_hot = qt.where(is_hot(F.col("term"))).select("qid", F.size("tq").alias("nq"), "term")
    gq = (groups.select("sig", "nc", "g_n", F.explode(F.split("sig", " ")).alias("term")).join(q_hot, "term")
          .groupBy("qid", "sig", "nc").agg(F.count(F.lit(1)).alias("s"), F.first("nq").alias("nq"),
                                           F.first("g_n").alias("g_n")))
    hot_only = (gq.join(overlap, ["qid", "sig", "nc"], "left")
                .select("qid", (F.col("g_n") - F.coalesce("dup", F.lit(0))).alias("m"),
                        (F.col("s") / (F.col("nq") + F.col("nc") - F.col("s"))).alias("score"))
                .where(F.col("m") > 0))
    hot_stats = hot_only.groupBy("qid").agg(F.sum("m").alias("n_h"), F.sum(F.col("m") * F.col("score")).alias("sum_h"),
                                            F.max("score").alias("max_h"))
    j = cold_stats.join(hot_stats, "qid", "full_outer")
    return j.select(
        "qid",
        (F.coalesce("n_c", F.lit(0)) + F.coalesce("n_h", F.lit(0))).alias("n_candidates"),
        F.greatest(F.coalesce("max_c", F.lit(0.0)), F.coalesce("max_h", F.lit(0.0))).alias("max_score"),
        (F.coalesce("sum_c", F.lit(0.0)) + F.coalesce("sum_h", F.lit(0.0))).alias("sum_score"))


def citations(topk: DataFrame, chunks: DataFrame, snippet_cut: int | None = None) -> DataFrame:
    """Per question, the ordered citation structs and context pieces. Chunks without a
    ``snippet`` column are shown whole, or ``snippet_cut`` characters of them."""
    snippet = F.col("snippet") if "snippet" in chunks.columns else _snippet(snippet_cut)
    j = topk.join(chunks.select("chunk_id", "file_path", "chunk_type", "chunk_name", snippet.alias("snippet")),
                  "chunk_id")
    item = F.struct(
        F.col("rank"), F.col("chunk_id"), F.col("file_path").alias("file"), F.col("chunk_type"),
        F.col("chunk_name").alias("name"), F.lit(RELEVANCE).alias("relevance"),
        F.concat(F.lit("\n"), F.upper("chunk_type"), F.lit(": "), F.col("chunk_name"), F.lit("\n"),
                 F.col("snippet"), F.lit("...\n")).alias("context"))
    return j.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("citations"))


def rag_prompt(question: Column, cites: Column) -> Column:
    """Context header and snippets (empty without citations), then the
    question and the answer cue."""
    ctx = F.when(F.coalesce(F.size(cites), F.lit(0)) > 0, F.concat(
        F.lit(CONTEXT_HEADER), F.array_join(F.transform(cites, lambda c: c["context"]), ""))
    ).otherwise(F.lit(""))
    return F.concat(ctx, F.lit(QUESTION_PREFIX), question, F.lit(ANSWER_SUFFIX))


def extract_answer(response: Column) -> Column:
    """Text after the last ``ANSWER:``, trimmed (whole text when absent)."""
    tail = F.element_at(F.split(response, ANSWER_MARK, -1), -1)
    return F.regexp_replace(tail, r"(?U)^\s+|\s+$", "")


def confidence(n_citations: Column) -> Column:
    """X18."""
    return F.round(F.least(F.lit(1.0), n_citations * CONF_STEP + CONF_BASE), 6)


def cache_key(question: Column) -> Column:
    """J6 key: case-folded question hash (stable across processes; decision 14)."""
    return F.sha2(F.lower(question), 256)


def cache_hits(questions: DataFrame, cache: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """Questions answered from the cache (cache: qkey, answer)."""
    return questions.withColumn("qkey", cache_key(F.col(question))).join(cache, "qkey").drop("qkey")


def cache_misses(questions: DataFrame, cache: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """The questions that still need retrieval."""
    return (questions.withColumn("qkey", cache_key(F.col(question)))
            .join(cache.select("qkey"), "qkey", "left_anti").drop("qkey"))


def answer_questions(questions: DataFrame, chunks: DataFrame, cache: DataFrame | None = None,
                     k: int = PROMPT_TOP_K, snippet_cut: int | None = None) -> DataFrame:
    """Cache probe, retrieval, citations, prompt and confidence per question. Prompts show whole
    chunks, or ``snippet_cut`` characters of each (an index made before keeps its own snippets).

    Output: qid, question, from_cache, answer (cached or null), citations,
    n_sources, confidence, prompt (null for cached answers).
    """
    todo = questions if cache is None else cache_misses(questions, cache)
    idx = chunks if "tc" in chunks.columns else retrieval_index(chunks, snippet_cut)
    cites = citations(topk_jaccard(todo, idx, k), idx)
    fresh = todo.join(cites, "qid", "left").select(
        "qid", "question", F.lit(False).alias("from_cache"), F.lit(None).cast("string").alias("answer"),
        "citations",
        F.coalesce(F.size("citations"), F.lit(0)).alias("n_sources"),
        confidence(F.coalesce(F.size("citations"), F.lit(0))).alias("confidence"),
        rag_prompt(F.col("question"), F.col("citations")).alias("prompt"))
    if cache is None:
        return fresh
    hits = cache_hits(questions, cache).select(
        "qid", "question", F.lit(True).alias("from_cache"), "answer",
        F.lit(None).cast(fresh.schema["citations"].dataType).alias("citations"),
        F.lit(0).alias("n_sources"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("prompt"))
    return fresh.unionByName(hits)


def read_answers(spark: SparkSession, path: str, snapshot: int) -> DataFrame:
    """The cache (qkey, answer) of the answers given from one snapshot of the index; those of other
    snapshots are stale and not served."""
    rows = spark.read.schema("qkey string, answer string, snapshot long").parquet(path).where(F.col("snapshot") == snapshot)
    return rows.groupBy("qkey").agg(F.min("answer").alias("answer"))


def write_answers(answers: DataFrame, path: str, snapshot: int) -> None:
    """Keep fresh answers (question, answer; rows of ``answer_questions`` once a model has
    answered their prompts) under the question's key, for the index snapshot they were given
    from. A question that is there already is not written again, so a replay adds no row; of several answers to one
    question the least stays. Rows without an answer are not kept."""
    spark = answers.sparkSession
    fresh = (answers.where(F.col("answer").isNotNull() & F.col("question").isNotNull())
             .groupBy(cache_key(F.col("question")).alias("qkey")).agg(F.min("answer").alias("answer")))
    try:
        fresh = fresh.join(read_answers(spark, path, snapshot).select("qkey"), "qkey", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.withColumn("snapshot", F.lit(snapshot).cast("long")).write.mode("append").partitionBy("snapshot").parquet(path)


def answer_report(answers: DataFrame) -> DataFrame:
    """Questions, mean confidence and mean sources per answered question."""
    live = answers.where(~F.col("from_cache"))
    return live.agg(F.count(F.lit(1)).alias("questions"),
                    F.round(F.avg("confidence"), 6).alias("avg_confidence"),
                    F.round(F.avg("n_sources"), 6).alias("avg_sources"))


def question_prompts(chunks: DataFrame) -> DataFrame:
    """The prompts a user would ask about each chunk, by query type."""
    name, parent, code = F.col("chunk_name"), F.col("parent_class"), F.col("code_content")
    base = F.regexp_extract(F.col("file_path"), r"([^/]*)$", 1)
    method_q = F.when(parent.isNotNull() & (parent != ""),
                      F.concat(F.lit(PROMPT_METHOD_IN_CLASS[0]), name, F.lit(PROMPT_METHOD_IN_CLASS[1]), parent,
                               F.lit(PROMPT_METHOD_IN_CLASS[2]))
                      ).otherwise(F.concat(F.lit(PROMPT_METHOD[0]), name, F.lit(PROMPT_METHOD[1])))
    per_type = (
        F.when(F.col("chunk_type") == "method", F.array(
            F.struct(F.lit("explain_method").alias("query_type"), method_q.alias("prompt")),
            F.struct(F.lit("explain_logic").alias("query_type"), F.concat(F.lit(PROMPT_LOGIC), code).alias("prompt"))))
        .when(F.col("chunk_type") == "class", F.array(
            F.struct(F.lit("explain_class").alias("query_type"),
                     F.concat(F.lit(PROMPT_CLASS[0]), name, F.lit(PROMPT_CLASS[1])).alias("prompt")),
            F.struct(F.lit("find_related").alias("query_type"),
                     F.concat(F.lit(PROMPT_RELATED[0]), name, F.lit(PROMPT_RELATED[1])).alias("prompt"))))
        .otherwise(F.array(
            F.struct(F.lit("explain_file").alias("query_type"),
                     F.concat(F.lit(PROMPT_FILE[0]), base, F.lit(PROMPT_FILE[1])).alias("prompt")))))
    return chunks.select("chunk_id", F.explode(per_type).alias("p")).select("chunk_id", "p.query_type", "p.prompt")
