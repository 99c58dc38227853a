"""Registered retrieval queries (and their oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import retrieval as R
from ..sources import fixtures as fx
from ..streaming.jobs import scratch_dir
from . import oracle_fixtures as ofx
from .catalog import query
from .queries_corpus import all_chunks, fixed_ts

W = ofx.with_ctes


def code_index(spark, sf) -> DataFrame:
    """The Java chunks."""
    return chunking.extract_java_chunks(fx.java_files(spark, sf), fixed_ts())


def search_index(spark, sf) -> DataFrame:
    """The slim retrieval index over all chunks (documents' tree and Java), written once."""
    return R.retrieval_index(all_chunks(spark, sf))


BASE = (ofx.JAVA, ofx.DOC_TREE, ofx.TREE_CHUNKS, ofx.ALL_CHUNKS, ofx.QUESTIONS)


@query("jaccard_scores", W(*BASE, ofx.retrieval("questions", 3)) + """
SELECT qid, count(*)::BIGINT AS n_candidates, round(max(score), 6) AS max_score, round(sum(score), 6) AS sum_score
FROM scores GROUP BY qid""")
def q_jaccard_scores(spark, sf):
    s = R.jaccard_summary(fx.questions(spark, sf), search_index(spark, sf))
    return s.select("qid", F.col("n_candidates").cast("bigint").alias("n_candidates"),
                    F.round("max_score", 6).alias("max_score"), F.round("sum_score", 6).alias("sum_score"))


@query("retrieve_topk", W(*BASE, ofx.retrieval("questions", 3)) + """
SELECT qid, rank::BIGINT AS rank, chunk_id, round(score, 6) AS score FROM topk""")
def q_retrieve_topk(spark, sf):
    t = R.topk_jaccard(fx.questions(spark, sf), search_index(spark, sf), 3)
    return t.select("qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                    F.round("score", 6).alias("score"))


@query("citations", W(*BASE, ofx.retrieval("questions", 2)) + " SELECT qid, chunk_ids FROM cites")
def q_citations(spark, sf):
    idx = search_index(spark, sf)
    c = R.citations(R.topk_jaccard(fx.questions(spark, sf), idx, 2), idx)
    return c.select("qid", F.array_join(F.transform("citations", lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


@query("cache_hits", W(ofx.QUESTIONS) + " SELECT qid, answer FROM hits")
def q_cache_hits(spark, sf):
    return R.cache_hits(fx.questions(spark, sf), fx.answer_cache(spark, sf)).select("qid", "answer")


@query("cache_misses", W(ofx.QUESTIONS) + " SELECT qid, question FROM misses")
def q_cache_misses(spark, sf):
    return R.cache_misses(fx.questions(spark, sf), fx.answer_cache(spark, sf)).select("qid", "question")


ANSWERS_SQL = W(*BASE, ofx.retrieval("misses", 2)) + """,
answers AS (
  SELECT m.qid, false AS from_cache, CAST(NULL AS VARCHAR) AS answer, coalesce(c.n_sources, 0) AS n_sources,
         round(least(1.0, coalesce(c.n_sources, 0) * 0.3 + 0.4), 6) AS confidence,
         sha256(coalesce(c.context, '') || chr(10) || chr(10) || 'QUESTION: ' || m.question || chr(10) || chr(10)
                || 'ANSWER:') AS prompt_sha
  FROM misses m LEFT JOIN cites c ON m.qid = c.qid
  UNION ALL
  SELECT qid, true, answer, 0, NULL, NULL FROM hits)
"""


def answers(spark, sf) -> DataFrame:
    return R.answer_questions(fx.questions(spark, sf), all_chunks(spark, sf), fx.answer_cache(spark, sf))


@query("answer_questions", ANSWERS_SQL + """
SELECT qid, from_cache, answer, n_sources::BIGINT AS n_sources, confidence, prompt_sha FROM answers""")
def q_answer_questions(spark, sf):
    a = answers(spark, sf)
    return a.select("qid", "from_cache", "answer", F.col("n_sources").cast("bigint").alias("n_sources"),
                    "confidence", F.sha2("prompt", 256).alias("prompt_sha"))


@query("rag_prompts", ANSWERS_SQL + " SELECT qid, prompt_sha FROM answers WHERE NOT from_cache")
def q_rag_prompts(spark, sf):
    a = answers(spark, sf).where(~F.col("from_cache"))
    return a.select("qid", F.sha2("prompt", 256).alias("prompt_sha"))


@query("answer_cache_write", ANSWERS_SQL + """
SELECT q.qid, true AS from_cache, coalesce(h.answer, n.answer) AS answer FROM questions q
LEFT JOIN hits h ON h.qid = q.qid
LEFT JOIN (SELECT lower(m.question) AS k, min(a.prompt_sha) AS answer FROM misses m JOIN answers a ON a.qid = m.qid GROUP BY 1) n ON n.k = lower(q.question)
UNION ALL SELECT qid, false, NULL FROM questions""")
def q_answer_cache_write(spark, sf):
    """Ask, answer (a prompt's hash stands for the model's answer), write twice (a replay), and ask
    again with that cache: all hits. After the next index snapshot nothing is served."""
    path = scratch_dir(spark, "answers")
    questions, idx = fx.questions(spark, sf), search_index(spark, sf)
    known = questions.select("question").join(fx.answer_cache(spark, sf), R.cache_key(F.col("question")) == F.col("qkey"))
    R.write_answers(known, path, 1)
    asked = R.answer_questions(questions, idx, R.read_answers(spark, path, 1))
    fresh = asked.where(~F.col("from_cache")).withColumn("answer", F.sha2("prompt", 256))
    for _ in range(2):
        R.write_answers(fresh, path, 1)
    again = [R.answer_questions(questions, idx, R.read_answers(spark, path, n)) for n in (1, 2)]
    return again[0].unionByName(again[1]).select("qid", "from_cache", "answer")


@query("answer_report", ANSWERS_SQL + """
SELECT count(*)::BIGINT AS questions, round(avg(confidence), 6) AS avg_confidence,
       round(avg(n_sources), 6) AS avg_sources FROM answers WHERE NOT from_cache""")
def q_answer_report(spark, sf):
    return R.answer_report(answers(spark, sf))


@query("question_prompts", W(ofx.JAVA) + """
SELECT chunk_id, query_type, sha256(prompt) AS prompt_sha FROM (
  SELECT chunk_id, 'explain_method' AS query_type,
         CASE WHEN parent_class IS NOT NULL AND parent_class <> ''
              THEN 'Explain what the method ''' || chunk_name || ''' does in the class ''' || parent_class || '''.'
              ELSE 'Explain what the method ''' || chunk_name || ''' does.' END AS prompt
  FROM java_chunks WHERE chunk_type = 'method'
  UNION ALL
  SELECT chunk_id, 'explain_logic', 'Explain the logic of this code snippet:' || chr(10) || chr(10) || code_content
  FROM java_chunks WHERE chunk_type = 'method'
  UNION ALL
  SELECT chunk_id, 'explain_class',
         'What is the purpose of the ''' || chunk_name || ''' class and what are its main responsibilities?'
  FROM java_chunks WHERE chunk_type = 'class'
  UNION ALL
  SELECT chunk_id, 'find_related',
         'What other methods, classes, or files are related to ''' || chunk_name || '''?'
  FROM java_chunks WHERE chunk_type = 'class'
  UNION ALL
  SELECT chunk_id, 'explain_file',
         'Summarize the purpose and main components of the file ''' || string_split(file_path, '/')[-1] || '''.'
  FROM java_chunks WHERE chunk_type = 'file')""")
def q_question_prompts(spark, sf):
    p = R.question_prompts(code_index(spark, sf))
    return p.select("chunk_id", "query_type", F.sha2("prompt", 256).alias("prompt_sha"))


@query("extract_answer", """
SELECT u.conv_id::BIGINT AS conv_id, u.turn::BIGINT AS turn,
       trim(string_split('QUESTION: ' || u.text || chr(10) || chr(10) || 'ANSWER: ' || a.text, 'ANSWER:')[-1],
            ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def q_extract_answer(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("a"))
    resp = F.concat(F.lit("QUESTION: "), F.col("q"), F.lit("\n\nANSWER: "), F.col("a"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", R.extract_answer(resp).alias("answer"))
