"""Retrieval helpers: terms, Jaccard, answers, cache keys."""

from pyspark.sql import functions as F

from corpusflow.operators import retrieval as R


def test_terms_unicode_whitespace_and_jaccard(spark):
    df = spark.createDataFrame([("Get User  get", "get data")], "a string, b string")
    r = df.select(F.array_sort(R.terms(F.col("a"))).alias("t"),
                  R.jaccard(R.terms(F.col("a")), R.terms(F.col("b"))).alias("j")).first()
    assert r.t == ["get", "user"] and abs(r.j - 1 / 3) < 1e-12


def test_topk_ties_in_file_order(spark):
    chunks = spark.createDataFrame([
        ("c2", "b.java", 1, "file", "getData", "get data", "x"),
        ("c1", "a.java", 5, "method", "getData", "get data", "y"),
        ("c0", "a.java", 1, "class", "Other", "nothing here", "z")],
        "chunk_id string, file_path string, start_line int, chunk_type string, chunk_name string, "
        "description string, code_content string")
    qs = spark.createDataFrame([(1, "getdata get data")], "qid long, question string")
    top = R.retrieve_topk(R.jaccard_scores(qs, chunks), chunks, k=2).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == ["c1", "c2"]


def test_answers_cache_and_prompt(spark):
    chunks = spark.createDataFrame([("c1", "A.java", 1, "class", "UserService", "user service", "class UserService {}")],
                                   "chunk_id string, file_path string, start_line int, chunk_type string, "
                                   "chunk_name string, description string, code_content string")
    qs = spark.createDataFrame([(1, "What is UserService"), (2, "what is userservice"), (3, "zzz")],
                               "qid long, question string")
    cache = spark.createDataFrame([(None, "cached")], "qkey string, answer string").withColumn(
        "qkey", R.cache_key(F.lit("WHAT IS USERSERVICE")))
    out = {r.qid: r for r in R.answer_questions(qs, chunks, cache).collect()}
    assert out[1].from_cache and out[2].from_cache and out[1].answer == "cached"
    assert out[3].n_sources == 0 and out[3].confidence == 0.4
    assert out[3].prompt == "\n\nQUESTION: zzz\n\nANSWER:"
    fresh = R.answer_questions(qs.where("qid = 1"), chunks).first()
    assert fresh.n_sources == 1 and abs(fresh.confidence - 0.7) < 1e-9
    assert fresh.prompt.startswith("RELEVANT CODE CONTEXT:\n\nCLASS: UserService\nclass UserService {}...\n")


def test_extract_answer(spark):
    df = spark.createDataFrame([("x ANSWER: one ANSWER:  two \n",), ("no mark ",)], "t string")
    assert [r[0] for r in df.select(R.extract_answer(F.col("t"))).collect()] == ["two", "no mark"]


def test_topk_hot_cold_equals_brute_force(spark):
    import random
    rnd = random.Random(3)
    words = ["get", "data", "set", "user", "order", "id", "name", "list", "map", "x1", "x2", "x3"]
    chunks = spark.createDataFrame([
        (f"c{i}", f"f{i % 7}.java", i, rnd.choice(["file", "class", "method"]), rnd.choice(words),
         " ".join(rnd.sample(words, rnd.randint(0, 4))), "code") for i in range(300)],
        "chunk_id string, file_path string, start_line int, chunk_type string, chunk_name string, "
        "description string, code_content string")
    qs = spark.createDataFrame([(i, " ".join(rnd.sample(words, rnd.randint(1, 5)))) for i in range(40)],
                               "qid long, question string")
    brute = R.retrieve_topk(R.jaccard_scores(qs, chunks), chunks, k=3)
    for seeds in (0, 5, 30, 10_000):   # no lower bound ... every group a seed
        fast = R.topk_jaccard(qs, chunks, k=3, seeds=seeds)
        a = sorted((r.qid, r.rank, r.chunk_id, round(r.score, 12)) for r in brute.collect())
        b = sorted((r.qid, r.rank, r.chunk_id, round(r.score, 12)) for r in fast.collect())
        assert a == b, seeds


def test_jaccard_summary_equals_all_pairs(spark):
    import random
    rnd = random.Random(5)
    words = ["get", "data", "set", "user", "order", "id", "name", "list", "x1", "x2"]
    chunks = spark.createDataFrame([
        (f"c{i}", f"f{i % 5}.java", i, "method", rnd.choice(words), " ".join(rnd.sample(words, rnd.randint(0, 4))), "")
        for i in range(250)],
        "chunk_id string, file_path string, start_line int, chunk_type string, chunk_name string, "
        "description string, code_content string")
    qs = spark.createDataFrame([(i, " ".join(rnd.sample(words, rnd.randint(1, 4)))) for i in range(30)],
                               "qid long, question string")
    pairs = R.jaccard_scores(qs, chunks).groupBy("qid").agg(
        F.count("*").alias("n"), F.max("score").alias("mx"), F.sum("score").alias("sm"))
    want = {r.qid: (r.n, round(r.mx, 9), round(r.sm, 9)) for r in pairs.collect()}
    for hot_df in (0, 10, 40, 10_000):
        got = {r.qid: (r.n_candidates, round(r.max_score, 9), round(r.sum_score, 9))
               for r in R.jaccard_summary(qs, chunks, hot_df=hot_df).collect()}
        assert got == want, hot_df


def test_candidates_do_not_grow_with_the_index(spark):
    import random
    rnd = random.Random(8)
    common, rare = [f"w{k}" for k in range(12)], [f"r{k}" for k in range(60)]
    texts = [(rnd.choice(rare), " ".join(rnd.sample(common, rnd.randint(1, 6)) + rnd.sample(rare, 2))) for _ in range(400)]
    schema = "chunk_id string, file_path string, start_line int, chunk_type string, chunk_name string, description string, code_content string"
    qs = spark.createDataFrame([(i, " ".join(rnd.sample(common, 4) + rnd.sample(rare, 2))) for i in range(25)], "qid long, question string")
    q = qs.select("qid", R.terms(F.col("question")).alias("tq"))
    counted = {}
    for times in (1, 8):
        # each chunk again and again, with words that nobody asks for
        rows = [(f"c{i}-{n}", f"f{n}/{i}.java", 1, "method", name, f"{text} u{i}x{n}", "") for n in range(times) for i, (name, text) in enumerate(texts)]
        chunks = spark.createDataFrame(rows, schema)
        index = R.retrieval_index(chunks)
        _, lists = R.postings(q, index.select("chunk_id", "_ord", "tc"), 3)
        pairs = {seeds: R.candidate_groups(q, lists, 3, seeds).count() for seeds in (0, R.SEEDS)}
        assert pairs[R.SEEDS] < pairs[0] / 2          # blocks that can't hold a best 3 stay shut
        counted[times] = pairs
        brute = R.retrieve_topk(R.jaccard_scores(qs, chunks), chunks, k=3)
        key = lambda d: sorted((r.qid, r.rank, r.chunk_id, round(r.score, 12)) for r in d.collect())
        assert key(R.topk_jaccard(qs, index, 3)) == key(brute)
    assert counted[8] == counted[1]


def test_answers_are_written_back_once_and_by_snapshot(spark):
    from corpusflow.streaming.jobs import scratch_dir
    path = scratch_dir(spark, "t-answers")
    fresh = spark.createDataFrame([("What is X", "b"), ("what is x", "a"), ("Y?", "y"), ("none", None)], "question string, answer string")
    for _ in range(2):
        R.write_answers(fresh, path, 1)
    assert spark.read.parquet(path).count() == 2
    got = {r.qkey: r.answer for r in R.read_answers(spark, path, 1).collect()}
    keys = {r.question: r.k for r in fresh.select("question", R.cache_key(F.col("question")).alias("k")).collect()}
    assert got == {keys["What is X"]: "a", keys["Y?"]: "y"} and R.read_answers(spark, path, 2).count() == 0
    R.write_answers(fresh.where("question = 'Y?'").withColumn("answer", F.lit("newer")), path, 2)
    assert [r.answer for r in R.read_answers(spark, path, 2).collect()] == ["newer"] and len(got) == 2


def test_best_chunks_are_a_small_table_before_the_index_is_joined(spark):
    """What the planner sees of the best chunks is a written table of known size: it sends them to the index, not the index to them."""
    chunks = spark.createDataFrame([(f"c{k}", f"f{k}", "class", f"Order{k}", f"text {k % 3}", 1, "body") for k in range(9)],
                                   "chunk_id string, file_path string, chunk_type string, chunk_name string, description string, start_line int, code_content string")
    questions = spark.createDataFrame([(1, "order4 text"), (2, "nothing")], "qid long, question string")
    index = R.retrieval_index(chunks)
    top = R.topk_jaccard(questions, index, 2)
    assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()
    got = R.citations(top, index).collect()
    assert [(r.qid, [c.chunk_id for c in r.citations]) for r in got] == [(1, ["c4", "c0"])]
