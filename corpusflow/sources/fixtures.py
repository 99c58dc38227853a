"""Input tables derived from the supplied parquet tables.

The reference works on source trees, revision logs and ledgers; none of those
ship with the test data, so each is derived from the supplied tables with
plain DataFrame operations (see FIXTURES.md). Everything here grows with the
base tables; nothing is generated from constants alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..session import read_table

# Fixed values of the derived fixtures (FIXTURES.md §3).
CLASS_SUFFIXES = ["Controller", "Service", "Repository", "Dao", "Config", "Model", ""]
METHOD_VERBS = ["get", "set", "create", "add", "update", "delete", "find", "search", "run"]
TREE_DIRS = ["src", "docs/_x", ".git", "build", "node_modules/m", "a/target/b"]
TREE_EXTS = [".java", ".py", ".xml", ".yaml", ".properties", ".sql", ".md", ".html"]
ERROR_CLASSES = ["TimeoutError", "SVNConnectionError", "GitPushError", "SVNFetchError",
                 "GitAuthenticationError"]
LEDGER_BATCH_SIZE = 50
RUN_COUNT = 25


def _pick(values: list[str], index: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# ---------------------------------------------------------------------------
# Source files
# ---------------------------------------------------------------------------

def _joined_files(batches):
    """Arrow batches of (okey, item, rel_path, text) in, sorted by them: a key's orders with the text before the methods,
    then its items with a method each. Rows (rel_path, content) out, one an order. A batch's last key waits for the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def files(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        text, item = rows.column(3).cast(pa.string()), rows.column(1).to_numpy(zero_copy_only=False)
        key = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        used = item
        if text.null_count:     # of the methods that are null none is joined, or one empty one if there are no others
            void = item & pc.is_null(text).to_numpy(zero_copy_only=False)
            used, text = item & ~void, pc.if_else(pa.array(void), "", text)
            only = np.logical_or.reduceat(item, starts) & ~np.logical_or.reduceat(used, starts)
            last = np.append(starts[1:], len(key)) - 1
            used[last[only]] = True
        orders, methods = np.flatnonzero(~item), np.flatnonzero(used)
        group = np.searchsorted(starts, orders, side="right") - 1
        first = np.searchsorted(methods, starts)
        n = 1 + (np.append(first[1:], len(methods)) - first)[group]
        ends = np.cumsum(n)
        pieces = np.arange(n.sum()) + np.repeat(first[group] - (ends - n) - 1, n)
        pieces = np.append(methods, 0)[pieces]
        pieces[ends - n] = orders
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), text.take(pa.array(pieces)))
        content = pc.binary_join_element_wise(pc.binary_join(lists, "\n"), "}", "\n")
        return pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(orders)), content], names=["rel_path", "content"])
    held: list = []
    for rb in batches:
        if not rb.num_rows:
            continue
        key = rb.column(0).to_numpy()
        cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if held and key[0] != held[-1].column(0)[0].as_py():
            yield files(held)
            held = []
        if cut:
            yield files([*held, rb.slice(0, cut)])
            held = []
        held.append(rb.slice(cut))
    if held:
        yield files(held)


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java file per order, one method per line item (FIXTURES.md). Orders and items are dealt and sorted together
    as narrow rows; texts are made afterwards and joined by blocks."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("okey"), F.lit(False).alias("item"), F.col("o_orderpriority").alias("mark"))
    nameless = F.col("okey").isNull() | F.col("mark").isNull()
    items = read_table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").cast("bigint").alias("okey"), F.lit(True).alias("item"), F.col("l_returnflag").alias("mark"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rtype = F.when(F.col("mark") == "A", "int").otherwise("void")
    stmt = (F.when(F.col("mark") == "R", "System.out.println(a);")
            .when(F.col("mark") == "A", "return a;")
            .otherwise("a = a + 1;"))
    method = F.concat(
        F.lit("    public static "), rtype, F.lit(" "),
        _pick(METHOD_VERBS, F.col("l_partkey") % 9), F.col("l_partkey").cast("string"),
        F.lit("(int a) {\n        if (a > "), F.col("l_linenumber").cast("string"),
        F.lit(") { a = a - 1; }\n        "), stmt, F.lit("\n    }"))
    k = F.col("okey")
    cls = F.concat(F.lit("Order"), k.cast("string"), _pick(CLASS_SUFFIXES, k % 7))
    digit = F.substring("mark", 1, 1)
    doc = F.when(k % 5 == 0, F.concat(F.lit(" /** Handles order "), k.cast("string"), F.lit(". */"))
                 ).otherwise(F.lit(""))
    head = F.concat(
        F.lit("package com.shop.p"), digit, F.lit(";\n\nimport java.util.List;\nimport com.shop.base.*;\n\n"),
        F.lit("public class "), cls, F.lit(" {"), doc)
    # methods in (l_linenumber, l_partkey, l_suppkey, l_extendedprice) order
    rows = (orders.where(~nameless).unionByName(items, allowMissingColumns=True).repartition("okey")
            .sortWithinPartitions("okey", "item", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", method)
            .select("okey", "item",
                    F.when(~F.col("item"), F.concat(F.lit("shop/p"), digit, F.lit("/"), cls, F.lit(".java"))).alias("rel_path"),
                    F.when(F.col("item"), method).otherwise(head).alias("text")))
    files = rows.mapInArrow(_joined_files, "rel_path string, content string")
    # The extension is known, so that a filter on it is decided without making the files. Orders that give no name
    # have no path, text or extension.
    void = F.lit(None).cast("string")
    return _as_files(files, F.lit(".java")).unionByName(
        _as_files(orders.where(nameless).select(void.alias("rel_path"), void.alias("content")), void))


def _as_files(df: DataFrame, ext: F.Column | None = None) -> DataFrame:
    return df.select(
        F.col("rel_path").alias("path"), "rel_path",
        (paths.extension(F.col("rel_path")) if ext is None else ext).alias("ext"),
        "content", ids.checksum(F.col("content")).alias("file_sha"))


def doc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (and web pages, as ``.html``) laid out as a virtual source
    tree, hidden and build directories included."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rel = F.concat(_pick(TREE_DIRS, F.floor(F.col("doc_id") / 8) % 6), F.lit("/"),
                   F.col("doc_id").cast("string"), _pick(TREE_EXTS, F.col("doc_id") % 8))
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    prel = F.concat(_pick(TREE_DIRS, F.floor(F.col("page_id") / 8) % 6), F.lit("/page"),
                    F.col("page_id").cast("string"), F.lit(".html"))
    return _as_files(d.select(rel.alias("rel_path"), F.col("text").alias("content")).unionByName(
        p.select(prel.alias("rel_path"), F.col("html").alias("content"))))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as Markdown: headings, a language section, a fence on every 4th."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    first_line = F.substring_index("text", "\n", 1)
    fence = F.when(F.col("doc_id") % 4 == 0, F.lit("\n```\ncode\n```")).otherwise(F.lit(""))
    content = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), first_line,
                       F.lit("\n\n## "), F.col("lang"), F.lit("\n"), F.col("text"), fence)
    rel = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _as_files(d.select(rel.alias("rel_path"), content.alias("content")))


def yaml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' attributes as YAML files with an indented child key."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    content = F.concat(F.lit("lang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"),
                       F.lit("\nn_chars: "), F.col("n_chars").cast("string"),
                       F.lit("\nmeta:\n  id: "), F.col("doc_id").cast("string"), F.lit("\n"))
    ext = F.when(F.col("doc_id") % 2 == 0, F.lit(".yaml")).otherwise(F.lit(".yml"))
    rel = F.concat(F.lit("conf/"), F.col("doc_id").cast("string"), ext)
    return _as_files(d.select(rel.alias("rel_path"), content.alias("content")))


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current snapshot: every document as ``snap/{doc_id}.txt``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _as_files(d.select(F.concat(F.lit("snap/"), F.col("doc_id").cast("string"), F.lit(".txt")
                                       ).alias("rel_path"), F.col("text").alias("content")))


def snapshot_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous snapshot: drops doc_id%10=0 (they become new), alters the text
    of doc_id%7=0 (modified), adds 1,000,000+doc_id for doc_id%11=0 (deleted)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = d.where(F.col("doc_id") % 10 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (old)")))
        .otherwise(F.col("text")).alias("text"))
    gone = d.where(F.col("doc_id") % 11 == 0).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    prev = kept.unionByName(gone)
    return _as_files(prev.select(
        F.concat(F.lit("snap/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        F.col("text").alias("content")))


def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index state written after indexing the previous snapshot."""
    return snapshot_previous(spark, sf_dir).select(
        "rel_path", "file_sha",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_indexed"),
        F.lit(1).alias("chunks_count"))


# ---------------------------------------------------------------------------
# Questions and turn pairs
# ---------------------------------------------------------------------------

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions per benchmark item: its whole text, and a class
    question whose case varies with ``item_id % 3`` (same text for three items)."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    cls_q = F.concat(F.lit("What does the Order"), (F.floor(F.col("item_id") / 3) * 7).cast("string"),
                     F.lit("Controller class do?"))
    variant = (F.when(F.col("item_id") % 3 == 1, F.lower(cls_q))
               .when(F.col("item_id") % 3 == 2, F.upper(cls_q)).otherwise(cls_q))
    return (b.select((F.col("item_id") * 2).alias("qid"), F.col("text").alias("question"))
            .unionByName(b.select((F.col("item_id") * 2 + 1).alias("qid"), variant.alias("question"))))


def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier answers: every fourth question, keyed case-insensitively."""
    q = questions(spark, sf_dir).where(F.col("qid") % 4 == 1)
    return (q.select(F.sha2(F.lower("question"), 256).alias("qkey"),
                     F.concat(F.lit("cached answer "), F.col("qid").cast("string")).alias("answer"))
            .groupBy("qkey").agg(F.min("answer").alias("answer")))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed by the assistant's next turn, as (input, output)."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input_text"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_text"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        "input_text", "output_text")


# ---------------------------------------------------------------------------
# Revision log, ledger, errors, runs
# ---------------------------------------------------------------------------

def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One revision per order: dense numbers, authors from customers (some
    missing), messages from priorities (some empty), files from line items."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority", "o_orderstatus")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n_items = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
               .agg(F.count(F.lit(1)).alias("n_items")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(n_items, o.o_orderkey == n_items.l_orderkey, "left"))
    return j.select(
        (F.col("o_orderkey") + 1).alias("revision"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("c_name")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("message"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("int").alias("files_changed"),
        F.col("o_orderstatus").alias("order_status"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger state after a run: one row per revision with its status."""
    r = revisions(spark, sf_dir)
    rev = F.col("revision")
    status = (F.when((rev - 1) % 97 == 0, "failed")
              .when(F.col("order_status") == "F", "completed")
              .when(F.col("order_status") == "P", "in_progress").otherwise("pending"))
    return r.select(
        rev.alias("svn_revision"),
        F.when(status == "completed", F.substring(F.sha2(F.concat(F.lit("r"), rev.cast("string")), 256), 1, 40)
               ).alias("git_commit_sha"),
        F.col("author").alias("svn_author"),
        F.col("ts").alias("svn_timestamp"),
        F.col("message").alias("svn_message"),
        (F.floor((rev - 1) / LEDGER_BATCH_SIZE) + 1).cast("int").alias("batch_number"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        status.alias("status"),
        F.when(status == "failed", F.lit("Test error")).alias("error_message"),
        F.when(status == "failed", ((rev - 1) % 3).cast("int")).otherwise(F.lit(0)).alias("retry_count"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def checkpoint_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-created checkpoints (INSERT OR REPLACE): signup events per user."""
    e = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    return e.select(
        (F.col("user_id") + 1).alias("svn_revision"),
        (F.floor(F.col("user_id") / LEDGER_BATCH_SIZE) + 1).cast("int").alias("batch_number"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("svn_author"),
        F.col("ts").alias("svn_timestamp"),
        F.col("props").alias("svn_message"),
        F.col("ts").alias("ts"), F.col("event_id").alias("seq"))


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates per revision from click/view/purchase/error events."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view", "purchase", "error"))
    status = (F.when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed").otherwise("in_progress"))
    return e.select(
        (F.col("user_id") + 1).alias("svn_revision"), status.alias("status"),
        F.when(status == "completed",
               F.substring(F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256), 1, 40)
               ).alias("git_commit_sha"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("props"))).alias("error_message"),
        "ts", F.col("event_id").alias("seq"))


def retry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retry per error event of a revision."""
    return (_events(spark, sf_dir).where(F.col("event_type") == "error")
            .select((F.col("user_id") + 1).alias("svn_revision"), "ts", F.col("event_id").alias("seq")))


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows: error events with an exception class and a revision."""
    n_orders = read_table(spark, sf_dir, "orders").count()  # one scalar
    e = _events(spark, sf_dir).where(F.col("event_type") == "error")
    rev = (F.col("event_id") % F.lit(n_orders) + 1)
    return e.select(
        F.col("event_id").alias("error_id"),
        rev.alias("svn_revision"),
        (F.floor((rev - 1) / LEDGER_BATCH_SIZE) + 1).cast("int").alias("batch_number"),
        _pick(ERROR_CLASSES, F.col("event_id") % 5).alias("error_type"),
        F.col("props").alias("error_message"),
        F.col("ts").alias("error_timestamp"),
        (F.col("event_id") % 4 == 0).cast("int").alias("resolved"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata rows, one per nation."""
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("run_id"),
        F.concat(F.lit("svn://repo/"), F.lower("n_name")).alias("svn_url"),
        F.concat(F.lit("git@host:"), F.lower("n_name"), F.lit(".git")).alias("git_url"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("start_time"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_update_time"),
        F.lit(0).cast("bigint").alias("last_checkpoint_revision"),
        F.col("n_regionkey").cast("bigint").alias("total_svn_revisions"),
        F.lit(0).cast("bigint").alias("current_batch_number"),
        F.lit("in_progress").alias("migration_status"))


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of model runs in long form, from the events."""
    e = _events(spark, sf_dir)
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"),
                    F.concat(F.lit("v"), (F.col("event_id") % 12 + 1).cast("string")).alias("tag"),
                    F.col("event_type").alias("metric"), "value", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))


def run_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field updates per run in long form (field, value); signup events try a
    field outside the whitelist."""
    e = _events(spark, sf_dir)
    field = (F.when(F.col("event_type") == "click", "last_checkpoint_revision")
             .when(F.col("event_type") == "view", "current_batch_number")
             .when(F.col("event_type").isin("purchase", "error"), "migration_status")
             .otherwise("svn_url"))
    value = (F.when(F.col("event_type") == "click", F.floor("value").cast("string"))
             .when(F.col("event_type") == "view", F.col("event_id").cast("string"))
             .when(F.col("event_type") == "purchase", F.lit("completed"))
             .when(F.col("event_type") == "error", F.lit("failed"))
             .otherwise(F.col("props")))
    return e.select((F.col("user_id") % RUN_COUNT).alias("run_id"), field.alias("field"),
                    value.alias("value"), "ts", F.col("event_id").alias("seq"))


def _xml_escape(c: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def revision_log_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``svn log --xml --verbose`` entries, one ``<logentry>`` string per
    revision: changed paths from line items, no author element when unknown."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = (read_table(spark, sf_dir, "lineitem")
         .select("l_orderkey", F.concat(F.lit("<path action=\"M\">/trunk/shop/p"),
                                        F.col("l_partkey").cast("string"), F.lit(".java</path>")).alias("p"))
         .groupBy("l_orderkey").agg(F.array_join(F.collect_list("p"), "").alias("paths")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(p, o.o_orderkey == p.l_orderkey, "left"))
    rev = (F.col("o_orderkey") + 1).cast("string")
    author = F.when(F.col("o_custkey") % 10 != 0, F.col("c_name"))
    msg = F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
    xml = F.concat(
        F.lit("<logentry revision=\""), rev, F.lit("\">"),
        F.coalesce(F.concat(F.lit("<author>"), _xml_escape(author), F.lit("</author>")), F.lit("")),
        F.lit("<date>"), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</date>"),
        F.lit("<msg>"), _xml_escape(msg), F.lit("</msg>"),
        F.coalesce(F.concat(F.lit("<paths>"), F.col("paths"), F.lit("</paths>")), F.lit("")),
        F.lit("</logentry>"))
    return j.select(xml.alias("xml"))


PROJECT_TYPES = ["microservices", "documentation", "monolith"]


def projects(spark: SparkSession, sf_dir: str, keep_mod: int | None = None, label: str = "Project of ") -> DataFrame:
    """Project configs, one per supplier: ``src{s_suppkey}`` (src0..src19 own
    the versioned document pairs); ``keep_mod`` keeps suppliers whose key is
    a multiple of it."""
    s = read_table(spark, sf_dir, "supplier")
    if keep_mod:
        s = s.where(F.col("s_suppkey") % keep_mod == 0)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return s.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("project_name"),
        F.concat(F.lit("/work/"), F.lower("s_name")).alias("project_root"),
        _pick(PROJECT_TYPES, F.col("s_nationkey") % 3).alias("project_type"),
        F.array(F.lit(".java"), F.lit(".md")).alias("file_types"),
        F.concat(F.lit(label), F.col("s_name")).alias("description"),
        F.lit("gpt2").alias("model_name"),
        F.create_map(F.lit("epochs"), F.lit("3"), F.lit("batch_size"), F.lit("4")).alias("training_config"),
        ts.alias("created_at"), ts.alias("last_updated"))
