"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Each kind's matches are leftmost and non-overlapping; spans are code points, end exclusive, of
the whole match. The base kinds ``assign``, ``access`` and ``hex`` are always reported. Bare
mixed-case tokens (``bare``) and credentials in URLs (``url``) are only candidates: every
candidate's value is hashed, the corpus is asked in how many distinct repositories and owners
the hash occurs, and a candidate becomes a span only if few owners have it. A value that many
owners hold is a widely copied example and is not added. Base spans carry the same verdict.

Defined results: null text counts as empty; a document without matches has counts 0 and empty
span strings; a null owner or repository counts as one of its own; repeated rows are reported
each; an empty table gives an empty result; other columns are ignored.

Scale: texts are read once and never shuffled; only matches are. Frequencies are two-step
aggregates (distinct (value, owner), then counts), so a value found in a third of all rows is
combined before it is shuffled; the verdict comes back by a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_as_table

#: Kind -> (pattern, group of the value, least length of the value).
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "url": (r"://[^\x20\x09-\x0D:/@]+:([^\x20\x09-\x0D:/@]+)@", 1, 6),
    "bare": (r"[A-Za-z0-9+/_-]+", 0, 20),
}
BASE = ("assign", "access", "hex")
#: The same runs, written so that the engine skips those that are too short.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "bare": r"[A-Za-z0-9+/_-]{20,}"}
MAX_OWNERS = 2
MASK = "[SECRET]"


def _looks_random(value: Column) -> Column:
    """Upper case, lower case and digits together."""
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind: array of (gap: code points since the match before, hit, value)."""
    pattern, group, _ = KINDS[kind]
    pattern = FAST.get(kind, pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")))


def candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has row, doc_id; spans has row, kind, start, end, value, repo, owner
    for every match that is long enough, candidates of the added kinds included."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    scanned = keep_as_table(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(repo).cast("string").alias("repo"),
                    F.col(owner).cast("string").alias("owner"), F.col("text").alias("_text"))
        .select("row", "doc_id", "repo", "owner", *[_matches(text, k).alias(k) for k in KINDS]), "secret-matches")
    per_kind = []
    for kind, (_, _, least) in KINDS.items():
        w = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        hits = (scanned.filter(F.col(kind).isNotNull())
                .select("row", "repo", "owner", F.posexplode(kind).alias("pos", "m")).filter(F.col("m.hit").isNotNull())
                .select("row", "repo", "owner", "pos", F.col("m.gap").alias("gap"), F.length("m.hit").alias("n"), F.col("m.value").alias("value"))
                .withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)))
        good = F.length("value") >= least
        if kind == "bare":
            good &= _looks_random(F.col("value"))
        per_kind.append(hits.filter(good).select(
            "row", F.lit(list(KINDS).index(kind)).alias("k"), F.lit(kind).alias("kind"),
            (F.col("end") - F.col("n")).alias("start"), "end", F.sha2("value", 256).alias("value"), "repo", "owner"))
    spans = per_kind[0]
    for s in per_kind[1:]:
        spans = spans.unionByName(s)
    return scanned.select("row", "doc_id"), keep_as_table(spans, "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """Per value hash: occurrences, distinct repositories and owners in the whole corpus."""
    pairs = spans.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    # one repository name under two owners is two repositories
    return owners.groupBy("value").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"),
                                       F.count(F.lit(1)).alias("n_owners"))


def classify(spans: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Spans with n_found, n_repos, n_owners, ``live`` (few owners) and ``kept``: base spans, and
    live added ones that overlap no base span and no kept span of an earlier kind."""
    known = spans.join(ownership(spans), "value").withColumn("live", F.col("n_owners") <= max_owners)
    first = Window.partitionBy("row").orderBy("start")
    last = Window.partitionBy("row").orderBy(F.desc("start"))
    for k, kind in enumerate(KINDS):
        if kind in BASE:
            continue
        settled = (F.col("k") < k) & F.col("kept") if "kept" in known.columns else F.col("k") < k
        mine = F.col("k") == k
        reach = F.max(F.when(settled, F.col("end"))).over(first.rangeBetween(Window.unboundedPreceding, 0))
        next_ = F.min(F.when(settled, F.col("start"))).over(last.rangeBetween(Window.unboundedPreceding, 0))
        free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(next_, F.col("end")) >= F.col("end"))
        before = F.col("kept") if "kept" in known.columns else F.col("k") < k
        known = known.withColumn("kept", F.when(mine, F.col("live") & free).otherwise(before))
    return known.filter("kept").drop("kept", "repo", "owner")


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: doc_id, ``found`` (array of start, k, kind, end, value, n_repos,
    n_owners, live; sorted by start, then kind as listed; null if none)."""
    rows, spans = candidates(docs, repo, owner)
    found = classify(spans, max_owners).groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "k", "kind", "end", "value", "n_repos", "n_owners", "live"))).alias("found"))
    return rows.join(found, "row", "left").drop("row")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and span strings of ``scan``'s rows."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    count = lambda a: F.when(F.col("found").isNull(), 0).otherwise(F.size(a)).cast("long")
    return scanned.select("doc_id", *[count(of(k)).alias(f"n_{k}") for k in BASE],
                          F.sha2(F.coalesce(text(of(*BASE)), F.lit("")), 256).alias("base_sha256"),
                          F.coalesce(text(F.col("found")), F.lit("")).alias("spans"),
                          count(F.filter("found", lambda s: s["live"])).alias("n_live"))


def _masked(text: Column, kind: str, hide) -> Column:
    """``text`` with the matches of ``kind`` that ``hide`` (of the value) selects replaced by MASK."""
    pattern, group, _ = KINDS[kind]
    pattern = FAST.get(kind, pattern)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")),
                        lambda m: F.concat(m["gap"], F.when(m["hit"].isNull(), "").when(hide(m["value"]), MASK).otherwise(m["hit"])))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by MASK, n_chars following: every base match and
    the added kinds' live values. All documents and columns stay; clean texts are unchanged."""
    spans = candidates(docs)[1]
    added = F.col("kind").isin(*[k for k in KINDS if k not in BASE])
    rows = classify(spans, max_owners).filter(added & F.col("live")).select("value").distinct()
    live_rows = spans.join(rows, "value", "left_semi").filter(added).select("value", "repo")
    per_doc = live_rows.groupBy(F.col("repo").alias("_of")).agg(F.collect_set("value").alias("_live"))
    shape = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    maybe = F.lit(False)
    for kind in KINDS:
        if kind not in BASE:
            maybe |= text.rlike(FAST.get(kind, KINDS[kind][0]))
    joined = (docs.filter(maybe).withColumn("_repo", F.col("doc_id").cast("string"))
              .join(per_doc, F.col("_repo").eqNullSafe(F.col("_of")), "left")
              .select(*[docs[c] for c in shape], "_live"))
    out = docs.filter(~maybe).withColumn("_live", F.lit(None).cast("array<string>")).unionByName(joined)
    new = F.col("text")
    for kind, (_, _, least) in KINDS.items():
        if kind in BASE:
            hide = lambda v, least=least: F.length(v) >= least
        else:
            hide = lambda v, least=least: (F.length(v) >= least) & F.coalesce(F.array_contains(F.col("_live"), F.sha2(v, 256)), F.lit(False))
        out = out.withColumn("_t", _masked(new, kind, hide))
        new = F.col("_t")
    out = out.withColumn("text", F.col("_t"))
    if "n_chars" in shape:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*shape)


def _oracle_kind(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    quoted = pattern.replace("'", "''")
    more = " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')" if kind == "bare" else ""
    return f"""SELECT row, {list(KINDS).index(kind)} AS k, '{kind}' AS kind, upto - length(hit) AS s, upto AS e, value, doc_id AS repo, source AS owner FROM (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT row, doc_id, source, unnest(h) AS hit, unnest(v) AS value, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM (
      SELECT row, doc_id, source, regexp_extract_all(text, '{quoted}', 0) AS h, regexp_extract_all(text, '{quoted}', {group}) AS v,
             regexp_split_to_array(text, '{quoted}') AS g FROM d)))
WHERE length(value) >= {least}{more}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS ({' UNION ALL '.join(_oracle_kind(k) for k in KINDS)}),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners FROM a GROUP BY value),
b AS (SELECT a.*, o.owners <= {MAX_OWNERS} AS live FROM a JOIN o USING (value)),
u AS (SELECT * FROM b WHERE k < 3 UNION ALL SELECT * FROM b WHERE k = 3 AND live
      AND NOT EXISTS (SELECT 1 FROM b x WHERE x.row = b.row AND x.k < 3 AND x.s < b.e AND b.s < x.e)),
t AS (SELECT * FROM u UNION ALL SELECT * FROM b WHERE k = 4 AND live
      AND NOT EXISTS (SELECT 1 FROM u x WHERE x.row = b.row AND x.s < b.e AND b.s < x.e)),
g AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      count(*) FILTER (live) AS n_live, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base FROM t GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN g USING (row)
"""
