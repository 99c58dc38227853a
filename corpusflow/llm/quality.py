"""Quality and toxicity by hierarchical empirical Bayes.

A document classifier gives each document's evidence (a logit per head: ``quality``, ``toxic``).
Hosts and their paths are judged by the mean probability of their documents: a path's posterior is
shrunk towards its host's, a host's towards the corpus's, each with a strength estimated from the
data (method of moments on the aggregated means), so sparse sites say little. A document's posterior
is its own evidence moved by the log odds of its path (the document itself left out) against the
corpus. ``kept``: quality is likelier than not, and toxicity is not.

The classifier is fitted on ``SAMPLE`` labelled documents in the mean, chosen by a hash of doc_id:
one half chooses words and word shapes whose presence tells the classes apart (at most ``WORDS``
a head), the other fits a logistic regression on their summed log odds and a few ratios.

Defined results: null text counts as empty; labels that are null are left out, several labels of a
document count as the worst; a head whose sample lacks a class gives every document the same
probability; a null host or path is one of its own; repeated rows are scored each; an empty table
gives an empty result; other columns are ignored.

Scale: texts are read by the sampled fit and once for the scores, and are never shuffled: the sampled
labels (bounded by SAMPLE) are broadcast to them. Sites are partial aggregates of (doc_id, site, logits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_as_table
from .pieces import WordStore, text_blocks

SAMPLE = 20_000
WORDS = 2000
MIN_Z = 4.0
HEADS = ("quality", "toxic")
BLOCK_BYTES = 4_000_000
STORE_WORDS = 300_000
RATIOS = 6  # numeric features after the two lexicon scores
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&=+|/\\~-_"

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3


def _features(token: str) -> tuple[str, ...]:
    """A token's features: its word, lower case and without punctuation at the ends, and its shape
    (letters and digits by kind, runs of a kind once)."""
    word = token.strip(_EDGE).lower()[:32]
    shape, last = [], ""
    for c in token[:64]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            shape.append(k)
        last = k
    out = (f"w {word}",) if word else ()
    return (*out, f"s {''.join(shape[:8])}")


def _ratios(texts: list[str]) -> np.ndarray:
    """Per text: log words, shares of capitals, digits and punctuation, share of repeated lines,
    share of distinct words."""
    out = np.zeros((len(texts), RATIOS))
    for k, t in enumerate(texts):
        kinds = np.bincount(_KIND[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)], minlength=4)
        words, lines = t.split(), [x for x in t.split("\n") if x]
        n = max(1, int(kinds.sum()))
        out[k] = (math.log1p(len(words)), kinds[1] / n, kinds[2] / n, kinds[3] / n,
                  1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, len(words)))
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, quality, toxic) -> (feature, docs and positives by head), summed per batch."""
    for batch in batches:
        sums: dict[str, list[int]] = {}
        for text, *labels in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            add = [x for y in labels for x in ((1, y) if y is not None else (0, 0))]
            for f in {f for token in set((text or "").split()) for f in _features(token)}:
                have = sums.setdefault(f, [0, 0, 0, 0])
                for k in range(4):
                    have[k] += add[k]
        cols = list(zip(*sums.values(), strict=True)) if sums else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array(c, pa.int64()) for c in cols]],
                                         names=["feature", "n0", "y0", "n1", "y1"])


@dataclass
class Classifier:
    """Lexicons (feature -> log odds by head) and, per head, the weights of (1, lexicon score,
    ratios); the ratios are scaled by ``mean`` and ``std``."""

    odds: dict[str, tuple[float, float]]
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def lexicon_scores(self, texts: list[str], store: WordStore) -> np.ndarray:
        tokens = [set(t.split()) for t in texts]
        for w in store.missing(set().union(*tokens)):
            store.now[w] = tuple(f for f in _features(w) if f in self.odds)
        out = np.zeros((len(texts), len(HEADS)))
        for k, mine in enumerate(tokens):
            found = {f for token in mine for f in store.now[token]}
            for f in found:
                out[k] += self.odds[f]
        return out

    def logits(self, texts: list[str], store: WordStore) -> np.ndarray:
        scores, ratios = self.lexicon_scores(texts, store), (_ratios(texts) - self.mean) / self.std
        out = np.empty((len(texts), len(HEADS)))
        for h in range(len(HEADS)):
            x = np.column_stack([np.ones(len(texts)), scores[:, h], ratios])
            out[:, h] = np.clip(x @ self.weights[h], -30, 30)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w, keep = np.zeros(x.shape[1]), ridge * len(y) / 100 * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Classifier:
    """Learn from (doc_id, text) and (doc_id, quality, toxic)."""
    known = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.filter(at < (1 << 30) * min(1.0, sample / max(1, n))).withColumn("half", F.pmod(F.hash("doc_id"), F.lit(2)))
    rows = keep_as_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic", "half"), "quality-sample")
    seen = (rows.filter("half = 0").select("text", "quality", "toxic").mapInArrow(_presence, "feature string, n0 long, y0 long, n1 long, y1 long")
            .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n0", "y0", "n1", "y1")]))
    totals = rows.filter("half = 0").agg(*[x for h in HEADS for x in (F.count(h), F.sum(h))]).first()
    odds: dict[str, list[float]] = {}
    for k, _ in enumerate(HEADS):
        docs_n, pos = int(totals[2 * k] or 0), int(totals[2 * k + 1] or 0)
        if not 0 < pos < docs_n:
            continue
        c, y = F.col(f"n{k}"), F.col(f"y{k}")
        with_, without = (y + 0.5) / (pos + 1), (c - y + 0.5) / (docs_n - pos + 1)
        odd = F.log(with_ / without)
        z = (y - c * F.lit(pos / docs_n)) / F.sqrt(c * F.lit(pos / docs_n * (1 - pos / docs_n)) * (1 - c / F.lit(docs_n)) + 1e-9)
        best = (seen.filter(c >= 5).withColumn("z", F.abs(z)).filter(F.col("z") >= MIN_Z)
                .select("feature", "z", odd.alias("odd")).orderBy(F.desc("z"), "feature").limit(words).collect())
        for f, _, o in best:
            odds.setdefault(f, [0.0, 0.0])[k] = float(o)
    model = Classifier({f: tuple(o) for f, o in odds.items()}, np.zeros((len(HEADS), 2 + RATIOS)), np.zeros(RATIOS), np.ones(RATIOS))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(STORE_WORDS)
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(0), BLOCK_BYTES):
                x = np.column_stack([sent.value.lexicon_scores(texts, store), _ratios(texts)])
                yield pa.RecordBatch.from_arrays([pa.array(list(x)), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)],
                                                 names=["x", "quality", "toxic"])
    table = (rows.filter("half = 1").select("text", "quality", "toxic")
             .mapInArrow(describe, "x array<double>, quality int, toxic int").toPandas())  # SAMPLE / 2 rows
    if len(table):
        x = np.stack(table["x"].to_numpy())
        model.mean, model.std = x[:, 2:].mean(0), x[:, 2:].std(0) + 1e-6
        for k, head in enumerate(HEADS):
            ok = table[head].notna().to_numpy()
            y = table.loc[ok, head].to_numpy(float)
            if 0 < y.sum() < len(y):
                model.weights[k] = _logistic(np.column_stack([np.ones(ok.sum()), x[ok, k], (x[ok, 2:] - model.mean) / model.std]), y)
            elif len(y):
                model.weights[k, 0] = 20.0 if y.all() else -20.0
    return model


def evidence(docs: DataFrame, model: Classifier, host: str, path: str) -> DataFrame:
    """doc_id, host, path and the classifier's logits of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(host).alias("host"), key(path).alias("path"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(STORE_WORDS)
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(3), BLOCK_BYTES):
                x = sent.value.logits(texts, store)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(3)], pa.array(x[:, 0]), pa.array(x[:, 1])],
                                                 names=["doc_id", "host", "path", *HEADS])
    return rows.mapInArrow(run, "doc_id long, host string, path string, quality double, toxic double")


def _sigmoid(c):
    return 1 / (1 + F.exp(-c))


def _strength(groups: DataFrame, towards, mean: float) -> float:
    """Beta prior strength by moments: how much group means vary around ``towards`` beyond what
    their sizes explain. ``groups``: n, s."""
    off = F.col("s") / F.col("n") - towards
    row = groups.agg(F.sum(F.col("n") * off * off).alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                     F.count(F.lit(1)).alias("g")).first()
    if not row["n"] or row["g"] < 2 or not 0 < mean < 1:
        return 100.0
    within = mean * (1 - mean)
    between = (row["q"] - (row["g"] - 1) * within) / max(1e-9, row["n"] - row["n2"] / row["n"])
    return float(min(1e4, max(1.0, within / between - 1))) if between > 0 else 1e4


def judge(scored: DataFrame) -> DataFrame:
    """``evidence``'s rows (as a table) -> per document the posterior of each head, the posteriors
    of its host and path, and ``kept``."""
    out = scored
    for head in HEADS:
        rows = scored.select("host", "path", _sigmoid(F.col(head)).alias("p"))
        paths = keep_as_table(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), f"{head}-paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        total = hosts.agg(F.sum("n"), F.sum("s")).first()
        mean = min(1 - 1e-6, max(1e-6, (total[1] or 0.0) / (total[0] or 1)))
        strong = _strength(hosts, F.lit(mean), mean)
        judged = hosts.select("host", ((F.col("s") + strong * mean) / (F.col("n") + strong)).alias("host_p"))
        sites = paths.join(judged, "host")
        finer = _strength(sites, F.col("host_p"), mean)
        sites = sites.select("host", "path", F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("host_p").alias(f"host_{head}"),
                             ((F.col("s") + finer * F.col("host_p")) / (F.col("n") + finer)).alias(f"path_{head}"))
        others = ((F.greatest(F.lit(0.0), F.col("_s") - _sigmoid(F.col(head))) + finer * F.col(f"host_{head}")) / (F.col("_n") - 1 + finer))
        others = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), others))
        moved = F.col(head) + F.log(others / (1 - others)) - math.log(mean / (1 - mean))
        out = out.join(sites, ["host", "path"]).withColumn(f"p_{head}", _sigmoid(moved)).drop("_n", "_s")
    return out.select("doc_id", *[c for h in HEADS for c in (f"p_{h}", f"host_{h}", f"path_{h}")],
                      ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Quality and toxicity of (doc_id, text, host, path); ``path`` is read within its host."""
    return judge(keep_as_table(evidence(docs, fit(docs, labels), host, path), "quality-evidence"))


def host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path (first directory) of their urls, for use as site columns."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    first = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return pages.withColumn("host", F.nullif(host, F.lit(""))).withColumn("path", F.nullif(first, F.lit("")))
