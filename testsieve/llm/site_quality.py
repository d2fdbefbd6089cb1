"""Document quality by hierarchical empirical Bayes over sites.

A logistic regression on shape features, fitted on a bounded sample of labelled
rows, gives each document's own evidence.  Hosts and paths within hosts gather
the evidence of their documents (of labelled ones, the label).  A host's rate is
shrunk toward the global rate, a path's toward its host's, by prior strengths
estimated from the spread between groups (method of moments); a document's own share
is taken out of its groups first.  The posterior adds to the document's log
odds what its path's rate says beyond the global one."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .logistic import fit_softmax, softmax

FIT_ROWS = 20_000
KEEP = 0.5
STRENGTH = (1.0, 1000.0)  # bounds of the estimated prior strengths
SITE_WEIGHT = 0.5
_MARKS = re.compile(r"[^\w\s]+")


def shape(text: str | None) -> list[float]:
    """Features of a whole text; null and empty texts give zeros."""
    w = (text or "").split()
    if not w:
        return [0.0] * 12
    n, chars = len(w), len(text)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    marks = _MARKS.findall(text)
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return [1.0, upper / max(1, letters), letters / chars, sum(len(m) > 1 for m in marks) / n, sum(map(len, marks)) / chars,
            len(set(w)) / n ** 0.8, same / n, chars / n / 10, np.log(n) / 10, min(1.0, w.count("|") * 2 / n),
            sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines), len(set(lines)) / len(lines)]


def _wide(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x[:, 1:] ** 2, np.sqrt(np.abs(x[:, 1:]))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple:
    """Weights of the classifier from about ``rows`` labelled documents (all if there are no
    more), one row of each id: (mean, spread, weights); without rows of both classes, of no effect."""
    def features(b: pa.RecordBatch):
        yield {"x": [shape(t) for t in b.column("text").to_pylist()], "y": b.column("y")}

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    known = C.written(C.fit_sample(known, "doc_id", rows), "labels")
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r"))
    got = C.map_rows(texts.select("r.text", "r.y"), features, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, 12), np.array([r["y"] for r in got], int)
    if len(set(y.tolist())) < 2:
        return np.zeros(34), np.ones(34), np.zeros((34, 2))
    x = _wide(x)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-9] = 1
    return mean, spread, fit_softmax((x - mean) / spread, y, 2, decay=1e-4, steps=1500)


def evidence(docs: DataFrame, model: tuple) -> DataFrame:
    """``doc_id, p_doc`` and the given ``host`` and ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b: pa.RecordBatch):
        mean, spread, weights = shared.value
        x = (_wide(np.array([shape(t) for t in b.column("text").to_pylist()])) - mean) / spread
        yield {c: b.column(c) for c in ("doc_id", "host", "path")} | {"p_doc": softmax(x @ weights)[:, 1].clip(1e-4, 1 - 1e-4)}

    return C.map_rows(docs, rows, "doc_id long, host string, path string, p_doc double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: float) -> float:
    """Prior strength by the method of moments from ``n, s`` of each group."""
    v = groups.where("n >= 2").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("s") / F.col("n") - rate) ** 2).alias("q")).first()
    if not v["k"] or v["n"] <= v["k"]:
        return STRENGTH[1]
    noise = rate * (1 - rate)
    between = max(1e-9, (v["q"] - v["k"] * noise) / v["n"])
    return float(min(STRENGTH[1], max(STRENGTH[0], noise / between - 1)))


def score(docs: DataFrame, labels: DataFrame, model: tuple) -> DataFrame:
    """``doc_id, text, host, path`` with ``doc_id, quality`` labels to ``doc_id, host, path,
    p_doc, host_rate, path_rate, score, keep``: one row per input row.

    Null hosts form one group, as do null paths of a host; null and empty texts have
    the features of an empty text; a document that labels repeat takes the highest;
    empty tables give no rows; other columns are ignored."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").cast("double")).alias("y"))
    rows = evidence(src, model).join(known, "doc_id", "left").select("*", F.coalesce("y", "p_doc").alias("e"))
    rows = C.written(rows.drop("y"), "evidence")
    paths = C.written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(0.999, max(0.001, (all_["s"] or 0.0) / (all_["n"] or 1)))
    k_host, k_path = _strength(hosts, rate), _strength(paths, rate)
    h = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    groups = paths.join(h, F.col("host").eqNullSafe(F.col("h"))).select(
        F.col("host").alias("gh"), F.col("path").alias("gp"), F.col("n").alias("pn"), F.col("s").alias("ps"), "hn", "hs")
    found = rows.join(groups, F.col("host").eqNullSafe(F.col("gh")) & F.col("path").eqNullSafe(F.col("gp")))
    host_rate = (F.col("hs") - F.col("e") + k_host * rate) / (F.col("hn") - 1 + k_host)
    path_rate = (F.col("ps") - F.col("e") + k_path * F.col("host_rate")) / (F.col("pn") - 1 + k_path)
    within = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    found = found.withColumn("host_rate", within(host_rate)).withColumn("path_rate", within(path_rate))
    odds = _logit(F.col("p_doc")) + SITE_WEIGHT * (_logit(F.col("path_rate")) - float(np.log(rate / (1 - rate))))
    found = found.withColumn("score", 1 / (1 + F.exp(-odds)))
    return found.select("doc_id", "host", "path", "p_doc", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("keep"))


def sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``docs`` with ``host`` and ``path``: of the page whose URL ends in the document's number
    (of several, the first page), else the document's source and no path."""
    url = F.col("url")
    of = pages.where("url is not null").select(
        F.regexp_extract(url, r"/(\d+)(?:\.\w+)?/?(?:[?#].*)?$", 1).try_cast("long").alias("number"), "page_id",
        F.regexp_extract(url, r"^\w+://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"^\w+://[^/]+/([^/?#]+)/", 1).alias("path"))
    of = of.where("number is not null").groupBy("number").agg(F.min(F.struct("page_id", "host", "path")).alias("site"))
    return docs.join(of, docs["doc_id"] == of["number"], "left").select(
        "doc_id", "text", F.coalesce("site.host", "source").alias("host"), F.coalesce("site.path", F.lit("")).alias("path"))
