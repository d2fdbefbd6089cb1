"""Language identification: words first, shorter and shorter character n-grams after.

A word that the training texts hold scores each language by its log frequency
there.  An unseen word backs off to the longest character n-grams (5 down to 1,
with word boundaries) of which any is known, and scores their mean log frequency.
A text's language is the one with the largest sum; its score is the posterior
probability under equal priors.

The model is fitted on a bounded sample of distinct labelled texts (``FIT_ROWS`` for
each language) and holds about ``WORDS`` words and ``GRAMS`` n-grams at most, the most
frequent ones of each language in equal shares, so its size does not grow with the
corpus; every text is scored whole."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNKNOWN = "und"
FIT_ROWS = 4_000
WORDS, GRAMS = 100_000, 50_000
LONGEST = 5
CACHE = 120_000  # unseen words kept by a worker: at most about 25 MB
SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f" {word} "
    return [w[i:i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language of known words and n-grams."""

    def __init__(self, langs: list[str], word_counts: list[tuple[str, str, int]], gram_counts: list[tuple[str, str, int]]):
        self.langs = langs
        self.word, self.word_logs = self._logs(word_counts, lambda w: 0)
        self.gram, self.gram_logs = self._logs(gram_counts, len)
        self.rows = C.Recent(self._unseen, CACHE)

    def _logs(self, counts, kind) -> tuple[dict[str, int], np.ndarray]:
        """Number of each entry, and a row of log frequencies for each number."""
        at = {x: i for i, x in enumerate(self.langs)}
        total: Counter = Counter()
        found: dict[str, list[float]] = {}
        for g, lang, n in counts:
            found.setdefault(g, [0] * len(at))[at[lang]] += n
            total[kind(g), lang] += n
        size = Counter(kind(g) for g in found)
        floor = {(k, x): math.log(total[k, x] + SMOOTH * (size[k] + 1)) for k in size for x in self.langs}
        logs = np.empty((len(found), len(at)))
        for i, (g, v) in enumerate(found.items()):
            logs[i] = [math.log(n + SMOOTH) - floor[kind(g), x] for n, x in zip(v, self.langs, strict=True)]
        return {g: i for i, g in enumerate(found)}, logs

    def _unseen(self, word: str) -> bytes:
        for n in range(LONGEST, 0, -1):
            known = [self.gram[g] for g in grams(word, n) if g in self.gram]
            if known:
                return self.gram_logs[known].mean(axis=0).tobytes()
        return bytes(8 * len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(words(text))
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        at = np.array([self.word.get(w, -1) for w in found])
        n = np.fromiter(found.values(), float, len(found))
        total = n[at >= 0] @ self.word_logs[at[at >= 0]]
        if (at < 0).any():
            unseen = b"".join([self.rows[w] for w, i in zip(found, at.tolist(), strict=True) if i < 0])
            total = total + n[at < 0] @ np.frombuffer(unseen).reshape(-1, len(self.langs))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def fit(labelled: DataFrame, rows_each: int = FIT_ROWS) -> tuple:
    """``text, lang`` to the parts of a model.  Rows without text or lang are left out;
    without any other row the model knows no language.

    The sample takes about ``rows_each`` distinct texts of each language by a hash of the
    text; copies count once."""
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    per = {r["lang"]: r["count"] for r in labelled.groupBy("lang").agg(
        F.approx_count_distinct(F.xxhash64("text"), 0.01).alias("count")).collect()}
    if not per:
        return [], [], []
    share = F.lit(1.0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_each / max(1, n)))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["text", "lang"])

    def count(b: pa.RecordBatch):
        found: dict[str, Counter] = {}
        for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words(t))
        for lang, c in found.items():
            yield {"g": list(c), "lang": [lang] * len(c), "n": list(c.values())}

    counts = C.written(C.map_rows(sample, count, "g string, lang string, n long").groupBy("g", "lang").agg(F.sum("n").alias("n")), "words")

    def count_grams(b: pa.RecordBatch):
        found: dict[str, Counter] = {}
        for w, lang, n in zip(*(b.column(c).to_pylist() for c in ("g", "lang", "n")), strict=True):
            c = found.setdefault(lang, Counter())
            for k in range(1, LONGEST + 1):
                for g in grams(w, k):
                    c[g] += n
        for lang, c in found.items():
            yield {"g": list(c), "lang": [lang] * len(c), "n": list(c.values())}

    def most(df: DataFrame, k: int) -> list[tuple[str, str, int]]:
        """All counts of the most frequent entries of each language, about ``k`` at most: an equal
        share each, and what a language does not need goes to the others."""
        sizes: dict[str, dict[int, int]] = {}
        for lang, n, entries in df.groupBy("lang", "n").agg(F.count("*").alias("entries")).collect():
            sizes.setdefault(lang, {})[n] = entries
        cut, left = F.lit(False), k
        for i, lang in enumerate(sorted(sizes, key=lambda x: (sum(sizes[x].values()), x))):
            room = share = left // (len(sizes) - i)
            for n in sorted(sizes[lang], reverse=True):
                if sizes[lang][n] > room:
                    # of equal counts a part by hash
                    tie = F.pmod(F.xxhash64(F.lit(5), "g"), F.lit(1 << 30)) < int(room / sizes[lang][n] * (1 << 30))
                    cut = cut | ((F.col("lang") == lang) & ((F.col("n") > n) | ((F.col("n") == n) & tie)))
                    room = 0
                    break
                room -= sizes[lang][n]
            else:
                cut = cut | (F.col("lang") == lang)
            left -= share - room
        top = df.where(cut).select("g").distinct()
        return [tuple(r) for r in df.join(F.broadcast(top), "g").select("g", "lang", "n").collect()]

    sums = C.map_rows(counts, count_grams, "g string, lang string, n long").groupBy("g", "lang").agg(F.sum("n").alias("n"))
    return sorted(per), most(counts, WORDS), most(C.written(sums, "grams"), GRAMS)


def held_out() -> F.col:
    """Whether a document takes no part in the fit: crc32 of its id mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("text", "lang")


def predictor(spark, parts: tuple):
    """A function of texts to (language, score) for use in tasks."""
    model = C.shared_model(spark, parts, lambda p: Model(*p))

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        m = model()
        return [m.predict(t) for t in texts]

    return predict


def identify(docs: DataFrame, parts: tuple) -> DataFrame:
    """``doc_id, text`` to ``doc_id, held_out, lang_pred, score``: one row per input row.

    Texts that are null or have no letter, and all texts under a model without
    languages, give ``und`` and 0.  Words of which nothing is known say nothing; ties
    go to the first language by name.  A null id counts as training row."""
    predict = predictor(docs.sparkSession, parts)

    def rows(b: pa.RecordBatch):
        got = predict(b.column("text").to_pylist())
        yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
               "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    src = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return C.map_rows(src, rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
