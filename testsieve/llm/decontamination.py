"""Benchmark decontamination by winnowed word n-gram fingerprints.

A window is 13 consecutive words of an item, or a whole shorter item.  For windows
of L words the k-grams with k = L // 2 + 1 are hashed and the least hash of every
L - k + 1 consecutive ones is kept, on both sides: two texts that share a window
keep the same fingerprint inside it, so the join on fingerprints misses none.
Hits are extended along their diagonal (same offset between document and item);
words inside an equal run of at least L words are hit.  Where a document and an item
repeat their fingerprints, so that their places would meet in products, the pair's
windows are compared instead, in time that grows with the two texts' words.

Benchmarks of up to ``INDEX_WORDS`` words (the size is counted first) are sent to
the tasks as one index; beyond it documents and items meet in a shuffled join on
the fingerprints and the pairs found are extended on their texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SPAN = 13
SHARE = 20  # contaminated: n_hit * SHARE >= n_words
ITEMS = 256  # of a shuffled join, that meet a text together
INDEX_WORDS = 2_000_000  # about 40 MB of index in a Python worker

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (runs of digits, letters a-z and non-ASCII)."""
    return C.hash_words(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()) if text else np.empty(0, C.U64)


def fingerprints(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of a word sequence for windows of ``span`` words and
    their places; empty if the sequence has fewer words."""
    k = span // 2 + 1
    w = span - k + 1
    if len(h) < span:
        return np.empty(0, C.U64), np.empty(0, np.int64)
    g = C.window_hashes(h, k) + C.U64(span)
    if w == 1:
        return g, np.arange(len(g))
    at = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return g[at], at


def item_span(n: int) -> int:
    return min(n, SPAN)


class Index:
    """Fingerprints of benchmark items, sorted by (fingerprint, item), with the items' word hashes."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.ids, self.words = [], []
        fp, item, at = [], [], []
        for i, text in items:
            h = word_hashes(text)
            if not len(h):
                continue
            f, p = fingerprints(h, item_span(len(h)))
            fp.append(f)
            at.append(p)
            item.append(np.full(len(f), len(self.ids)))
            self.ids.append(i)
            self.words.append(h)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        fp, item, at = cat(fp, C.U64), cat(item, np.int64), cat(at, np.int64)
        order = np.lexsort((at, item, fp))
        fp, item, self.at = fp[order], item[order], at[order]
        # one entry for a fingerprint and an item: its places are at[begin:begin + n]
        self.begin = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (item[1:] != item[:-1])]) if len(fp) else np.empty(0, np.int64)
        self.fp, self.item = fp[self.begin], item[self.begin]
        self.n = np.diff(np.r_[self.begin, len(fp)])
        self.spans = sorted({item_span(len(h)) for h in self.words})

    def covered(self, h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words of a document are hit, and by windows of which items."""
        hit, found = np.zeros(len(h), bool), set()
        for span in self.spans:
            f, p = fingerprints(h, span)
            lo = np.searchsorted(self.fp, f, "left")
            if not (lo < len(self.fp)).any() or not (self.fp[np.minimum(lo, len(self.fp) - 1)] == f).any():
                continue
            f, which = np.unique(f, return_inverse=True)
            places, first = p[np.argsort(which, kind="stable")], np.r_[0, np.cumsum(np.bincount(which))]
            lo, n = np.searchsorted(self.fp, f, "left"), np.searchsorted(self.fp, f, "right")
            n -= lo
            mine = np.repeat(np.arange(len(f)), n)
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            by_item = np.argsort(self.item[entry], kind="stable")
            mine, entry = mine[by_item], entry[by_item]
            windows = None
            for a, b in _groups(self.item[entry]):
                i = int(self.item[entry[a]])
                words = self.words[i]
                ends = self._diagonals(words, h, places, first, mine[a:b], entry[a:b])
                if ends is None:
                    windows = C.window_hashes(h, span) if windows is None else windows
                    starts = np.flatnonzero(np.isin(windows, C.window_hashes(words, span)))
                    ends = np.stack([starts, starts + span], 1)
                if len(ends):
                    step = np.zeros(len(h) + 1, np.int64)
                    np.add.at(step, ends[:, 0], 1)
                    np.add.at(step, ends[:, 1], -1)
                    hit |= np.cumsum(step[:-1]) > 0
                    if self.ids[i] is not None:
                        found.add(self.ids[i])
        return hit, found

    def _diagonals(self, words, h, places, first, mine, entry) -> np.ndarray | None:
        """(start, end) of the equal runs of at least a window along the diagonals of shared
        fingerprints; None if these are too many to follow one by one."""
        need, most = item_span(len(words)), 4 * (len(h) + len(words))
        if ((first[mine + 1] - first[mine]) * self.n[entry]).sum() > most:
            return None
        diagonals = np.unique(np.concatenate([(places[first[m]:first[m + 1], None] - self.at[None, self.begin[e]:self.begin[e] + self.n[e]]).ravel()
                                              for m, e in zip(mine.tolist(), entry.tolist(), strict=True)]))
        if len(diagonals) * min(len(words), len(h)) > 16 * most:
            return None
        out = []
        for d in diagonals.tolist():
            a, b = max(0, -d), min(len(words), len(h) - d)
            if b - a < need:
                continue
            same = np.r_[False, words[a:b] == h[d + a:d + b], False]
            edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            out.append(edge[edge[:, 1] - edge[:, 0] >= need] + d + a)
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _groups(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(sorted_) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _small(items: DataFrame, most: int) -> bool:
    """Whether the benchmark's words (and rows) number at most ``most``."""
    n = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # a word takes a character, and a separator before the next
    return n[0] + n[1] // 2 <= most


def _judge(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def per_text(benchmark: DataFrame, index_words: int = INDEX_WORDS) -> Callable[[list[str | None]], list[tuple]] | None:
    """For benchmarks of bounded size: a function of texts to
    (n_words, n_hit, sorted item ids), to be used inside tasks; else None."""
    items = _items(benchmark)
    if not _small(items, index_words):
        return None
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    index = C.shared_model(items.sparkSession, rows, Index)

    def judge(texts):
        for t in texts:
            h = word_hashes(t)
            hit, found = index().covered(h)
            yield len(h), int(hit.sum()), sorted(found)

    return judge


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """``doc_id, text`` against ``item_id, text`` to ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``: one row per input row.

    Null texts have no words, and items without words no windows.  Windows of an item
    without id hit like any other; it is no item of ``n_items``.  Rows that repeat an
    item's id count as one item.  Ties do not arise: a word is hit or not.  Very long
    and repetitive texts take time and memory in proportion to their words.  Tables
    without rows are allowed; other columns are ignored."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    judge = per_text(benchmark, index_words)
    if judge is None:
        return _joined(docs, _items(benchmark))

    def rows(b: pa.RecordBatch):
        got = list(judge(b.column("text").to_pylist()))
        yield {"doc_id": b.column("doc_id"), "n_words": [x[0] for x in got], "n_hit": [x[1] for x in got],
               "n_items": [len(x[2]) for x in got],
               "items_sha256": [hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in got],
               "contaminated": [_judge(x[0], x[1]) for x in got]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_rows(docs, rows, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose texts are not contaminated."""
    judge = per_text(benchmark, index_words)
    if judge is not None:
        return C.filter_rows(docs, "text", lambda texts: [not _judge(n, hit) for n, hit, _ in judge(texts)])
    found = _joined(docs.select(F.md5("text").alias("doc_id"), "text"), _items(benchmark)).where("contaminated")
    found = C.written(found.select(F.col("doc_id").alias("found")).distinct(), "contaminated")
    return docs.join(found, F.md5(docs["text"]) == found["found"], "left_anti")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same by a shuffled join on fingerprints; equal texts are searched once."""
    named = docs.withColumn("digest", F.md5("text"))
    texts = C.written(named.where("text is not null").select("digest", "text").dropDuplicates(["digest"]), "distinct-texts")

    def lengths(b: pa.RecordBatch):
        yield {"span": sorted({item_span(n) for t in b.column("text").to_pylist() if (n := len(word_hashes(t)))})}

    spans = sorted(r["span"] for r in C.map_rows(items, lengths, "span long").distinct().collect())  # at most 13

    def prints(name: str, wanted: Callable[[int], list[int]]):
        def rows(b: pa.RecordBatch):
            for i, t in zip(b.column(name).to_pylist(), b.column("text").to_pylist(), strict=True):
                h = word_hashes(t)
                for s in wanted(len(h)):
                    f = np.unique(fingerprints(h, s)[0]).view(np.int64)
                    yield {"fp": f, name: [i] * len(f)}
        return rows

    items = items.distinct().withColumn("item", F.md5(F.to_json(F.struct("item_id", "text"))))
    of_items = C.map_rows(items, prints("item", lambda n: [item_span(n)] if n else []), "fp long, item string").distinct()
    of_docs = C.map_rows(texts, prints("digest", lambda n: [s for s in spans if s <= n]), "fp long, digest string")
    pairs = of_docs.join(of_items, "fp").select("digest", "item").distinct()
    # a text meets its items a few hundred at a time
    some = F.pmod(F.xxhash64("item"), F.lit(max(1, items.count() // ITEMS)))
    together = pairs.join(items, "item").groupBy("digest", some.alias("some")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def extend(b: pa.RecordBatch):
        for d, t, its in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), b.column("items").to_pylist(), strict=True):
            hit, found = Index([(x["item_id"], x["text"]) for x in its]).covered(word_hashes(t))
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2)
            yield {"digest": [d] * len(edge), "item_id": [None] * len(edge), "s": edge[:, 0], "e": edge[:, 1]}
            yield {"digest": [d] * len(found), "item_id": sorted(found), "s": [None] * len(found), "e": [None] * len(found)}

    result = C.written(C.map_rows(together.join(texts, "digest"), extend, "digest string, item_id string, s long, e long"), "hit-spans")
    spans_hit, items_hit = result.where("s is not null"), result.where("item_id is not null")
    # length of the union of a text's spans: what each adds beyond those that start before it
    before = Window.partitionBy("digest").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
    n_hit = spans_hit.select("digest", "s", "e").distinct().withColumn("added", added).groupBy("digest").agg(
        F.sum("added").alias("n_hit"))
    found = items_hit.select("digest", "item_id").distinct().groupBy("digest").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))

    def count(b: pa.RecordBatch):
        yield {"digest": b.column("digest"), "n_words": [len(word_hashes(t)) for t in b.column("text").to_pylist()]}

    per = C.map_rows(texts, count, "digest string, n_words long").join(n_hit, "digest", "left").join(found, "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    n_words, n_hit_ = zero(F.col("n_words")), zero(F.col("n_hit"))
    return named.select("doc_id", "digest").join(per, "digest", "left").select(
        "doc_id", n_words.alias("n_words"), n_hit_.alias("n_hit"), zero(F.col("n_items")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit_ > 0) & (n_hit_ * SHARE >= n_words)).alias("contaminated"))
