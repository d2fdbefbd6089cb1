"""Licence notices: a trained paragraph classifier confirmed by template comparison.

A paragraph is a line.  A notice may also be wrapped: in each block of lines (up to
one without words) neighbouring lines that together hold a template are joined and
judged as one paragraph.  A paragraph's words and word pairs that occur in licence templates are
the features of a softmax regression over licence families and ``unknown``, trained
on the templates (whole, cut, and set between words of the corpus) and on
a bounded sample of the corpus's own paragraphs, in pieces of at most
``FIT_PIECE`` characters, as unknowns.  Half of the unknowns
is held out: a family counts only above the probability that at most
``FALSE_SHARE`` of those reach.  It must then be confirmed: a template of the family
has at least ``CONTAINED`` of its word pairs, and all its figures, in the paragraph."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .logistic import fit_softmax, softmax

FIT_PARAGRAPHS = 4_000
FIT_PIECE = 2_000
FALSE_SHARE = 0.001
CONTAINED = 0.8
SPREAD = 1.5  # the words between the first and the last line of a wrapped notice, in lengths of the template
UNKNOWN = "unknown"

# Sentences of well-known licence notices by family.
TEMPLATES = {
    "agpl-3": ["licensed under the GNU Affero General Public License, version 3",
               "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
                 "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD License.", "licensed under the BSD 3-Clause License", "licensed under the BSD 2-Clause License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"],
    "cc-by": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Released under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication"],
    "gpl-2": ["licensed under the GNU General Public License, version 2",
              "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "gpl-3": ["licensed under the GNU General Public License, version 3",
              "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "isc": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl-2": ["licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
FAMILIES = [*TEMPLATES, UNKNOWN]
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pairs(w: list[str]) -> Counter:
    return Counter(zip(w, w[1:], strict=False))


_KNOWN = [(f, _pairs(w), {x for x in w if x.isdigit()}, len(w)) for f, ts in TEMPLATES.items() for w in map(words, ts)]
_PAIRS = {p for _, ps, _, _ in _KNOWN for p in ps}
_HOLDERS = {p: [(k, ps[p]) for k, (_, ps, _, _) in enumerate(_KNOWN) if p in ps] for p in _PAIRS}
_VOCABULARY = {g: i for i, g in enumerate(sorted({x for p in _PAIRS for x in p}) + sorted(_PAIRS))}


def features(w: list[str]) -> np.ndarray:
    """Shares of the known words and pairs (square roots of counts, of length one), the
    share of words that are known, and one."""
    x = np.zeros(len(_VOCABULARY) + 2)
    for g, n in (Counter(w) + _pairs(w)).items():
        if (i := _VOCABULARY.get(g)) is not None:
            x[i] = n ** 0.5
    if length := float(np.sqrt((x * x).sum())):
        x /= length
    x[-2] = sum(v in _VOCABULARY for v in w) / len(w) if w else 0
    x[-1] = 1
    return x * np.r_[np.full(len(x) - 2, 3.0), 3.0, 1.0]


def confirmed(family: str, w: list[str]) -> bool:
    """Whether a template of the family is (nearly) contained in the words."""
    have, figures = _pairs(w), set(w)
    return any(f == family and digits <= figures and sum((ps & have).values()) >= CONTAINED * sum(ps.values()) for f, ps, digits, _ in _KNOWN)


def _matched(lines: list[list[str]], k: int) -> int:
    """How many of the word pairs of template ``k`` the joined lines hold."""
    return sum((_KNOWN[k][1] & _pairs([w for line in lines for w in line])).values())


def wrapped(block, pairs: set) -> list[tuple[int, int]]:
    """Runs of at least two lines (first, behind the last) that hold a template which
    reaches over their ends; ``block`` gives the words of the lines, ``pairs`` are the
    known pairs of the lines and across them."""
    tally: Counter = Counter()
    for p in pairs:
        for k, n in _HOLDERS[p]:
            tally[k] += n
    able = [k for k, n in tally.items() if n >= CONTAINED * sum(_KNOWN[k][1].values())]
    out, lines = set(), block() if able else []
    for k in able:
        _, ps, digits, length = _KNOWN[k]
        least = CONTAINED * sum(ps.values())
        i = 0
        while i < len(lines) - 1:
            left, got, inner, last = Counter(ps), 0, 0, None
            best, end = 0, i
            for j in range(i, len(lines)):
                for w in lines[j]:
                    if left.get((last, w), 0) > 0:
                        left[last, w] -= 1
                        got += 1
                    last = w
                if got > best:
                    best, end = got, j + 1
                elif j == i:
                    # the line may still begin a pair with the next one
                    if (last, lines[i + 1][0]) not in ps:
                        break
                inner += len(lines[j]) if j > i else 0
                if inner > SPREAD * length:
                    break
            if best < least:
                i += 1
                continue
            first = i
            while first < end - 1 and _matched(lines[first + 1:end], k) >= best:
                first += 1
            if end - first > 1 and digits <= {w for line in lines[first:end] for w in line}:
                out.add((first, end))
            i = max(end - 1, i + 1)
    return sorted(out)


def train(unknown: list[str], seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights, and the probability above which a family counts."""
    rng = np.random.default_rng(seed)
    plain = [w for w in map(words, unknown) if w]
    fill = [x for w in plain[:500] for x in w[:20]] or ["the"]
    some = lambda n: list(rng.choice(fill, n))
    x, y = [], []
    for k, (family, notices) in enumerate(TEMPLATES.items()):
        for notice in map(words, notices):
            for turn in range(12):
                w = list(notice)
                if turn > 8 and len(w) > 6:
                    w = [v for v in w if rng.random() > 0.1]
                if turn:
                    w = some(int(rng.integers(0, 2 + 3 * turn))) + w + some(int(rng.integers(0, 2 + 3 * turn)))
                x.append(features(w))
                y.append(k)
    # words of notices without a notice's order, beside the corpus's own paragraphs
    every = sorted({v for p in _PAIRS for v in p})
    odd = [list(rng.choice(every, int(rng.integers(1, 12)))) + some(int(rng.integers(0, 12))) for _ in range(200)]
    held = [features(w) for w in plain[1::2] + odd[1::2]]
    for w in plain[::2] + odd[::2]:
        x.append(features(w))
        y.append(len(FAMILIES) - 1)
    y_ = np.array(y)
    share = 1.0 / np.bincount(y_, minlength=len(FAMILIES)).clip(1)[y_]
    share[y_ == len(FAMILIES) - 1] *= 3
    weights = fit_softmax(np.array(x), y_, len(FAMILIES), share, decay=1e-4)
    top = softmax(np.array(held) @ weights)[:, :-1].max(axis=1)
    return weights, max(0.5, float(np.quantile(top, 1 - FALSE_SHARE)))


def _unknowns(docs: DataFrame, most: int) -> list[str]:
    """A bounded sample of paragraphs that share no run of three words with a template."""
    triples = {t for ts in TEMPLATES.values() for w in map(words, ts) for t in zip(w, w[1:], w[2:], strict=False)} | {("all", "rights", "reserved")}

    def rows(b: pa.RecordBatch):
        lines = [p for t in b.column("text").to_pylist() for line in t.split("\n") for p in (line[i:i + FIT_PIECE] for i in range(0, len(line), FIT_PIECE))]
        yield {"p": [p for p in lines if (w := words(p)) and triples.isdisjoint(zip(w, w[1:], w[2:], strict=False))]}

    texts = C.fit_sample(docs.where("text is not null").select(F.col("text").cast("string").alias("text")), "text", most)
    found = C.map_rows(texts, rows, "p string").distinct()
    return [r["p"] for r in found.orderBy(F.xxhash64("p"), "p").limit(most).collect()]


def fit(docs: DataFrame, paragraphs: int = FIT_PARAGRAPHS) -> tuple[np.ndarray, float]:
    return train(_unknowns(docs, paragraphs))


def scan(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_paragraphs, n_licence, families, family, score,
    spans``: one row per input row.

    ``families``: those found, sorted, comma-joined; ``family`` and ``score``: the one of the
    highest probability (the first by place among equals), or ``unknown`` and 0; ``spans``:
    family:start:end in code points of each notice's paragraph, from the first to the
    last line of a wrapped one, which counts once (joined to notices of its family
    that share lines with it).  ``n_paragraphs`` counts lines.  Null and empty texts
    have no paragraph; repeated rows give equal rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: dict = {}

    def judge(w: list[str]):
        if _PAIRS.isdisjoint(zip(w, w[1:], strict=False)):
            return None  # no template can be contained
        weights, least = shared.value
        probability = softmax(features(w)[None] @ weights)[0]
        for k in np.argsort(-probability, kind="stable").tolist():
            if FAMILIES[k] == UNKNOWN or probability[k] < least:
                return None
            if confirmed(FAMILIES[k], w):
                return FAMILIES[k], float(probability[k])
        return None

    def line(p: str):
        """(what a line is by itself, its known pairs, first and last word)."""
        w = words(p)
        pairs = _PAIRS.intersection(zip(w, w[1:], strict=False))
        return judge(w) if pairs else None, pairs, w[0] if w else "", w[-1] if w else ""

    def joined(block: list[tuple], text: str, found: list[tuple]):
        """Adds the wrapped notices of a block, (start, end, known pairs, first word, last word) of each line."""
        pairs = {(x[4], y[3]) for x, y in zip(block, block[1:], strict=False)} & _PAIRS
        if not pairs:
            return  # every template that begins in one line ends there
        pairs.update(*(x[2] for x in block))
        for i, k in wrapped(lambda: [words(text[x[0]:x[1]]) for x in block], pairs):
            got = judge(words(text[block[i][0]:block[k - 1][1]]))
            if got:
                start, end, score = block[i][0], block[k - 1][1], got[1]
                same = [f for f in found if f[0] == got[0] and f[2] < end and start < f[3]]
                for f in same:
                    found.remove(f)
                    start, end, score = min(start, f[2]), max(end, f[3]), max(score, f[1])
                found.append((got[0], score, start, end))

    def rows(b: pa.RecordBatch):
        known = made.setdefault("known", C.Recent(line, 20_000))
        out: dict[str, list] = {c: [] for c in ("n_paragraphs", "n_licence", "families", "family", "score", "spans")}
        for t in b.column("text").to_pylist():
            at, n, found, block = 0, 0, [], []
            for p in [*(t or "").split("\n"), ""]:
                n += bool(p)
                got, pairs, first, last = known[p] if len(p) < 400 else line(p)
                if got:
                    found.append((*got, at, at + len(p)))
                if first:
                    block.append((at, at + len(p), pairs, first, last))
                else:
                    if len(block) > 1:
                        joined(block, t, found)
                    block = []
                at += len(p) + 1
            found.sort(key=lambda f: (f[2], f[3], f[0]))
            best = max(found, key=lambda f: f[1], default=(UNKNOWN, 0.0))
            for c, v in zip(out, (n, len(found), ",".join(sorted({f[0] for f in found})), best[0], best[1],
                                  ",".join(f"{f}:{s}:{e}" for f, _, s, e in found)), strict=True):
                out[c].append(v)
        yield {"doc_id": b.column("doc_id")} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows,
                      f"doc_id {kind}, n_paragraphs long, n_licence long, families string, family string, score double, spans string")
