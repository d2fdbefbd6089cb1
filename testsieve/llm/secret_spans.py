"""Secret spans: fixed patterns, and character Markov models for what they miss.

Second-order character models are trained from labelled samples.  Random strings: the
values that the fixed patterns find, and drawn strings of the alphabets that keys are
written in (``labelled_random``); there is a model for each alphabet, and a string's
likelihood is their mean.  Ordinary identifiers: other runs of the same characters, each
distinct one once, and identifiers made of neighbouring ones (camel case, with a number).
All models back off to shorter contexts where the samples say little.  Runs without the
fixed spans are cut at ``=``, and into parts at ``/``, ``-`` and ``_``; neighbouring parts
of the largest sum are a secret if they have at least ``RUN`` characters of two kinds and
the log-likelihood ratio of the two sides is at least ``LIMIT`` in all and ``PER_CHAR`` a
character.  Random strings of one kind of letters alone are told apart from words of
unseen languages by no model here and are not found."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common as C

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_PARTS = re.compile(r"[A-Za-z0-9+]+")
RUN = 8
LIMIT, PER_CHAR = 5.5, 0.45
JOIN, DROP = 1.0, 6.0  # what a cut between two parts costs; the loss that ends a stretch of parts
FIT_ROWS = 40_000
_CACHE = 100_000
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# The alphabets of the drawn labelled strings.
ALPHABETS = (_DIGIT + "abcdef", _DIGIT + "ABCDEF", _LOWER + _DIGIT, _UPPER + _DIGIT, _UPPER + "234567",
             _LOWER + _UPPER, _LOWER + _UPPER + _DIGIT, _LOWER + _UPPER + _DIGIT + "+")
DRAWN = 1_000  # labelled strings of an alphabet, of 8 to 48 characters, drawn from a fixed seed
EVIDENCE = (20_000, 5_000)  # how often a context must be seen for half of the weight: two characters, one
FORMS = 2  # of so many ordinary runs one identifier is made

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns (whole matches), in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _outside(text: str, spans: list[Span]):
    """(start, string) of the stretches of runs between the spans (in order), without ``=``."""
    k, past = 0, 0  # the next span, and the furthest end of those passed
    for m in _RUN.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            s, _, e = spans[k]
            k += 1
            if past < s:
                yield from _cut(text, max(at, past), s)
            past = max(past, e)
        if past < end:
            yield from _cut(text, max(at, past), end)


def _cut(text: str, at: int, end: int):
    for part in text[at:end].split("=") if at < end else ():
        if len(part) >= RUN:
            yield at, part
        at += len(part) + 1


def samples(text: str) -> tuple[list[str], list[str]]:
    """Labelled strings of a text: values of the fixed patterns, parts of other runs."""
    spans = base_spans(text)
    secret = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if spans else []
    secret += [text[s:e] for s, k, e in spans if k]
    return secret, [p for _, s in _outside(text, spans) for p in _PARTS.findall(s)]


def identifiers(runs: list[str]) -> list[str]:
    """Labelled identifiers, one for each ``FORMS`` ordinary runs: two neighbours in camel case,
    a number of one to four digits behind or between, capitals, a bare number or hour."""
    plain = [r for r in runs if r.isalpha() and len(r) < 16]
    out = []
    for a, b in zip(plain[::FORMS], plain[1::FORMS], strict=False):
        n = zlib.crc32(f"{a}{b}".encode())
        number = str(n % 10 ** (1 + n % 4))
        out.append((a.lower() + b.capitalize(), a.capitalize() + b.capitalize() + number, a.lower() + number, a.lower() + number + b.lower(),
                    a.lower() + number + b.capitalize(), a.upper(), a.upper() + number, number, f"{n % 100:02d}T{n // 100 % 100:02d}")[n // 10_000 % 9])
    return out


def labelled_random() -> list[tuple[int, str]]:
    """(alphabet, string) of drawn strings, the same in every worker."""
    rng = np.random.default_rng(20240611)
    out = []
    for k, alphabet in enumerate(ALPHABETS):
        sizes = rng.integers(8, 49, DRAWN)
        drawn = "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), sizes.sum())])
        out += [(k, drawn[e - n:e]) for n, e in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
    return out


def _steps(s: str):
    """(two characters before, character) of a string, its end included."""
    t = f"  {s} "
    return [t[i:i + 3] for i in range(len(t) - 2)]


def _kind(c: str) -> str:
    return "l" if c in _LOWER else "u" if c in _UPPER else "d" if c in _DIGIT else "e" if c == " " else "+"


class Chain:
    """A second-order Markov model of characters that backs off."""

    def __init__(self, size: int):
        self.size = size  # of the alphabet, and the end
        self.n: Counter = Counter()

    def add(self, step: str, k: int = 1) -> None:
        for g in (step, step[1:], step[2:]):
            self.n[g] += k
            self.n[g[:-1], len(g)] += k

    def chance(self, step: str) -> float:
        n, p = self.n, 1 / self.size
        if among := n["", 1]:
            p = (n[step[2:]] + p) / (among + 1)
        for g, half in ((step[1:], EVIDENCE[1]), (step, EVIDENCE[0])):
            among = n[g[:-1], len(g)]
            p = (n[g] + half * p) / (among + half)
        return p


class Model:
    def __init__(self, counts: list[tuple[bool, str, int]]):
        # a random string belongs to the smallest alphabet that holds it; found ones of other characters to the last
        self.random = [Chain(len(a) + 1) for a in (*ALPHABETS, ALPHABETS[-1] + "/_=-.")]
        for k, s in labelled_random():
            for g in _steps(s):
                self.random[k].add(g)
        letters, kinds = Counter(), Counter()
        for secret, step, k in counts:
            if secret:
                self._found(step, k)
                continue
            kinds[_kind(step[1]), _kind(step[2])] += k
            kinds[_kind(step[1])] += k
            if step[2].isalpha():
                t = step.lower()
                for g in (t, t[1:], t[2:]):
                    letters[g] += k
                    letters[g[:-1], ""] += k
        self.able = bool(kinds)
        self._letters, self._kinds = letters, kinds
        self.ordinary = C.Recent(lambda g: math.log(self._ordinary(g)), _CACHE)
        self.steps = C.Recent(lambda g: np.log([c.chance(g) for c in self.random]), _CACHE // 4)
        self.part = C.Recent(self._part, 20_000)

    def _found(self, step: str, k: int) -> None:
        kinds = set(step) - {" "}
        at = next((i for i, a in enumerate(ALPHABETS) if kinds <= set(a)), len(ALPHABETS))
        self.random[at].add(step, k)

    def _part(self, s: str) -> float:
        """The log-likelihood ratio: random strings, the mean over the alphabets, against ordinary ones."""
        steps = _steps(s)
        each = np.sum([self.steps[g] for g in steps], axis=0)
        best = each.max()
        return float(best + math.log(np.exp(each - best).mean())) - sum(self.ordinary[g] for g in steps)

    def _ordinary(self, g: str) -> float:
        a, b = _kind(g[1]), _kind(g[2])
        n = self._kinds
        turn = (n[a, b] + 1) / (n[a] + 5)
        if b in "lu":
            t, p, seen = g.lower(), 0.0, 0.0
            for part, share in ((t, 0.7), (t[1:], 0.15), (t[2:], 0.1)):
                if among := self._letters[part[:-1], ""]:
                    p += share * self._letters[part] / among
                    seen += share
            return turn * (0.95 * p / (seen or 1.0) + 0.05 / 26)
        return turn * (0.1 if b == "d" else 1.0)

    def score(self, s: str) -> float:
        return self.part[s] if len(s) < 100 else self._part(s)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the models add to those of the fixed patterns."""
        if not self.able:
            return []
        out = []
        for at, s in _outside(text, base):
            if s.isalpha() and (s.islower() or s.isupper()):
                continue
            found = [(m.start(), m.end(), self.score(m[0])) for m in _PARTS.finditer(s)]
            i = 0
            while i < len(found):
                total = best = 0.0
                last = i
                for k in range(i, len(found)):
                    total += found[k][2] - JOIN * (k > i)
                    if total > best:
                        best, last = total, k
                    if total <= 0 or total < best - DROP:
                        break
                start, end = found[i][0], found[last][1]
                v = s[start:end]
                kinds = any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v)
                if kinds > 1 and len(v) >= RUN and best >= LIMIT and best >= PER_CHAR * len(v):
                    out.append((at + start, 3, at + end))
                i = last + 1
        return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> list[tuple[bool, str, int]]:
    """Step counts of both models over the labelled strings of about ``rows`` texts
    (all if there are no more), each distinct string once, so that copies of one do not
    make it ordinary.  At most 2 * 66 ** 3 counts, whatever the corpus."""
    def strings(b: pa.RecordBatch):
        found = set()
        for t in b.column("text").to_pylist():
            secret, runs = samples(t)
            found |= {(True, s) for s in secret} | {(False, s) for s in (*runs, *identifiers(runs))}
        yield {"secret": [x[0] for x in found], "s": [x[1] for x in found]}

    def count(b: pa.RecordBatch):
        n: Counter = Counter()
        for secret, s in zip(b.column("secret").to_pylist(), b.column("s").to_pylist(), strict=True):
            n.update((secret, g) for g in _steps(s))
        yield {"secret": [k[0] for k in n], "step": [k[1] for k in n], "n": list(n.values())}

    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    distinct = C.map_rows(C.fit_sample(texts, "text", rows), strings, "secret boolean, s string").distinct()
    counts = C.map_rows(distinct, count, "secret boolean, step string, n long")
    return [tuple(r) for r in counts.groupBy("secret", "step").agg(F.sum("n").alias("n")).collect()]


def finder(spark, counts: list[tuple[bool, str, int]]):
    """A function of one text to its spans (fixed, then added) for use in tasks."""
    model = C.shared_model(spark, counts, Model)

    def find(text: str | None) -> tuple[list[Span], list[Span]]:
        base = base_spans(text or "")
        return base, model().spans(text or "", base)

    return find


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch of touching spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for s, _, e in sorted(spans):
        if s > end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, counts: list[tuple[bool, str, int]]) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256,
    spans``: one row per input row, repeated rows and null ids included; null is the empty
    text; without ordinary strings the models add nothing.  Spans that start at one place
    are listed in the order of ``KINDS``; very long texts, and texts of very many spans,
    take time in proportion to both.  Other columns are ignored; an empty table stays empty."""
    find = finder(docs.sparkSession, counts)

    def rows(b: pa.RecordBatch):
        got = [find(t) for t in b.column("text").to_pylist()]
        cols = {f"n_{k}": [sum(s[1] == i for x in g for s in x) for g in got] for i, k in enumerate(KINDS)}
        yield cols | {"doc_id": b.column("doc_id"),
                      "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in got],
                      "spans": [listed(base + more) for base, more in got]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows,
                      f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, counts: list[tuple[bool, str, int]]) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in ``text`` replaced; where the
    table has a whole number ``n_chars`` it follows the changed texts."""
    find = finder(docs.sparkSession, counts)
    C.bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "n_chars" or isinstance(docs.schema[c].dataType, IntegralType)]
    docs_columns, text_at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts, n = b.column(text_at).to_pylist(), b.column(docs_columns.index("n_chars")).to_pylist() if "n_chars" in names else []
            for i, t in enumerate(texts):
                spans = [s for part in find(t) for s in part] if t else []
                if spans:
                    texts[i] = redacted(t, spans)
                    if n:
                        n[i] = len(texts[i])
            new = {"text": texts} | ({"n_chars": n} if n else {})
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
