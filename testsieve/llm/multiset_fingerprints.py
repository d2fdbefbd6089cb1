"""Homomorphic multiset fingerprints of documents, by DataFrame functions alone.

A paragraph is a line, or in it a stretch that ends after a sentence mark.  It is
hashed, by ten 64-bit functions, to 20 words of three 8-bit values, one for every 20 bits; a document's
fingerprint is the number of its paragraphs and the sum of their words modulo
2 ** 60.  Order does not matter, and adding or subtracting a paragraph's words
inserts or deletes it.  Read as 60 lanes modulo 2 ** 20 and centred, the sums of
two documents are random projections of their paragraph counts, so
2 <x, y> / (<x, x> + <y, y>) estimates the share of paragraphs in common."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES = 10  # 64-bit hashes of a paragraph, two words each
LANES = 3
_MASK = sum(0xFF << 20 * j for j in range(LANES))
_MODULUS = (1 << 60) - 1
RANGE_ROWS, RANGES = 2_000, 100_000  # rows of a range of ids; most ranges (their bounds: 0.8 MB)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?]) "), lambda p: p != "")



def fingerprint(text: Column) -> Column:
    """``struct(n, words)`` of a text; null is the empty text, with no paragraph.  The number
    comes first in the hash: it seeds the paragraph's, so that two paragraphs which
    collide under one of the functions do not under the others."""
    hashed = F.transform(_paragraphs(text), lambda p: F.array(*[F.xxhash64(F.lit(i), p) for i in range(HASHES)]))
    zero = F.array_repeat(F.lit(0).cast("long"), 2 * HASHES)
    words = F.aggregate(hashed, zero, lambda total, h: F.transform(total, lambda a, k: (
        a + F.call_function("shiftright", F.get(h, F.call_function("shiftright", k, F.lit(1))), k.bitwiseAND(F.lit(1)) * 8)
        .bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MODULUS))))
    return F.struct(F.size(hashed).cast("long").alias("n"), words.alias("words"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    words = F.zip_with(a["words"], b["words"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MODULUS)))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), words.alias("words"))


def inserted(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combined(a, b, 1)


def deleted(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b`` (which it holds)."""
    return _combined(a, b, -1)


def shown(fp: Column) -> Column:
    """The fingerprint as text: hexadecimal number of paragraphs and words."""
    return F.concat(F.hex(fp["n"]), F.lit(":"), F.array_join(F.transform(fp["words"], lambda w: F.lpad(F.hex(w), 15, "0")), ""))


def _lanes(fp: Column) -> Column:
    """Twice the centred lanes: 2 * lane - 255 n, modulo 2 ** 21, between -2 ** 20 and 2 ** 20."""
    half = 1 << 20
    lane = lambda w, j: F.shiftright(w, 20 * j).bitwiseAND(F.lit(half - 1))
    centre = lambda v: (F.pmod(2 * v - 255 * fp["n"] + half, F.lit(2 * half)) - half).cast("double")
    return F.flatten(F.transform(fp["words"], lambda w: F.array(*[centre(lane(w, j)) for j in range(LANES)])))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def likeness(x: Column, y: Column) -> Column:
    """Estimated share of paragraphs in common of two lane arrays, 0 to 1 (two empty ones: 1)."""
    both = _dot(x, x) + _dot(y, y)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(x, y) / both)))


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, int], int]:
    """Bounds that cut the ids into ranges of about ``RANGE_ROWS`` rows, at most ``RANGES`` of
    them; how many such ranges an id alone fills; how many the null ids fill."""
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    k = min(RANGES, known // RANGE_ROWS)
    size = max(RANGE_ROWS, known // max(1, k))
    nulls = min((n - known) // size, (1 << 20) - 1)
    if k < 1:
        return [], {}, nulls
    at = F.percentile_approx("doc_id", [i / (k + 1) for i in range(1, k + 1)], 10 * k + 1000)
    found = Counter(docs.agg(at.alias("at")).first()["at"])
    return sorted(found), {i: m + 1 for i, m in found.items() if m > 1}, nulls


def _array(values: list[int]) -> Column:
    """A constant array of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(values: list[int], x: Column) -> Column:
    """How many of the ascending ``values`` are less than ``x``, by bisection."""
    if not values:
        return F.lit(0)
    held, steps = _array(values), [1 << i for i in range(len(values).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda t, s: t + F.when(
        (t + s <= len(values)) & (F.get(held, F.least(t + s, F.lit(len(values))) - 1) < x), s).otherwise(0))


def _place(docs: DataFrame) -> Column:
    """A number of a row's range, ascending by (doc_id, digest), null ids first; an id of many
    rows is cut by the digest."""
    bounds, hot, nulls = _ranges(docs)
    share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / (1 << 32)
    ids = sorted(hot)
    at = _below(ids, F.col("doc_id"))
    parts = F.when(F.get(_array(ids), at) == F.col("doc_id"), F.get(_array([hot[i] for i in ids]), at)).otherwise(1) if ids else F.lit(1)
    number = lambda place, parts: place.cast("long") * (1 << 20) + F.floor(share * parts)
    # an id's own range, after those of the smaller ids in its range of ids
    place = 2 * _below(bounds, F.col("doc_id")) + (F.when(parts > 1, 1).otherwise(0) if ids else 0)
    return F.when(F.col("doc_id").isNull(), number(F.lit(-1), F.lit(max(1, nulls)))).otherwise(number(place, parts))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fp`` of all rows, with ``next_text`` and ``next_fp`` of the next row in
    descending order of doc_id (of the last: of the first).

    Rows meet by ranges of ids, one shuffle for all; a range's last row finds its
    neighbour in a copy of the first row of the range below.  Null ids come last;
    rows with one id are ordered by the hash of their texts, and spread by it if there
    are many; only equal rows (of one id and text) always share a range."""
    keyed = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    keyed = keyed.withColumn("place", _place(docs))
    first = keyed.groupBy("place").agg(F.max(F.struct("doc_id", "digest")).alias("first"))
    order = Window.orderBy("place")  # a row for each range
    first = first.select(
        "first", F.coalesce(F.lead("place").over(order), F.min("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above"))
    # null-safe comparison of the two fields; one row for each range, at most RANGES + 2
    head = F.broadcast(first.select(F.col("first.doc_id").alias("h_id"), F.col("first.digest").alias("h_digest"), "above"))
    heads = keyed.join(head, keyed["doc_id"].eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest"))).select(
        "doc_id", "text", "digest", F.col("above").alias("place"), F.lit(1).alias("copy"))
    rows = keyed.select("doc_id", "text", "digest", "place", F.lit(0).alias("copy")).unionByName(heads)
    rows = rows.withColumn("fp", fingerprint(F.col("text")))
    down = Window.partitionBy("place").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("digest"))
    return rows.select("doc_id", "text", "fp", "copy", F.lead("text").over(down).alias("next_text"),
                       F.lead("fp").over(down).alias("next_fp")).where("copy = 0").drop("copy")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``: one row per input row.

    The edited text has the last half of the text's code points replaced by as many
    of the next document's (or all it has).  Null texts are empty; the next document
    of a table's only row is that row; rows of one id follow each other by a hash of
    their texts; a very long text is one row's work and is held a few times over; other
    columns are ignored; an empty table stays empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp",
                       fingerprint(F.col("edited")).alias("edited_fp"))
    lanes = rows.withColumns({"x": _lanes(F.col("fp")), "e": _lanes(F.col("edited_fp")), "y": _lanes(F.col("next_fp"))})
    return lanes.select("doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"),
                        shown(F.col("edited_fp")).alias("edited_fingerprint"),
                        likeness(F.col("x"), F.col("e")).alias("near_edited"), likeness(F.col("x"), F.col("y")).alias("near_next"))
