"""Merkle manifest of a dataset with leaf places by bitmap rank.

A row's leaf is a hash of its fields.  Its place among its group's leaves, ascending
by id, comes from bitmaps, not from sorting rows: ids are merged by ``bit_or`` into
words of 64 (only words that are not zero exist: a compressed bitmap, as long as the
ids are dense 1/64 of the rows), and a directory of popcounts above them, 512 to one,
gives the number of ids before each word.  A row looks up its word and counts the
bits below its own.  Rows of one id (or without id) follow each other by leaf; their
numbers among themselves come from a distributed ordinal.

Places then make slot arrays of 729 nodes, six levels of runs of three, keyed by
(group, place / 729): a task reduces an array at once and a level of arrays is 729
times smaller than the one below, until a group has one.  Groups' roots, ordered by
name, are reduced to the root in the same way.  Proofs go down the same arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testsieve.operators.ranking import ordinal_within

from . import common as C

RUN = 3  # nodes of a run
LEVELS = 6  # levels of a slot array: 729 slots
BITS = 9  # of a step of the directory: 512 counts to one
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """``trees``: slot arrays by level (tree, g, slots) of the groups; ``ends``: a group's root
    and the level of its last array; ``top_trees``, ``top_ends``: the same of the groups'
    roots, in one tree; ``root``: None without rows; ``levels``: of a slot array."""
    trees: list[DataFrame]
    ends: DataFrame
    top_trees: list[DataFrame]
    top_ends: DataFrame
    root: str | None
    levels: int


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf`` and ``changed``: the leaf after tampering, null where tampering
    changes nothing.  A field is ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself;
    tampering deletes the text's line ends where 2 divides crc32 of the decimal id."""
    def joined(*columns: Column) -> Column:
        parts = (F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns)
        return F.unhex(F.sha2(F.concat(*parts), 256))

    fields = [F.col(c).cast("string") for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(fields[-1], F.lit("\n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), fields[1]), F.lit("n")).alias("tree"),
                       joined(*fields).alias("leaf"), F.when(hit, joined(*fields[:-1], F.replace(fields[-1], F.lit("\n"), F.lit("")))).alias("changed"))


def directory(ids: DataFrame) -> DataFrame:
    """``tree, doc_id`` to ``tree, word, bits, n, before``: the bitmap's words that are not
    zero (``word`` = doc_id >> 6), their rows and the rows of the tree's smaller words."""
    words = ids.where(F.col("doc_id").isNotNull()).groupBy("tree", F.shiftright("doc_id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(doc_id & 63))")).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = C.written(words, "bitmap")
    low, high = words.agg(F.min("word"), F.max("word")).first()
    steps = [words.select("tree", (F.col("word") - F.lit(low or 0)).alias("at"), "n")]
    for _ in range(-(-((high or 0) - (low or 0)).bit_length() // BITS)):
        steps.append(C.written(steps[-1].groupBy("tree", F.shiftright("at", BITS).alias("at")).agg(F.sum("n").alias("n")), "counts"))
    before = steps.pop().select("tree", "at", F.lit(0).cast("long").alias("before"))  # a row for each tree
    while steps:
        # the at most 512 counts below one count meet in an array
        up = steps.pop().groupBy("tree", F.shiftright("at", BITS).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("below"))
        sums = F.aggregate("below", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<at:bigint,before:bigint>>").alias("out")),
                           lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), a["sum"].alias("before")))).alias("out")),
                           lambda a: a["out"])
        before = (up.select("tree", "up", F.explode(sums).alias("x"))
                  .join(before.withColumnsRenamed({"at": "up", "before": "base"}), ["tree", "up"])
                  .select("tree", F.col("x.at").alias("at"), (F.col("base") + F.col("x.before")).alias("before")))
    return C.written(words.withColumn("at", F.col("word") - F.lit(low or 0)).join(before, ["tree", "at"]).drop("at"), "directory")


def ranked(rows: DataFrame) -> DataFrame:
    """``leaves`` with ``place``: the row's place in its tree, ascending by (doc_id, leaf), null
    ids first.  Equal rows get places of their own."""
    spots = directory(rows.select("tree", "doc_id"))
    rows = rows.withColumn("word", F.shiftright("doc_id", 6))
    below = F.expr("bit_count(bits & ~shiftleft(-1L, int(doc_id & 63)))")
    more = spots.agg(F.sum(F.col("n") - F.bit_count("bits"))).first()[0]
    nulls = rows.where(F.col("doc_id").isNull())
    none = nulls.isEmpty()
    if not more and none:
        return rows.join(spots, ["tree", "word"]).withColumn("place", F.col("before") + below).drop("word", "bits", "n", "before")
    # ids of several rows, and how many more there are below a bit of their word
    often = C.written(rows.join(spots.where("n > bit_count(bits)").select("tree", "word"), ["tree", "word"], "left_semi")
                      .groupBy("tree", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")
    extra = often.groupBy("tree", F.shiftright("doc_id", 6).alias("word")).agg(F.collect_list(F.struct("doc_id", (F.col("copies") - 1).alias("more"))).alias("extra"))
    same = rows.join(often.select("tree", "doc_id"), ["tree", "doc_id"], "left_semi").unionByName(nulls)
    tie = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tree")
    same = ordinal_within(same.withColumn("tie", tie), "tie", ["leaf"], out="nth", few_classes=False).drop("tie", "nth_n")
    single = rows.where(F.col("doc_id").isNotNull()).join(often.select("tree", "doc_id"), ["tree", "doc_id"], "left_anti")
    found = single.withColumn("nth", F.lit(0).cast("long")).unionByName(same).join(spots.join(extra, ["tree", "word"], "left"), ["tree", "word"], "left")
    over = F.expr("aggregate(filter(coalesce(extra, array()), x -> x.doc_id < doc_id), 0L, (a, x) -> a + x.more)")
    first = nulls.groupBy("tree").agg(F.count(F.lit(1)).alias("nulls"))
    place = F.col("nth") + F.when(F.col("doc_id").isNotNull(), F.coalesce("nulls", F.lit(0)) + F.col("before") + below + over).otherwise(0)
    return found.join(first, "tree", "left").withColumn("place", place).select("doc_id", "tree", "leaf", "changed", "place")


def _node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _levels(nodes: list[str], alone: bool, levels: int) -> list[list[str]]:
    """The nodes of a slot array and those above: of one that is alone in its tree's level up to
    one node, else of all ``levels``."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        out.append([_node(out[-1][i:i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[int, list[str], pa.StructArray]]:
    """(row, node hashes, items) of each slot array of a batch."""
    slots = b.column("slots")
    flat, at = slots.flatten(), slots.offsets.to_pylist()
    first = at[0]
    for k in range(len(slots)):
        part = flat.slice(at[k] - first, at[k + 1] - at[k])
        yield k, [h.hex() for h in part.field("hash").to_pylist()], part.field("item")


def _tops(b: pa.RecordBatch, levels: int):
    both = [(_levels(nodes, False, levels)[-1][0], _levels(nodes, True, levels)[-1][0] if g == 0 else None)
            for (_, nodes, _), g in zip(_arrays(b), b.column("g").to_pylist(), strict=True)]
    yield {"tree": b.column("tree"), "g": b.column("g"), "hash": [bytes.fromhex(x[0]) for x in both], "root": [x[1] for x in both]}


def grown(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """``tree, place, hash, item`` to the slot arrays of every level and ``tree, level, root``."""
    trees, ends, size = [], [], RUN**levels
    while True:
        slot = F.struct((F.col("place") % size).alias("slot"), "hash", "item")
        trees.append(C.written(nodes.groupBy("tree", F.expr(f"place div {size}").alias("g")).agg(F.array_sort(F.collect_list(slot)).alias("slots")), "slots"))
        tops = C.written(C.map_rows(trees[-1], lambda b: _tops(b, levels), "tree string, g long, hash binary, root string"), "tops")
        several = tops.where("g = 1").select("tree")
        ends.append(tops.where("g = 0").join(several, "tree", "left_anti").select("tree", F.lit(len(trees) - 1).alias("level"), "root"))
        if several.isEmpty():
            return trees, C.written(reduce(DataFrame.unionByName, ends), "roots")
        nodes = tops.join(several, "tree", "left_semi").select("tree", F.col("g").alias("place"), "hash", F.lit(None).cast("struct<none:int>").alias("item"))


def build(docs: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of ``doc_id, source, lang, n_chars, text``, a tree for each source.

    Null fields, empty and long texts, repeated ids and equal rows are leaves as any other;
    null ids come first, rows of one id go by leaf; other columns are ignored."""
    rows = C.written(leaves(docs), "leaves")
    trees, ends = grown(ranked(rows).select("tree", "place", F.col("leaf").alias("hash"), F.struct("doc_id", "changed").alias("item")), levels)
    named = ordinal_within(ends.select("tree", "root", F.lit(0).alias("all")), "all", ["tree"], out="place")
    top_trees, top_ends = grown(named.select(F.lit("").alias("tree"), "place", F.unhex("root").alias("hash"), F.struct(F.col("tree").alias("name")).alias("item")), levels)
    root = top_ends.first()
    return Manifest(trees, ends, top_trees, top_ends, root and root["root"], levels)


class Path(NamedTuple):
    """The way from a node to the root: (left, right) siblings of each level."""
    steps: tuple[tuple[str, str], ...]
    proof: str

    def fold(self, node: str) -> str:
        for left, right in self.steps:
            node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
        return node

    def packed(self) -> list[dict]:
        return [{"l": a, "r": b} for a, b in self.steps]


def _paths(nodes: list[str], outer: list[dict], alone: bool, levels: int) -> list[Path]:
    """The paths of the nodes of a slot array whose own path is ``outer``."""
    above = _levels(nodes, alone, levels)
    steps = tuple((x["l"], x["r"]) for x in outer)
    paths = [Path(steps, "".join(a + b for a, b in steps))]
    for level in reversed(above[:-1]):
        down = []
        for i in range(len(level)):
            k = i - i % RUN
            step, up = ("".join(level[k:i]), "".join(level[i + 1:k + RUN])), paths[i // RUN]
            down.append(Path((step, *up.steps), step[0] + step[1] + up.proof))
        paths = down
    return paths


STEPS = "array<struct<l:string,r:string>>"


def _descended(trees: list[DataFrame], ends: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The lowest slot arrays with the paths of the arrays: ``outer`` holds ``tree, path, root``."""
    start, size = ends.select("tree", "level").join(outer, "tree"), RUN**levels

    def children(b: pa.RecordBatch):
        for (k, nodes, _), g, outer_, alone in zip(_arrays(b), b.column("g").to_pylist(), b.column("path").to_pylist(), b.column("alone").to_pylist(), strict=True):
            n = len(nodes)
            yield {"tree": [b.column("tree")[k].as_py()] * n, "g": range(g * size, g * size + n), "path": [p.packed() for p in _paths(nodes, outer_, alone, levels)],
                   "root": [b.column("root")[k].as_py()] * n, "alone": [False] * n}

    paths = None
    for level in range(len(trees) - 1, -1, -1):
        last = start.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("g"), "path", "root", F.lit(True).alias("alone"))
        paths = last if paths is None else paths.unionByName(last)
        met = trees[level].join(paths, ["tree", "g"])
        if level:
            paths = C.written(C.map_rows(met, children, f"tree string, g long, path {STEPS}, root string, alone boolean"), "paths")
    return met


def proofs(m: Manifest) -> DataFrame:
    """A row for each leaf: ``doc_id, leaf, subroot, root, proof_sha256`` (of the siblings, left to
    right, level by level), and ``folded_root, verified``: the root recomputed from the
    tampered leaf (or the leaf, where tampering changes nothing) and the siblings."""
    root, levels = m.root, m.levels
    whole = m.top_ends.select("tree", F.array().cast(STEPS).alias("path"), "root")

    def names(b: pa.RecordBatch):
        for (_, nodes, items), outer, alone in zip(_arrays(b), b.column("path").to_pylist(), b.column("alone").to_pylist(), strict=True):
            yield {"tree": items.field("name"), "path": [p.packed() for p in _paths(nodes, outer, alone, levels)], "root": nodes}

    def rows(b: pa.RecordBatch):
        for (k, nodes, items), outer, alone in zip(_arrays(b), b.column("path").to_pylist(), b.column("alone").to_pylist(), strict=True):
            paths, n = _paths(nodes, outer, alone, levels), len(nodes)
            folded = [p.fold(x if c is None else c.hex()) for p, x, c in zip(paths, nodes, items.field("changed").to_pylist(), strict=True)]
            yield {"doc_id": items.field("doc_id"), "leaf": nodes, "subroot": [b.column("root")[k].as_py()] * n, "root": [root] * n,
                   "proof_sha256": [hashlib.sha256(p.proof.encode()).hexdigest() for p in paths], "folded_root": folded, "verified": [f == root for f in folded]}

    subroots = C.written(C.map_rows(_descended(m.top_trees, m.top_ends, whole, levels), names, f"tree string, path {STEPS}, root string"), "subroots")
    return C.map_rows(_descended(m.trees, m.ends, subroots, levels), rows,
                      "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
