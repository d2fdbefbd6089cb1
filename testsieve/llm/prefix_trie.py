"""Prefix trie of conversations by range minima over sorted common-prefix lengths.

A turn is 16 bytes of a hash of role and text, a conversation the row of its turns'
hashes.  Conversations are sorted by (turns, conv_id) over ranges, so the members of a
prefix are neighbours, and equal conversations, however many, spread over tasks.  A
task reads one range and holds a sparse table of minima over the common-prefix
lengths of neighbours.  Each prefix that is new at a conversation finds the left and
right end of its members by binary search over that table, all prefixes
independently and without a stack; sums over subtrees are differences of one running
sum, since the prefixes of a subtree follow each other.

Prefixes of a range's first or last conversation can go on in the neighbouring
ranges.  They are as many as these two conversations have turns; they are merged by
a hash of the prefix, together with their share of children, leaves and saved tokens.
Ids of conversations that end in them are joined into pieces where they lie and
hashed in order, one piece after another.  Everything else is complete in its task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
TURNS = 500_000  # turns of a range, about
IDS = 400  # ids of a piece
ROWS = 20_000  # prefixes of an output batch
SALTS = 64
EMPTY = hashlib.sha256(b"").hexdigest()
# kind 0: a prefix of this range alone; 1: a share of one that may go on; 2: ids that end in such a one
SCHEMA = ("kind int, task int, no long, key binary, parent_key binary, ids string, conv_id long, depth long, parent_conv_id long, "
          "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, first boolean, last boolean")


def _role_and_text() -> tuple:
    return tuple(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))


def _digest(role, text):
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows to ``conv_id, turns``: an array of (turn, digest in
    hex, words) by turn, null first; equal turn numbers go by the digest.

    Null role or text is empty.  Rows without conv_id belong to no conversation and are
    left out; other columns are ignored."""
    role, text = _role_and_text()
    turn = F.struct(F.col("turn").alias("turn"), _digest(role, text).alias("digest"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """``conv_id, seq, words`` of each conversation c, rebuilt: the first h turns of
    conversation c - c % ``every`` (fewer if it has fewer, none if it is absent), then c's
    own after its first h; h = crc32(c in decimal) % (``most`` + 1).  ``seq`` holds 16 bytes
    a turn, ``words`` the number of words of each."""
    own = C.written(turns_of(conversations), "turns")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    return (own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
            .withColumn("t", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))))
            .select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("seq"),
                    F.transform("t", lambda x: x["words"]).alias("words")))


def with_turns(nodes: DataFrame, conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """``nodes`` of the rebuilt conversations with ``role`` and ``text`` of their last turn (null
    for the root), which is a turn of the node's own conversation or of the one that it
    was rebuilt from."""
    role, text = _role_and_text()
    numbered = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("of"), role.alias("role"), text.alias("text"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), _digest(role, text))).alias("nth"))
    sizes = conversations.groupBy(F.col("conv_id").cast("long").alias("base")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("size"))
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    given = F.least(h, F.coalesce("size", F.lit(0)))
    placed = (nodes.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(sizes, "base", "left").withColumn("given", given)
              .withColumn("of", F.when(F.col("depth") <= F.col("given"), F.col("base")).otherwise(F.col("conv_id")))
              .withColumn("nth", F.when(F.col("depth") <= F.col("given"), F.col("depth")).otherwise(F.col("depth") - F.col("given") + h)))
    return placed.join(numbered, (placed["of"] == numbered["of"]) & (placed["nth"] == numbered["nth"]) & (F.col("depth") > 0), "left").select(
        *nodes.columns, "role", "text")


class Range:
    """Sorted conversations of one range and the prefixes that are new at each."""

    def __init__(self, conv: np.ndarray, seqs: list[bytes], words: np.ndarray):
        self.conv, self.seqs, self.words = conv, seqs, words
        n = self.n = len(conv)
        self.size = np.fromiter(map(len, seqs), np.int64, n) // 16
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.common = self._common()
        self.minima = [self.common]  # minima[j][i]: over i .. i + 2**j - 1
        while 2 << (len(self.minima) - 1) <= n:
            m, step = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(m[:-step], m[step:]))
        new = self.size - self.common
        self.start = np.concatenate([[0], np.cumsum(new)])  # of the prefixes of a conversation, among all
        self.here = np.repeat(np.arange(n), new)
        self.depth = np.arange(self.start[-1]) - np.repeat(self.start[:-1] - self.common - 1, new)

    def _common(self) -> np.ndarray:
        """Turns that a conversation shares with the one before; -1 for the first."""
        pair = np.frombuffer(b"".join(self.seqs), "<u8").reshape(-1, 2)
        out = np.zeros(self.n, np.int64)
        out[:1] = -1
        least = np.minimum(self.size[:-1], self.size[1:])
        left, k = np.flatnonzero(least > 0), 0
        while len(left):
            left = left[(pair[self.at[left] + k] == pair[self.at[left + 1] + k]).all(axis=1)]
            k += 1
            out[left + 1] = k
            left = left[least[left] > k]
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last conversation that shares its first ``depth`` turns with that at ``at``."""
        r = at.copy()
        for j in range(len(self.minima) - 1, -1, -1):
            m, step = self.minima[j], 1 << j
            go = np.flatnonzero(r + step < self.n)
            go = go[m[r[go] + 1] >= depth[go]]
            r[go] += step
        return r

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first such conversation."""
        x = at.copy()
        for j in range(len(self.minima) - 1, -1, -1):
            m, step = self.minima[j], 1 << j
            go = np.flatnonzero(x - step >= 0)
            go = go[m[x[go] - step + 1] >= depth[go]]
            x[go] -= step
        return x

    def smallest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest conv_id of ``a .. b``."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out, m, j = np.empty(len(a), np.int64), self.conv, 0
        while True:
            now = np.flatnonzero(level == j)
            out[now] = np.minimum(m[a[now]], m[b[now] - (1 << j) + 1])
            if len(m) <= 1 << j:
                return out
            m, j = np.minimum(m[:-(1 << j)], m[1 << j:]), j + 1

    def rows(self, task: int) -> Iterator[dict[str, list]]:
        n, here, depth, start = self.n, self.here, self.depth, self.start
        first = self.left(here, depth)  # a prefix is new at its first member
        last = self.right(here, depth)
        members = last - first + 1
        conv = self.smallest(first, last)
        up = np.maximum(depth - 1, 0)
        above = self.left(here, up)
        parent = start[above] + up - self.common[above] - 1
        kids = depth > 0
        edge = (first == 0) | (last == n - 1)
        # children that may go on in other ranges are counted once all are merged
        children = np.bincount(parent[kids & ~edge], minlength=len(here))
        words = np.where(kids, np.append(self.words, 0)[self.at[here] + up], 0)
        weight = np.where(edge, 0, (members - 1) * words)
        leaf = ~edge & (children == 0)
        to = start[last + 1]
        total = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[to] - s[:-1]
        saved, leaves = total(weight), total(leaf)

        same = np.zeros(n + 1, bool)
        same[1:n] = (self.common[1:] == self.size[1:]) & (self.size[1:] == self.size[:-1])
        runs = np.flatnonzero(~same)  # where another sequence begins, and n
        ends = dict(zip((start[runs[:-1] + 1] - 1).tolist(), zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True), strict=True))

        own = np.flatnonzero(~edge)
        keys = self._keys(np.flatnonzero(edge).tolist(), here, depth)
        outer = edge[parent]
        for i in range(0, len(own), ROWS):
            some = own[i:i + ROWS]
            out = {"conv_id": conv[some], "depth": depth[some], "n_convs": members[some], "n_children": children[some], "n_leaves": leaves[some],
                   "saved_tokens": saved[some]}
            out["parent_conv_id"] = pa.array(conv[parent[some]], pa.int64(), mask=outer[some])
            out["parent_key"] = [keys[p] if e else None for p, e in zip(parent[some].tolist(), outer[some].tolist(), strict=True)]
            out["ends_sha256"] = [hashlib.sha256(",".join(map(str, self.conv[slice(*ends[p])].tolist())).encode()).hexdigest() if p in ends else EMPTY
                                  for p in some.tolist()]
            yield out | {"kind": np.zeros(len(some), np.int32), "task": np.full(len(some), task, np.int32)}
        shares = sorted(keys)
        some = np.array(shares)
        yield {"kind": np.ones(len(some), np.int32), "task": np.full(len(some), task, np.int32), "key": [keys[p] for p in shares],
               "parent_key": [keys[q] if d else None for q, d in zip(parent[some].tolist(), depth[some].tolist(), strict=True)],
               "conv_id": conv[some], "depth": depth[some], "n_convs": members[some], "n_children": children[some], "n_leaves": leaves[some],
               "saved_tokens": saved[some], "words": words[some], "first": first[some] == 0, "last": last[some] == n - 1}
        for p in shares:
            a, b = ends.get(p, (0, 0))
            pieces = [",".join(map(str, self.conv[i:min(i + IDS, b)].tolist())) for i in range(a, b, IDS)]
            for i in range(0, len(pieces), 1000):
                k = len(pieces[i:i + 1000])
                yield {"kind": np.full(k, 2, np.int32), "task": np.full(k, task, np.int32), "no": np.arange(i, i + k), "key": [keys[p]] * k, "ids": pieces[i:i + k]}

    def _keys(self, prefixes: list[int], here: np.ndarray, depth: np.ndarray) -> dict[int, bytes]:
        """16 bytes for each of the prefixes (all those of the first or of the last conversation)."""
        out, state, of, done = {}, hashlib.sha256(), -1, 0
        for p in prefixes:
            i, d = int(here[p]), int(depth[p])
            if i != of or d < done:  # what a new prefix goes on from is hashed anew
                state, of, done = hashlib.sha256(), i, 0
            state.update(self.seqs[i][16 * done:16 * d])
            done = d
            out[p] = state.copy().digest()[:16]
        return out


def _ranges(seqs: DataFrame) -> DataFrame:
    """The prefixes of every range (``SCHEMA``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found, words = [], [], []
        for b in batches:
            conv.append(b.column("conv_id").to_numpy())
            found += b.column("seq").to_pylist()
            words.append(b.column("words").flatten().to_numpy())
        if found:
            for cols in Range(np.concatenate(conv), found, np.concatenate(words)).rows(TaskContext.get().partitionId()):
                k = len(cols["kind"])
                yield pa.RecordBatch.from_arrays([x if isinstance(x := cols.get(f.name), pa.Array) else pa.nulls(k, f.type) if x is None else pa.array(x, f.type)
                                                  for f in out], schema=out)

    spark = seqs.sparkSession
    turns = seqs.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    return C.written(seqs.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(run, SCHEMA), "ranges")


def _hashed(pieces: DataFrame) -> DataFrame:
    """``key, task, no, ids`` to ``key, ends_sha256``: the pieces of a key in order, joined by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done: list[tuple] = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return pieces.select("key", "task", "no", "ids").repartition("key").sortWithinPartitions("key", "task", "no").mapInArrow(run, "key binary, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """``conv_id, seq, words`` (one row a conversation, 16 bytes of ``seq`` and one number of
    ``words`` a turn) to the nodes of their prefix trie: ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns, the root (depth 0) included; conversations
    without turns end in the root; equal conversations share all nodes.  Without
    conversations there is no node.  A conversation's hashes (16 bytes a turn) must fit
    in a task."""
    seqs = C.written(seqs, "sequences")
    parts = _ranges(seqs)
    share = parts.where("kind = 1")
    place = F.explode(F.filter(F.array(F.when(F.col("first"), 0), F.when(F.col("last"), 1)), lambda x: x.isNotNull()))
    # an edge's own weight counts once, in the first of the conversations (of a range's first and last) that it is a prefix of
    lines = share.select("key", "task", "depth", place.alias("line"))
    merged = share.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.min(F.struct("task", F.when(F.col("first"), 0).otherwise(1).alias("line"))).alias("owner"))
    more = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    merged = C.written(merged.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "edges")

    mine = F.col("owner") == F.struct("task", "line")
    below = Window.partitionBy("task", "line").orderBy(F.desc("depth"))  # the prefixes of one conversation
    sums = (lines.join(merged.select("key", "owner", "words", "n_convs", "n_children"), "key")
            .select("key", F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(below).alias("saved"),
                    F.sum(F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(below).alias("leaves"))
            .groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edges = (merged.join(sums, "key").join(parents, "parent_key", "left").join(_hashed(parts.where("kind = 2")), "key", "left")
             .withColumns({"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved"),
                           "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))}))
    # prefixes whose parent is an edge: many may have the same one
    hung = (parts.where("kind = 0 and parent_key is not null").drop("parent_conv_id")
            .withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)))
            .join(parents.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["parent_key", "salt"]))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (parts.where("kind = 0 and parent_key is null").select(columns).unionByName(hung.select(columns)).unionByName(edges.select(columns)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``turns_of``, ``rebuilt`` and ``trie``."""
    return trie(rebuilt(conversations))
