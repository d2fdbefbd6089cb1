"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles (64-bit hashes) and a
   signature of 128 minimum hashes.  Equal sets collapse to one representative
   before any search, so exact copies cost one row however many there are.
2. Representatives meet in the buckets of 32 bands of 4 signature values: a pair
   of similarity 0.75 shares no bucket with probability below 6e-6.
3. Nothing emits all pairs of a bucket.  First every member meets only the
   bucket's pivot, its most central member.  Where the links found leave a bucket in several components,
   the members outside its largest component meet the others of other
   components; buckets in which even that is much go to an exact prefix-filter
   join instead (a pair at the threshold must share one of the rarest shingles
   of each set).
4. Candidate pairs are verified in turn: after each batch of 16 signature
   values a pair leaves if the posterior probability of a similarity of at
   least the threshold (uniform prior, binomial matches) is under ``miss``.
   Survivors are confirmed on the full shingle sets.
5. The links' connected components (contraction rounds in Spark)."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

SHINGLE = 5
THRESHOLD = (75, 100)  # intersection * 100 >= union * 75
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-6
DIRECT_PAIRS = 1024  # a bucket with more pairs left than this goes to the prefix join
SLOT_BITS = 22  # the table of shingle counts that tasks hold has 4 bytes for each slot: 16 MB
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast; beyond it the join shuffles

_SEEDS = np.random.default_rng(20240229).integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
_XOR, _MUL = _SEEDS[0][:, None], (_SEEDS[1] | np.uint32(1))[:, None]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; with fewer words, one hash of
    the whole sequence; without words, empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, C.U64)
    h = C.hash_words(words)
    if len(h) < SHINGLE:
        return C.window_hashes(h, len(h)) ^ C.U64(len(h))
    return np.unique(C.window_hashes(h, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> C.U64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        x = low[None, i:i + 1024] ^ _XOR
        x *= _MUL
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(C.U64)
    acc = np.arange(1, BANDS + 1, dtype=C.U64) * C.U64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        acc = C.mix64(acc ^ rows[:, r]) * C.U64(0x9E3779B97F4A7C15)
    return acc.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to one row per document: set size, set fingerprint,
    signature and band keys (null for empty sets)."""

    def rows(b: pa.RecordBatch):
        C.held("near duplicates", dict)  # frees a model that the worker holds
        cols: dict[str, list] = {"doc_id": b.column("doc_id"), "n_shingles": [], "fp": [], "sig": [], "bands": []}
        for t in b.column("text").to_pylist():
            s = shingle_set(t)
            cols["n_shingles"].append(len(s))
            if len(s):
                sig = signature(s)
                cols["fp"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                cols["sig"].append(sig.tobytes())
                cols["bands"].append(_band_keys(sig))
            else:
                for c in ("fp", "sig", "bands"):
                    cols[c].append(None)
        yield cols

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.map_rows(src, rows, "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>")


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> list[int]:
    """For batch, 2 * batch, ... values compared: the fewest matches m at which
    P(similarity >= threshold | m of n) >= miss.  With the uniform prior the
    posterior is Beta(m + 1, n - m + 1), whose upper tail at the threshold is
    P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def bayes_prune(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures leave the threshold possible."""
    need = least_matches(THRESHOLD[0] / THRESHOLD[1], MISS)

    def rows(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
        alive, hits = np.arange(len(x)), np.zeros(len(x), np.int32)
        for i, m in enumerate(need):
            cut = slice(i * BATCH, (i + 1) * BATCH)
            hits[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1, dtype=np.int32)
            alive = alive[hits[alive] >= m]
        keep = pa.array(alive)
        yield {"a": batch.column("a").take(keep), "b": batch.column("b").take(keep)}

    side = lambda k: sigs.select(F.col("doc_id").alias(k), F.col("sig").alias("s" + k))
    return C.map_rows(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"), rows, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with an id of ``ids`` (distinct ``doc_id``)."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose full shingle sets reach the threshold."""
    pairs = C.written(pairs.select("a", "b"), "survivors")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = C.written(_only(docs, ids).dropDuplicates(["doc_id"]), "texts")  # repeated rows have one set

    def rows(batch: pa.RecordBatch):
        last, sa, out_a, out_b = None, None, [], []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
            if a != last:
                last, sa = a, shingle_set(ta)
            sb = shingle_set(tb)
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            if both * THRESHOLD[1] >= THRESHOLD[0] * (len(sa) + len(sb) - both):
                out_a.append(a)
                out_b.append(b)
        yield {"a": out_a, "b": out_b}

    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias("t" + k))
    return C.map_rows(pairs.join(side("b"), "b").join(side("a"), "a"), rows, "a long, b long")


def _fits(na: str, nb: str):
    """Set sizes that the threshold allows."""
    return F.least(na, nb) * THRESHOLD[1] >= F.greatest(na, nb) * THRESHOLD[0]


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _across(members: DataFrame, key: str, able=None) -> DataFrame:
    """Pairs of one key in different components, from the members outside the key's
    largest component (every such pair has one); ``able``: a further condition on
    the places ``ix`` and ``iy`` of the key in either."""
    at = ["at"] if able is not None else []
    sizes = members.groupBy(key, "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy(key).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    few = members.join(main, key).where("comp <> main").select(
        key, F.col("id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), *[F.col(c).alias("ix") for c in at])
    all_ = members.select(key, F.col("id").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), *[F.col(c).alias("iy") for c in at])
    meet = few.join(all_, key).where((F.col("cx") != F.col("cy")) & _fits("nx", "ny"))
    return _pairs(meet if able is None else meet.where(able))


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> C.U64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles fall into each of the 2 ** SLOT_BITS hash slots (a fixed
    size, whatever the input); 0 for slots that hold shingles of one component alone."""

    def rows(b: pa.RecordBatch):
        s = np.frombuffer(b"".join(b.column("sh").to_pylist()), C.U64)
        if not len(s):
            return
        slot, comp = _slots(s), np.repeat(b.column("comp").to_numpy(), b.column("n").to_numpy())
        order = np.argsort(slot, kind="stable")
        slot, comp = slot[order], comp[order]
        at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        yield {"slot": slot[at], "c": np.diff(np.r_[at, len(slot)]), "lo": np.minimum.reduceat(comp, at), "hi": np.maximum.reduceat(comp, at)}

    got = C.map_rows(sets.select("n", "comp", "sh"), rows, "slot long, c long, lo long, hi long").groupBy("slot").agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    got = got.select(F.col("slot").cast("int"), F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int32)
    out[got.column("slot").to_numpy()] = got.column("c").to_numpy()
    return out


def prefix_pairs(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact candidates among ``members`` (id, n, comp) of different components: sets
    of similarity >= t share one of the first n - ceil(t n) + 1 elements of each
    in any common order.  The order is by the counts of the shingles' slots, then
    by hash: frequent shingles come last, and those of one component, which link
    nothing that is not joined yet, come first and are left out of the join.  At
    their first common element, in places ix and iy, the intersection of two sets is
    at most 1 + min(nx - ix, ny - iy), which must reach the t / (1 + t) (nx + ny)
    that the threshold asks for."""

    def set_rows(b: pa.RecordBatch):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        yield {"id": b.column("id"), "n": [len(s) for s in sets], "comp": b.column("comp"), "sh": [s.tobytes() for s in sets]}

    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = _only(docs, ids).withColumnRenamed("doc_id", "id").join(members.select("id", "comp").distinct(), "id")
    texts = texts.dropDuplicates(["id"])  # repeated rows have one set
    sets = C.written(C.map_rows(texts, set_rows, "id long, n long, comp long, sh binary"), "sets")
    counts = docs.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def rows(b: pa.RecordBatch):
        got, places = [], []
        for raw in b.column("sh").to_pylist():
            s = np.frombuffer(raw, C.U64)
            often = counts.value[_slots(s)]
            order = np.lexsort((s, often))[:len(s) + 1 - -(-len(s) * THRESHOLD[0] // THRESHOLD[1])]
            at = np.flatnonzero(often[order])
            got.append(s[order[at]].view(np.int64))
            places.append(at + 1)
        many = [len(x) for x in got]
        yield {"sh": np.concatenate(got), "at": np.concatenate(places)} | {
            c: np.repeat(b.column(c).to_numpy(), many) for c in ("id", "n", "comp")}

    pre = C.written(C.map_rows(sets, rows, "sh long, id long, n long, comp long, at long"), "prefixes")
    most = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) + 1
    return _across(pre, "sh", most * sum(THRESHOLD) >= (F.col("nx") + F.col("ny")) * THRESHOLD[0])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (other columns ignored) to ``doc_id, n_shingles, component_id,
    kept, n_links``: one row per input row.

    ``n_links`` counts the confirmed links of the row's set representative that
    the search needed (links inside a component already joined are not all
    sought).  Null or wordless texts have the empty set, link with nothing and
    are kept.  Repeated rows give equal rows; rows that give one id to different
    texts are told apart by their sets.  A null doc_id takes part by its text: its
    component_id is the least known id of its group, and it is kept only if
    there is none (component_id null)."""
    return _judged(docs).drop("fp")


def _judged(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint of each row's set (null for the empty one)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = C.written(signatures(docs), "signatures")
    full = sig.where("fp is not null")
    groups = C.written(full.groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sig", "bands"), "sig").alias("s")), "groups")
    # ids that name several distinct sets, and the missing id, need other names
    odd = groups.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1 or rep is null").select("rep")
    plain = odd.isEmpty()
    if plain:
        groups = groups.withColumn("node", F.col("rep"))
    else:
        odd = C.written(odd.withColumn("odd", F.lit(True)), "odd")
        groups = groups.join(odd.withColumnRenamed("rep", "r"), F.col("rep").eqNullSafe(F.col("r")), "left").withColumn(
            "node", F.when(F.col("odd"), F.xxhash64("fp")).otherwise(F.col("rep"))).drop("r")
        groups = C.written(groups, "groups")
        docs = _renamed(docs, groups, odd)
    reps = groups.select(F.col("node").alias("doc_id"), "s.*")
    links = C.written(_links(reps, docs), "confirmed")
    comp = components(links).select(F.col("id").alias("node"), "component")
    deg = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = groups.join(comp, "node", "left").join(deg, "node", "left").select(
        "fp", "rep", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if not plain:
        named = C.written(named, "named")
        least = named.groupBy("component").agg(F.min("rep").alias("least"))
        named = named.join(least, "component").select("fp", F.col("least").alias("component"), "n_links")
    out = sig.select("doc_id", "n_shingles", "fp").join(named.select("fp", "component", "n_links"), "fp", "left")
    cid = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "fp", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, cid.isNull()).alias("kept"),
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that stand for their
    near-duplicate group.  Repeated rows count once; of one id's texts each stays by its own
    set; texts without words all stay."""
    kept_id, fp, own, bare = (f"{c}_{uuid.uuid4().hex}" for c in ("kept_id", "fp", "set", "bare"))  # beside any column of the table
    judged = C.written(_judged(docs).select(F.col("doc_id").alias(kept_id), F.col("fp").alias(fp), "kept"), "kept")
    kept = judged.where("kept")
    repeated = C.written(judged.groupBy(kept_id).agg(F.count("*").alias("c")).where("c > 1").select(kept_id), "repeated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id))
    if repeated.isEmpty():
        return docs.join(kept.select(kept_id), same, "left_semi")
    once = docs.join(repeated, same, "left_anti").join(kept.select(kept_id), same, "left_semi")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(at).to_pylist()]
            prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.binary())], names=[*b.schema.names, own])

    several = docs.join(repeated, same, "left_semi")
    several = several.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.BinaryType())]))
    several = several.join(kept.select(kept_id, fp), same & F.col(own).eqNullSafe(F.col(fp)), "left_semi")
    several = several.withColumn(bare, F.when(F.col(own).isNull(), F.col("text"))).dropDuplicates(["doc_id", own, bare])
    return once.unionByName(several.drop(own, bare))


def _renamed(docs: DataFrame, groups: DataFrame, odd: DataFrame) -> DataFrame:
    """``docs`` with the rows of odd ids under the names that ``groups`` gives their sets."""

    def rows(b: pa.RecordBatch):
        texts = b.column("text").to_pylist()
        yield {"text": texts, "fp": [hashlib.blake2b(shingle_set(t).tobytes(), digest_size=16).digest() for t in texts]}

    odd = odd.select(F.col("rep").alias("r"))
    same = F.col("doc_id").eqNullSafe(F.col("r"))
    theirs = C.map_rows(docs.join(odd, same, "left_semi").select("text"), rows, "text string, fp binary")
    theirs = theirs.join(groups.where("odd").select("fp", "node"), "fp").dropDuplicates(["fp"])
    return docs.join(odd, same, "left_anti").unionByName(C.written(theirs.select(F.col("node").alias("doc_id"), "text"), "renamed"))


def _links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    sigs = reps.select("doc_id", "sig")
    bands = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    m = C.written(bands.join(buckets, "key"), "buckets")
    # the pivot is the member that meets most others over all its buckets: the middle of its group
    meets = m.groupBy("id").agg(F.sum("size").alias("meets"))
    lead = F.struct("meets", F.xxhash64("id").alias("r"), F.col("id").alias("pid"), F.col("n").alias("pn"))
    pivots = m.join(meets, "id").groupBy("key").agg(F.max(lead).alias("p")).select("key", "p.pid", "p.pn")
    first = _pairs(m.join(pivots, "key").where(_fits("n", "pn")).select(F.col("id").alias("x"), F.col("pid").alias("y")))
    links = C.written(confirm(bayes_prune(first, sigs), docs), "links")

    comp = components(links)
    m = C.written(m.join(comp.select("id", "component"), "id", "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("comp")), "members")
    per = m.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("size"), F.max("c").alias("main"), F.count("*").alias("comps")).where("comps > 1")
    per = C.written(per.select("key", ((F.col("size") - F.col("main")) * F.col("size") <= DIRECT_PAIRS).alias("direct")), "open")
    near = _across(m.join(per.where("direct"), "key", "left_semi"), "key")
    rest = m.join(per.where("not direct"), "key", "left_semi").select("id", "n", "comp").distinct()
    if not per.where("not direct").isEmpty():
        near = near.union(prefix_pairs(C.written(rest, "rest"), docs)).distinct()
    more = confirm(bayes_prune(near, sigs), docs)
    return links.union(more).distinct()
