"""The Merkle manifest against a plain version: nulls, repeated ids, equal rows, one and many
sources, further columns, several levels of slot arrays, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from testsieve.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, word long, hash string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def reduced(nodes):
    """All levels of a list of nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        k = i - i % 3
        steps.append((level[k:i], level[i + 1:k + 3]))
        i //= 3
    return steps


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    trees = {s: reduced([leaf(r) for r in sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s, g in groups.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = reduced([trees[s][-1][0] for s in names])
    out = []
    for s, g in groups.items():
        for i, r in enumerate(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = path(trees[s], i) + path(top, names.index(s))
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf([*r[:4], r[4].replace("\n", "")]) if tampered else leaf(r)
            for a, b in steps:
                node = h(*a, node, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), node, node == top[-1][0]))
    return Counter(out)


def result(spark, rows, levels=M.LEVELS):
    got = M.proofs(M.build(spark.createDataFrame([(*r, "t", 1, 2, "x") for r in rows], SCHEMA).repartition(4), levels))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def some(rng, i, source):
    return (i, source, rng.choice(["en", None, "dé"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "ünï\n\n", f"text {i}"]))


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    ids = [*rng.sample(range(-300, 900), 700), *(rng.getrandbits(63) - 2**62 for _ in range(60)), 2**63 - 1, -2**63, 63, 64, -64, -65]
    rows = [some(rng, i, rng.choice(["a", "a", "a", "é", "zz", None, ""])) for i in set(ids)]
    assert result(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    rows = [some(rng, rng.choice([None, 5, 5, 5, 7, 70, 71, rng.randint(0, 90)]), rng.choice(["a", None])) for _ in range(300)]
    rows += [(5, "a", "en", 1, "same\n")] * 100 + [(None, "only null", None, None, None)] * 4
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 729, 730, 2500])
def test_sizes(spark, n):
    rows = [(i, "one", "en", 1, f"t{i}\n") for i in range(n)]
    assert result(spark, rows) == brute(rows)


def test_many_levels_and_sources(spark):
    rng = random.Random(5)
    rows = [some(rng, i, rng.choice(["hot", f"s{i % 40}"])) for i in range(700)]
    assert result(spark, rows, levels=2) == brute(rows)


def test_no_rows(spark):
    m = M.build(spark.createDataFrame([], SCHEMA))
    assert m.root is None and M.proofs(m).count() == 0
