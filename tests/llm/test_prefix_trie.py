"""The prefix trie against brute force: shared prefixes, equal conversations over many
ranges, nulls, repeated turn numbers, further columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from testsieve.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, seq string, base long"


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in cs if len(made[c]) == len(p))
        out[min(cs), len(p)] = (
            min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(z) == len(q) + 1 and z[:len(q)] == q for z in below) for q in below),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def result(spark, rows):
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversation(c, texts, null=False):
    return [(c, None if null and k == 0 else k, "user" if k % 2 == 0 else "assistant", t, "k", 7, "s", 3) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 200), 120):
        rows += conversation(c, [rng.choice(["one", "two words", "a b\tc", "", None, "\x1cx y"]) for _ in range(rng.randint(1, 7))], rng.random() < 0.2)
    rows += [(5, 0, "user", "one", None, None, None, None), (5, 0, "user", "one", None, None, None, None), (6, None, None, None, None, None, None, None)]
    assert result(spark, rows + [(None, 0, "user", "of no conversation", "k", 1, "s", 1)]) == brute(rows)


def test_one_conversation_a_third_of_all(spark):
    rng = random.Random(9)
    rows = []
    for c in range(150):
        hot = c % 3 == 0
        rows += conversation(c, ["hello"] * 5 if hot else ["hello", *(rng.choice("xyz") for _ in range(rng.randint(0, 5)))])
    rows += conversation(700, ["long"] * 300)
    assert result(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert result(spark, conversation(3, ["a"])) == brute(conversation(3, ["a"]))
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    seqs = spark.createDataFrame([(1, b"", []), (2, b"", [])], "conv_id long, seq binary, words array<long>")  # turnless
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in T.trie(seqs).collect()] == [(1, 0, None, 2, 0, 1, 0)]


def test_extents_are_those_of_a_scan():
    rng = random.Random(4)
    seqs = sorted(b"".join(rng.choice([b"a" * 16, b"b" * 16]) for _ in range(rng.randint(0, 5))) for _ in range(70))
    r = T.Range(np.array(rng.sample(range(1000), 70)), seqs, np.zeros(sum(map(len, seqs)) // 16, np.int64))
    for i, s in enumerate(seqs):
        for d in range(len(s) // 16 + 1):
            own = [k for k, x in enumerate(seqs) if x[:16 * d] == s[:16 * d]]
            at, depth = np.array([i]), np.array([d])
            assert (r.left(at, depth)[0], r.right(at, depth)[0]) == (own[0], own[-1])
            assert r.smallest(np.array([own[0]]), np.array([own[-1]]))[0] == r.conv[own].min()


def test_pieces_of_ids_in_order(monkeypatch):
    monkeypatch.setattr(T, "IDS", 3)
    r = T.Range(np.arange(20, 30), [b"a" * 16] * 10, np.ones(10, np.int64))
    pieces = [x for cols in r.rows(0) if len(cols["kind"]) and cols["kind"][0] == 2 for x in zip(cols["no"], cols["ids"], strict=True)]
    assert [n for n, _ in pieces] == [0, 1, 2, 3] and ",".join(x for _, x in pieces) == ",".join(map(str, range(20, 30)))


def test_nodes_with_their_last_turns(spark):
    rng = random.Random(6)
    rows = []
    for c in rng.sample(range(-40, 100), 60):
        rows += conversation(c, [rng.choice(["one", "two words", "", None, "x y"]) for _ in range(rng.randint(1, 6))], rng.random() < 0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = T.with_turns(T.prefix_trie(df), df).collect()
    seen = {(r.conv_id, r.depth): (r.role, r.text) for r in got}
    assert set(seen) == set(brute(rows)) and len(got) == len(seen)
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        own[c].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    for (c, d), last in seen.items():
        h = zlib.crc32(str(c).encode()) % 4
        made = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
        assert last == (made[d - 1] if d else (None, None))
