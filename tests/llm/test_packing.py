"""Packing: every id in one piece, gapless sequences, padding, and the awkward tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from testsieve.llm import packing as K

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, task string, ids string"


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [1]


def whole(rows, texts, length):
    """The rules of the result, checked against the library; returns the padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for i, text in texts.items():
        ids, at = np.array(library_ids(text), "<u4"), 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    pad = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    return pad


@pytest.mark.parametrize("parts, fan", [(1, 64), (7, 64), (9, 2)])
def test_every_id_lies_in_one_piece(spark, parts, fan):
    rng = random.Random(parts)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma's", "Δelta", "42"]) for _ in range(rng.choice([0, 1, 5, 40, 700]))) for i in range(150)}
    texts |= {900: None, 901: "", 902: "word " * 5000}
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts.items()], SCHEMA).repartition(parts)
    rows = K.pack(docs, WORDS, length=256, windows=4, fan=fan).collect()
    assert whole(rows, texts, 256) == 0
    short = [k for k, n in _sizes(rows).items() if n < 256]
    assert len(short) <= 8  # the last window alone, in powers of two


def _sizes(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.sequence_id] += r.length
    return out


def test_odd_tables(spark):
    assert K.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    rows = [(None, "a b", 1, "x", "y"), (5, "a b", 1, "x", "y"), (5, "a b", 1, "x", "y"), (5, None, None, None, None)]
    got = K.pack(spark.createDataFrame(rows, SCHEMA), WORDS, with_ids=True)
    assert sum(r.length for r in got.collect()) == 3 * 3 + 1
    assert {r.doc_id for r in got.collect()} == {None, 5}
    built = K.sequences(got).collect()
    assert sorted(x for r in built for x in r.ids) == sorted(3 * library_ids("a b") + [1])


def test_best_fit_and_the_fullest_goes():
    p = K.Packer(0, length=10, windows=2)
    take = lambda i, n: K.Piece(i, 0, n, np.arange(n, dtype="<u2"))
    for i, n in [(0, 6), (1, 7), (2, 3), (3, 5), (4, 5)]:
        p.add(take(i, n))
    # 2 fits best beside 1 (full); 3 opens a window; 4 fits beside 3 and fills it
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in p.rows] == [(1, 0, 7, 0, 0), (2, 0, 3, 0, 7), (3, 0, 5, 1, 0), (4, 0, 5, 1, 5)]
    p.add(take(5, 9))
    p.add(take(6, 8))  # fits in neither (6 and 9 filled): the fullest takes one id and goes, the rest is placed anew
    assert [(r[0], r[1], r[2], r[6]) for r in p.rows[4:]] == [(5, 0, 9, 0), (6, 0, 1, 9)]
    p.close()
    assert sum(_lengths(p.rows).values()) == 43
    assert all(n == 10 or n & (n - 1) == 0 for n in _lengths(p.rows).values())


def _lengths(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[5]] += r[2]
    return out


def test_a_task_holds_a_bounded_state():
    rng = random.Random(1)
    p = K.Packer(0, length=64, windows=8)
    for i in range(20_000):
        p.add(K.Piece(i, 0, n := rng.randint(1, 200), np.zeros(n, "<u2")))
        assert len(p.held) <= 8 and len(p.open) == len(p.held)
        p.rows.clear()
