"""Exact SentencePiece merge encoding by backtracking, and decoding.

A text's spaces become the mark U+2581, one is put before it, and the result is cut
where no piece can reach across: before a run of marks (no piece has a mark
after another character) and around characters that are in no piece (these
become byte pieces).  Each chunk is encoded by itself:

* an Aho-Corasick automaton over the pieces gives the longest piece at each place;
* pieces are taken from left to right, longest first, as long as each is
  compatible with the one before: re-merging the two from their characters by
  the model's scores gives exactly these two back;
* where none is, the place is marked in a bitfield of failed positions, the last
  piece is taken back and its next shorter prefix is tried.

A sequence whose neighbours are all compatible is the one that merging the whole
text gives, so the result is exact, ties among equal scores (leftmost first)
included.  Chunks recur, so workers keep a bounded table of encoded chunks.  The whole
text's ids are decoded by the library's ``decode(ids)``."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
CACHE = 600_000  # chunks, and pairs of pieces, kept by a worker: at most about 200 MB
CACHE_CHARS = 48
NEVER = float("-inf")


class PieceModel:
    def __init__(self, path: str, chunks: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_id) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("needs a model with byte pieces and marks only at the front of pieces")
        self.chars = {c for p in self.ids for c in p}
        self.library = sp
        self.size = [len(p) for p in self.text]
        self.shown = [str(i) for i in range(n)]
        # only pieces that merging their own characters gives can occur in a result
        self.auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [p]:
                self.auto.add_word(p, i)
        self.auto.make_automaton()
        self.shorter = C.Recent(self._shorter, n + 2)
        self.fits = C.Recent(self._fits, chunks)
        known = re.escape("".join(sorted(self.chars - {MARK}))).replace("\n", "\\n")
        self.chunk = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{MARK}{known}]")
        self.cache = C.Recent(self._chunk, chunks)

    def merge(self, s: str) -> list[str]:
        """The pieces that merging the characters of a short string gives."""
        parts, score = list(s), self.score
        gain = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while gain and (best := max(gain)) > NEVER:
            i = gain.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
            if i < len(gain):
                gain[i] = score.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether merging two neighbours' characters gives these two: ``first << 32 | second``."""
        a, b = self.text[pair >> 32], self.text[pair & 0xFFFFFFFF]
        return self.merge(a + b) == [a, b]

    def _shorter(self, i: int) -> int:
        """The longest piece that is a proper prefix of piece ``i``, or -1."""
        p = self.text[i]
        return next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.auto), -1)

    def split(self, chunk: str) -> list[int]:
        """Ids of the pieces of a chunk of known characters."""
        size, fits, shorter = self.size, self.fits, self.shorter
        longest = [-1] * len(chunk)
        for end, i in self.auto.iter(chunk):
            longest[end + 1 - size[i]] = i
        out: list[int] = []
        failed = bytearray(len(chunk) // 8 + 1)
        at, i = 0, longest[0]
        while True:
            end = at + size[i]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1] << 32 | i]):
                out.append(i)
                if end == len(chunk):
                    return out
                at, i = end, longest[end]
                continue
            i = shorter[i]
            while i < 0:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last]
                i = shorter[last]

    def chunk_ids(self, chunk: str) -> list[int]:
        if chunk[-1] in self.chars:
            return self.split(chunk)
        return [self.byte_id[v] for v in chunk.encode("utf-8", "replace")]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, the end id last."""
        return [i for c in self.chunks(text or "") for i in self.chunk_ids(c)] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the library."""
        return self.library.decode(ids)

    def _chunk(self, c: str) -> tuple[int, ...]:
        return tuple(self.chunk_ids(c))

    def digest(self, text: str | None) -> tuple[int, str, str, list[int]]:
        """Number of ids, hash of the ids in decimal, hash of the text that they decode to, and the ids."""
        known, make, shown = self.cache, self._chunk, self.shown
        ids = list(chain.from_iterable([known[c] if len(c) <= CACHE_CHARS else make(c) for c in self.chunks(text or "")]))
        ids.append(self.eos)
        listed = " ".join([shown[i] for i in ids])
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest(), ids


def model(path: str, chunks: int = CACHE) -> PieceModel:
    """The model of a worker, read once, with tables of ``chunks`` entries."""
    return C.held(f"pieces {path} {chunks}", lambda: PieceModel(path, chunks))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` to ``doc_id, ids``: the ids of each whole text and the end id.
    Null is the empty text; repeated rows give equal rows; other columns are ignored."""
    def rows(b: pa.RecordBatch):
        m = model(path)
        yield {"doc_id": b.column("doc_id"), "ids": [m.encode(t) for t in b.column("text").to_pylist()]}

    return C.map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``; null ids give the empty text."""
    def rows(b: pa.RecordBatch):
        m = model(path)
        yield {"doc_id": b.column("doc_id"), "text": [m.decode(x or []) for x in b.column("ids").to_pylist()]}

    return C.map_rows(encoded.select("doc_id", "ids"), rows,
                      f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, chunks: int = CACHE) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``):
    the texts are encoded and their ids decoded in one pass (one row per input row;
    null is the empty text; other columns are ignored; an empty table stays empty).
    ``chunks``: entries of a worker's tables; fewer take less memory and more time."""
    def rows(b: pa.RecordBatch):
        m = model(path, chunks)
        got = [m.digest(t) for t in b.column("text").to_pylist()]
        out = {"doc_id": b.column("doc_id"), "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got],
               "decoded_sha256": [g[2] for g in got]}
        if with_ids:
            out["ids"] = [np.array(g[3], np.int32) for g in got]
        yield out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return C.map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows, schema + ", ids array<int>" * with_ids)
