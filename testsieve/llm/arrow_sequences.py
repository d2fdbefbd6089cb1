"""Token ids as Arrow stream files of equal-length sequences.

A file holds record batches of three columns: ``ids`` (fixed-size list of the
smallest unsigned type that fits the vocabulary), ``mask`` (fixed-size list of
booleans; false where the file's last sequence is padded) and ``ends`` (the
documents that end in the sequence, with the place of their end id).  Memory
mapped, a sequence is a slice of the file's buffers.

Documents are dealt by ranges of ``doc_id`` and sorted within them, so the files in
order hold the documents in order.  A task writes a file of its own attempt and
returns its path; only the files in the written manifest count, so a lost
executor or a repeated task leaves no wrong file behind.  Files go to the shared
folder through ``pyarrow.fs``."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LENGTH = 2048
BATCH = 64  # sequences of a record batch
END = 2
CACHE = 1_000_000  # words kept by a worker: at most about 200 MB
CACHE_CHARS = 48
_MARKS = ".,;:!?*#$%&|)\"]"
# byte-level signs: printable bytes stand for themselves, the others for U+0100 on
_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_AS_IS = ("Σ", "İ", "<|")


def _lowered(text: str) -> str:
    """The text in lower case where the library makes the same of both, else as it is.

    The library composes (NFC) before it lower-cases.  Of a composed text whose small
    letters are composed as well, both orders give the same; a capital and a mark
    with no sign in one, whose small letters have one, do not.  Special tokens and
    capitals whose small form depends on their place stay too."""
    low = text.lower()
    try:
        text.encode("latin-1")  # of these characters every text is composed, in capitals and small letters
        return low if "<|" not in text else text
    except UnicodeEncodeError:
        pass
    if any(x in text for x in _AS_IS) or not (is_normalized("NFC", text) and is_normalized("NFC", low)):
        return text
    return low


class Encoder:
    """The library's ids of whole texts, by words kept in a bounded table.

    The tokenizer lower-cases, drops white space and never joins a letter to a mark
    after it, so the ids of a text are those of its stretches between spaces and
    line ends, and a stretch's are those of the part up to its last plain letter
    and of the marks behind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.merges = self.library.model
        self.words = C.Recent(self._word, CACHE)

    def _word(self, w: str) -> bytes:
        stem = w.rstrip(_MARKS)
        if stem and stem != w and stem[-1].isascii() and stem[-1].isalpha():
            return self.words[stem] + self.words[w[len(stem):]]
        if w.isalpha() and max(w) < "\u0250" and w.islower() and is_normalized("NFC", w):
            # nothing to normalise or to cut: the library's merges alone, on the signs of the bytes
            return np.array([t.id for t in self.merges.tokenize(w.encode().decode("latin-1").translate(_SIGNS))], self.kind).tobytes()
        return np.array(self.library.encode_batch_fast([w], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def encode(self, text: str | None, end: int | None = None) -> bytes:
        out = []
        if text:
            low = _lowered(text)
            words = self.words
            out = [words[w] if len(w) <= CACHE_CHARS else self._word(w) for w in low.replace("\n", " ").split(" ") if w]
        if end is not None:
            out.append(np.array([end], self.kind).tobytes())
        return b"".join(out)


def encoder(path: str) -> Encoder:
    return C.held(f"words {path}", lambda: Encoder(path))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _schema(kind: str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if kind == "<u2" else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())])))])


class Writer:
    """Writes documents' ids, one after another, as sequences of one file."""

    def __init__(self, uri: str, kind: str, length: int):
        files, path = _filesystem(uri)
        self.kind, self.length, self.size = kind, length, np.dtype(kind).itemsize
        self.schema = _schema(kind, length)
        self.out = files.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.buffer, self.ends, self.n = bytearray(), [], 0
        self.done = 0  # ids already in the file
        self.batches: list[int] = []  # where each batch begins

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer += ids
        self.n += len(ids) // self.size
        self.ends.append((doc_id, self.n - 1))
        while len(self.buffer) >= BATCH * self.length * self.size:
            self._write(BATCH)

    def _write(self, rows: int) -> None:
        length, take = self.length, rows * self.length
        part = bytes(self.buffer[:take * self.size])
        del self.buffer[:len(part)]
        real = len(part) // self.size
        ids = np.zeros(take, self.kind)
        ids[:real] = np.frombuffer(part, self.kind)
        ends: list[list] = [[] for _ in range(rows)]
        k = 0
        while k < len(self.ends) and self.ends[k][1] < self.done + take:
            row, at = divmod(self.ends[k][1] - self.done, length)
            ends[row].append({"doc_id": self.ends[k][0], "at": at})
            k += 1
        del self.ends[:k]
        self.done += real
        fixed = lambda values, t: pa.FixedSizeListArray.from_arrays(pa.array(values, t), length)
        self.batches.append(max(self.out.tell(), self.schema.serialize().size))  # the schema comes with the first
        self.stream.write_batch(pa.RecordBatch.from_arrays(
            [fixed(ids, self.schema.field("ids").type.value_type), fixed(np.arange(take) < real, pa.bool_()),
             pa.array(ends, self.schema.field("ends").type)], schema=self.schema))

    def close(self) -> int:
        while self.buffer:
            self._write(min(BATCH, -(-len(self.buffer) // (self.length * self.size))))
        self.stream.close()
        self.out.close()
        return self.n


def write_sequences(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes ``doc_id, text`` as Arrow stream files and returns their manifest:
    ``part, path, n_ids, n_docs, batches``, a row for each file (``batches``: where the
    record batches of ``BATCH`` sequences begin).

    Null texts are empty and give the end id alone; null ids come first; rows that
    repeat an id are ordered by a hash of their text, equal rows as they come, and one
    id can reach over several files; other columns are ignored.  Without rows there
    are no files."""
    folder = C.run_folder(docs.sparkSession, "sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, writer, n_docs = encoder(tokenizer), None, 0
        task = TaskContext.get()
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if writer is None:
                    files, path = _filesystem(folder)
                    files.create_dir(path, recursive=True)
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrows"
                    writer = Writer(path, e.kind, length)
                writer.add(i, e.encode(t, end))
                n_docs += 1
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path],
                                              "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()),
                                              "batches": pa.array([writer.batches], pa.list_(pa.int64()))})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "digest", "row")  # an id or a text of many rows is dealt to several files
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)
    return C.written(dealt.mapInArrow(run, "part int, path string, n_ids long, n_docs long, batches array<long>"), "manifest")


def _opened(path: str):
    files, p = _filesystem(path)
    from pyarrow import fs

    return pa.memory_map(p) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(p)


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    with _opened(path) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


def sequence(path: str, at: int, batches: Sequence[int]) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``at`` of a file, whose batches begin at ``batches`` (of
    the manifest): one seek, and of a local file a view of its buffers, no copy."""
    if not 0 <= at < len(batches) * BATCH:
        raise IndexError(at)
    source = _opened(path)
    schema = pa.ipc.open_stream(source).schema
    source.seek(batches[at // BATCH])
    b = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    if at % BATCH >= b.num_rows:
        raise IndexError(at)
    return b.column("ids")[at % BATCH].values.to_numpy(), b.column("mask")[at % BATCH].values


def documents_of(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of the ids as 32-bit values) of a file's documents."""
    n, crc = 0, 0
    for b in _batches(path):
        ids = b.column("ids").flatten().to_numpy().astype("<u4")
        width, at = b.schema.field("ids").type.list_size, 0
        ends = b.column("ends")
        rows = np.repeat(np.arange(b.num_rows), np.diff(ends.offsets.to_numpy()))
        flat = ends.flatten()
        for doc_id, stop in zip(flat.field("doc_id").to_pylist(), (rows * width + flat.field("at").to_numpy() + 1).tolist(), strict=True):
            yield doc_id, n + stop - at, zlib.crc32(ids[at:stop], crc)
            n, crc, at = 0, 0, stop
        real = int(np.count_nonzero(b.column("mask").flatten().to_numpy(zero_copy_only=False)))
        n += real - at
        crc = zlib.crc32(ids[at:real], crc)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    files = C.written(files.select("path", "first"), "files")

    def rows(b: pa.RecordBatch):
        for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for doc_id, n, crc in documents_of(path):
                for c, v in zip(out, (doc_id, first, n, crc), strict=True):
                    out[c].append(v)
                first += n
                if len(out["start"]) == 10_000:
                    yield out
                    out = {c: [] for c in out}
            yield out

    n = files.count()
    return C.map_rows(files.repartition(max(1, n), "path"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
