"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import pickle
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from testsieve.session import run_path

U64 = np.uint64
SLICE = 512
BATCH_BYTES = 4 << 20  # of a batch that goes to a Python worker (a longer text is a batch of its own)
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Random odd 64-bit multipliers that weight the words of a shingle by their place
# (unrelated ones: in a progression, 1 + 9 = 3 + 7 would make different shingles equal).
_PLACE = np.random.default_rng(5).integers(0, 2**64, 64, dtype=U64) | U64(1)


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run alone, under the shared folder of ``spark.checkpoint.dir``."""
    return run_path(spark, name)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, where the session leaves them open: ten thousand
    texts a batch, Spark's bound by rows, are a large part of an executor's memory."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch)`` giving column dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a few hundred rows at a time: what a task holds beside its batch stays small
            for i in range(0, whole.num_rows, SLICE):
                for cols in fn(whole.slice(i, SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = h[:n] * _PLACE[0]
    for i in range(1, k):
        acc += h[i:i + n] * _PLACE[i % 64] + U64(i // 64)
    return mix64(acc)


class Recent(dict):
    """A bounded table of computed values: ``table[key]`` computes what is missing.
    When full, the older half goes unless it is asked for again."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self._make, self._most, self._old = make, max(2, most // 2), {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


IDLE = 15  # seconds after which a Python worker gives back the model that no task asks for
_worker: dict = {}
_watch: dict = {"used": 0.0, "thread": None}


def _release() -> None:
    """Gives the memory of the held model back to the system."""
    _worker.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _release_when_idle() -> None:
    while True:
        time.sleep(IDLE / 3)
        if _worker and time.monotonic() - _watch["used"] > IDLE:
            _release()


def held(key: str, make: Callable):
    """What ``make()`` gives, made once in a Python worker and kept for its later tasks until
    another ``key`` is asked for or none for ``IDLE`` seconds: a worker holds the model of one
    operator at a time, and none while others work in its place."""
    _watch["used"] = time.monotonic()
    value = _worker.get(key)
    if value is None:
        _release()
        value = _worker[key] = make()
        if _watch["thread"] is None or not _watch["thread"].is_alive():
            _watch["thread"] = threading.Thread(target=_release_when_idle, daemon=True)
            _watch["thread"].start()
    return value


def shared_model(spark: SparkSession, parts, make: Callable):
    """A function without arguments for use in tasks that gives ``make(parts)`` of the worker.
    The parts travel as bytes, so a worker does not keep them beside the model."""
    sent, key = spark.sparkContext.broadcast(pickle.dumps(parts)), uuid.uuid4().hex
    return lambda: held(key, lambda: make(pickle.loads(sent.value)))


def fit_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows (all if there are no more) by a fixed hash of
    ``key``: the bounded sample on which a classifier is fitted."""
    from pyspark.sql import functions as F

    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for whose ``column`` values ``keep`` is true."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
