"""Ordinals and running sums inside classes of any size.

``row_number() OVER (PARTITION BY label ORDER BY key)`` puts a whole class
into one task; with two classes that is two tasks for the whole table.  Here
rows are dealt once, by ranges of (class, order keys, a row number that splits
equal rows), sorted in their range and stored with their place.  A class is then
a run of places in each range, so a row's number inside its class is its place,
less the place at which the class begins in the range, plus the class's rows in
the ranges before.  These offsets have a row for each class and one more for each
range that a class reaches over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import stored

_RANGE = 33  # bits of a place inside its range in monotonically_increasing_id


def _dealt(df: DataFrame, by: str, order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """Rows in ranges of (class, order), sorted; equal rows can lie in several ranges."""
    keys = [F.col(by), *(F.col(o) if isinstance(o, str) else o for o in order), F.col("_row")]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.withColumn("_row", F.monotonically_increasing_id())
            .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row"))


def _offsets(parts: DataFrame, by: str, amount: str, total: str) -> DataFrame:
    """``_pid, by, amount`` to the amount of the class before each of its ranges, ``_off``,
    and in all of them."""
    w = Window.partitionBy(by)
    return parts.withColumns({
        "_off": F.coalesce(F.sum(amount).over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        total: F.sum(amount).over(w)}).drop(amount)


def _met(rows: DataFrame, offsets: DataFrame, by: str, few_classes: bool) -> DataFrame:
    offsets = offsets.withColumnsRenamed({"_pid": "_pid2", by: "_by2"})
    side = F.broadcast(offsets) if few_classes else offsets
    return rows.join(side, (F.col("_pid") == F.col("_pid2")) & F.col(by).eqNullSafe(F.col("_by2"))).drop("_pid", "_pid2", "_by2")


def ordinal_within(df: DataFrame, by: str, order: Sequence[str | Column], out: str = "ordinal",
                   partitions: int | None = None, few_classes: bool = True) -> DataFrame:
    """0-based ordinal of each row inside its ``by`` class in ``order``, and
    the class size as ``{out}_n``.  Null is a class; rows that are equal in ``order`` get
    numbers of their own.  ``few_classes``: ``by`` has a handful of
    values, so the offsets table is bounded by #partitions + #classes and is
    broadcast; otherwise (many classes) the join is left to AQE, which
    broadcasts only after measuring the table."""
    rows = stored(_dealt(df, by, order, partitions).withColumn("_at", F.monotonically_increasing_id()), "ordinals")
    rows = rows.withColumn("_pid", F.shiftright("_at", _RANGE))
    runs = rows.groupBy("_pid", by).agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_cnt"))
    return (_met(rows, _offsets(runs, by, "_cnt", f"{out}_n"), by, few_classes)
            .withColumn(out, (F.col("_off") + F.col("_at") - F.col("_begin")).cast("bigint"))
            .drop("_at", "_begin", "_off"))


def _running(by: str, weight: str):
    """The sum of ``weight`` over the rows before, of the same class and range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = run, 0  # of the class that the batch before ended in
        for b in batches:
            w = pc.fill_null(b.column(weight), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(w) - w
            classes = pc.run_end_encode(b.column(by))
            begin = 0
            for value, end in zip(classes.values.to_pylist(), classes.run_ends.to_pylist(), strict=True):
                before[begin:end] += (total if value == last else 0) - before[begin]
                last, total, begin = value, int(before[end - 1] + w[end - 1]), end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before), pa.array(np.full(len(w), TaskContext.get().partitionId(), np.int32))],
                                             names=[*b.schema.names, "_local", "_pid"])
    return run


def weight_before(df: DataFrame, by: str, order: Sequence[str | Column], weight: str, out: str = "before",
                  partitions: int | None = None) -> DataFrame:
    """Sum of the integer ``weight`` over the rows that precede each row inside its ``by``
    class in ``order`` (a running count when weights are row counts), and the
    class total as ``{out}_total``: running sums inside a range, and the sums of the
    ranges before."""
    schema = StructType([*df.schema.fields, StructField("_local", LongType()), StructField("_pid", IntegerType())])
    rows = stored(_dealt(df, by, order, partitions).mapInArrow(_running(by, weight), schema), "running")
    sums = rows.groupBy("_pid", by).agg(F.sum(weight).alias("_w"))
    return (_met(rows, _offsets(sums, by, "_w", f"{out}_total"), by, False)
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_local", "_off"))
