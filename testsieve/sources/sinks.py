"""Sinks: snapshot tables of Parquet files with committed manifests.

A write puts its files into a folder of its own and then commits a manifest: the
next version of a list that names, for every partition of the table, the folder that
holds it.  Partitions that the write did not produce keep their folder, so a rerun
replaces exactly what it produces.  Readers follow the newest complete manifest: files
of a killed or unfinished write are in no manifest, plans made before a rerun read the
files they were made for, and of two writers that commit at once the second builds
on the first.  Old folders stay until ``vacuum``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TRIES = 100


class _Folder:
    """A table's folder through Hadoop's file system (any store that Spark reaches)."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that is not there yet; false if it is."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if self.fs.exists(self._path(name)):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _versions(folder: _Folder) -> list[str]:
    return [n for n in folder.names("_manifests") if n.endswith(".json")]


def _manifest(folder: _Folder) -> tuple[int, dict]:
    """Number and content of the newest manifest that is complete (a writer can be killed in
    the middle of one)."""
    versions = _versions(folder)
    for name in reversed(versions):
        try:
            found = json.loads(folder.read(f"_manifests/{name}"))
        except ValueError:
            continue
        return int(versions[-1].removesuffix(".json")), found
    return (int(versions[-1].removesuffix(".json")) if versions else 0), {"partition_by": [], "schema": None, "partitions": {}}


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset", "llm")) -> int:
    """Writes ``df`` and commits it; returns the manifest's number.  The partitions in ``df``
    replace those in the table; a hot partition is written by many tasks."""
    spark = df.sparkSession
    folder = _Folder(spark, path)
    own = f"data/{uuid.uuid4().hex}"
    # sorted inside each task, so that a task keeps one output file open at a time; no
    # repartition by the partition columns: a hot one would be written by a single task
    df.sortWithinPartitions(*partition_by).write.partitionBy(*partition_by).parquet(f"{path}/{own}")
    made = [own]
    for c in partition_by:
        made = [f"{d}/{n}" for d in made for n in folder.names(d) if n.startswith(f"{c}=")]
    mine = {d.removeprefix(f"{own}/"): own for d in made}
    for _ in range(TRIES):
        last, manifest = _manifest(folder)
        whole = {"partition_by": list(partition_by), "schema": df.schema.jsonValue(), "partitions": manifest["partitions"] | mine}
        if folder.create(f"_manifests/{last + 1:012d}.json", json.dumps(whole)):
            return last + 1
    raise RuntimeError(f"{path}: no manifest committed in {TRIES} tries")


def read_snapshot(spark: SparkSession, path: str, schema: StructType | None = None, **only: str) -> DataFrame:
    """The table as its newest manifest has it; ``only`` (partition column = value) leaves out
    the other partitions' folders before any is listed."""
    _, manifest = _manifest(_Folder(spark, path))
    if schema is None:
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else StructType()
    folders: dict[str, list[str]] = {}
    for part, own in sorted(manifest["partitions"].items()):
        if all(f"{c}={v}" in part.split("/") for c, v in only.items()):
            folders.setdefault(own, []).append(f"{path}/{own}/{part}")
    # one read for each write that still holds a partition
    out = None
    for own, parts in folders.items():
        df = spark.read.schema(schema).option("basePath", f"{path}/{own}").parquet(*parts).select(*schema.names)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes the folders that the newest manifest does not name, and the older manifests;
    returns the number of folders.  To be called when no write is under way."""
    folder = _Folder(spark, path)
    _, manifest = _manifest(folder)
    named = set(manifest["partitions"].values())
    old = [n for n in folder.names("data") if f"data/{n}" not in named]
    for n in old:
        folder.remove(f"data/{n}")
    for n in _versions(folder)[:-1]:
        folder.remove(f"_manifests/{n}")
    return len(old)


def sink_scored(scored: DataFrame, path: str) -> None:
    """Functions with predictions and scores, a partition for each (dataset, llm)."""
    write_snapshot(scored, path, ("dataset", "llm"))


def sink_curated(curated: DataFrame, path: str) -> None:
    """Curated tests; replaces only the (dataset, llm) partitions present."""
    write_snapshot(curated, path, ("dataset", "llm"))
