"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings that matter at scale, for sessions that this module makes; what the
# cluster's spark-defaults or the submit command set is left alone.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # AQE converts a sort-merge join into a broadcast join only when the
    # measured (runtime) size of a side is below this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "testsieve",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, pass nothing and let the
    cluster's defaults (master, partitions, checkpoint dir) apply."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("TESTSIEVE_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    given = set(SparkSession.getActiveSession().conf.getAll) if SparkSession.getActiveSession() else {
        k for k, _ in SparkConf().getAll()}
    for k, v in _SCALE_CONF.items():
        if k not in given and k not in (extra or {}):
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``
    (or already set on the SparkContext).

    On a cluster this setting must point at shared storage and is used as is.
    Only under a local master is a scratch folder made where it is unset."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) \
        or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="testsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written stage tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def checkpointed(df):
    """Reliable checkpoint (lineage cut) into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []  # run paths of this process, in order


def run_path(spark: SparkSession, name: str) -> str:
    """A location of this call alone under the shared checkpoint folder: two sessions,
    or two runs of one query, never write to the same place."""
    _made.append(scratch_path(spark, f"{name}-{uuid.uuid4().hex}"))
    return _made[-1]


def mark() -> int:
    """The run paths made so far, for ``release``."""
    return len(_made)


def made(since: int = 0) -> list[str]:
    """The run paths made since then, the latest last."""
    return _made[since:]


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Deletes what lies at the run paths made since ``mark()`` gave ``since``, but for those in
    ``keep``; returns their number.  For when the results that read them are written
    or no longer wanted: stage tables otherwise stay until the shared folder is cleared."""
    paths = [p for p in _made[since:] if p not in keep]
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made[since:] = [p for p in _made[since:] if p in keep]
    return len(paths)


def stored(df, name: str):
    """``df`` written as a Parquet table under the shared checkpoint folder and read back:
    the rows are computed once, and stay if an executor is lost."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once for each Spark context), so that
    they can import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_testsieve_shipped", None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # executors fetch the file when they start, so it stays until the driver ends
    folder = tempfile.TemporaryDirectory(prefix="testsieve-ship-")
    path = os.path.join(folder.name, "testsieve_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(top, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._testsieve_shipped = folder
