"""Session helpers: shared checkpoint folder, materialised stages, table reading."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, else the session's checkpoint folder. Only
    where both are unset and the session runs on this machine alone (tests) a temporary folder
    is taken; on a cluster that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        own = context._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="corpuloom-")
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


_stages: list[str] = []


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed by :func:`release`, at the latest when the driver process ends."""
    path = f"{shared_dir(spark)}/corpuloom/{uuid.uuid4().hex}"
    if not _stages:
        atexit.register(release, spark)
    _stages.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Frames that run inside send their rows to Python one at a time: for rows that are a table of their own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Remove the files of all stages written so far. Frames made of them must have been consumed."""
    while _stages:
        _delete(spark, _stages.pop())


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(ship, "sent", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpuloom-")) / "corpuloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    ship.sent = context.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core up to which a table is small; and a bound of what is shuffled to give every core some.
SMALL, SMALL_ALL = 32 << 20, 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Give every core work where a small table comes in fewer partitions than there are cores.

    Goes by size and partitions as planned, which lists and runs nothing more; only the plan changes.
    ``df`` is a scan with filters and projections.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < min(cores * SMALL, SMALL_ALL) and plan.toRdd().getNumPartitions() < cores else df
