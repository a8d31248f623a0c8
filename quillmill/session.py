"""Spark session, table loading and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "domain_seed sft_task audit_result judge_result rollout_log bench_item keep_target split_target"
).split()

_SCRATCH = None
#: Tables written to the shared folder by this process.
_WRITTEN: set[str] = set()


def get_session(cpus: int | str = "*", shuffle_partitions: int | None = None, app: str = "quillmill") -> SparkSession:
    """Local session with the settings the library expects (UTC, ANSI, AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLMILL_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, lazily, so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, local
    runs) a temporary folder of this machine is made, and removed when the process ends.
    """
    global _SCRATCH
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _SCRATCH is None:
        _SCRATCH = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, _SCRATCH, ignore_errors=True)
    return "file://" + _SCRATCH


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that
    survive the loss of an executor, and later readers prune columns."""
    return written(df, scratch_path(df.sparkSession, label))


def written(df: DataFrame, path: str) -> DataFrame:
    """`materialize` under a path of the caller, who can `discard` it once nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside give back their shuffle files when they end, not when the driver happens to
    collect its garbage; whatever is read again has to be written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path in the shared folder; what is written there goes with `release`, at the latest when
    this process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.add(path)
    return path


def release() -> None:
    """Delete the intermediate tables of this process. Results that still read them must have been
    written or collected before."""
    while _WRITTEN:
        discard(next(iter(_WRITTEN)))


def discard(path: str) -> None:
    """Delete one intermediate table, which nothing may read any more."""
    import pyarrow.fs

    _WRITTEN.discard(path)
    try:
        fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.delete_dir(at)
    except (OSError, ValueError):  # gone already, or on a file system only the JVM reaches
        pass


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that they
    need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="quillmill-zip-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    name = shutil.make_archive(os.path.join(made, "quillmill"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
