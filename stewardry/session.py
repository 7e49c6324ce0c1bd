"""Session settings and the two ways this package cuts a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Settings every job of this package wants; a cluster profile may override any of them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "stewardry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``, else one in the warehouse.

    A local session without that setting uses a temporary folder. On a cluster a ``file:`` folder may be a mount that all
    machines share or a disk of one machine; the path does not tell, so executors write there once, and the folder is
    refused if the rows are not seen again.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local")
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path and local:
        path = tempfile.mkdtemp(prefix="stewardry-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    elif not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stewardry"
    if not local and path not in _seen_shared and _filesystem(spark, path)[0].getScheme() == "file":
        if not _is_shared(spark, path):
            raise RuntimeError(f"{path} is not shared by all executors; spark.checkpoint.dir must name a folder that is")
        _seen_shared.add(path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Folders on ``file:`` paths that executors of a cluster have been seen to share with the driver.
_seen_shared: set[str] = set()


def _is_shared(spark: SparkSession, path: str) -> bool:
    """Whether rows that executors write to a folder are all there for the driver and the executors."""
    probe, tasks = f"{path.rstrip('/')}/probe-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    try:
        spark.range(0, 10 * tasks, numPartitions=tasks).write.parquet(probe)
        return spark.read.schema("id bigint").parquet(probe).count() == 10 * tasks
    finally:
        release(spark, [probe])


#: Folders that ``materialise`` has written and nothing has deleted yet.
_written: list[str] = []


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted like those of :func:`materialise`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows survive a lost executor, the plan behind them is gone, and Spark knows their true
    size, so later joins broadcast them only if they are in fact small. The folder stays until :func:`release` or the
    :func:`scratch` block it was written in deletes it.
    """
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def materialise_counted(df: DataFrame, label: str = "step") -> tuple[DataFrame, int]:
    """:func:`materialise`, and how many rows the write put down."""
    rows = Observation()
    out = materialise(df.observe(rows, F.count(F.lit(1)).alias("rows")), label)
    return out, rows.get["rows"]


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete folders that :func:`materialise` wrote, or all of them."""
    for path in list(_written if paths is None else paths):
        fs, target = _filesystem(spark, path)
        fs.delete(target, True)
        if path in _written:
            _written.remove(path)


class Scratch:
    """What a :func:`scratch` block keeps when it ends."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Let the folder of a materialised frame outlive the block."""
        self.kept.add(df.scratch_path)
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete all that the block materialises when it ends, also when it fails.

    Intermediate tables hold the same personal data as their inputs. Write a result inside the block, and nothing
    else of it remains.
    """
    before, held = set(_written), Scratch()
    try:
        yield held
    finally:
        release(spark, [p for p in _written if p not in before and p not in held.kept])
