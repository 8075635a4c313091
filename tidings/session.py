"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Tasks a core for listing folders.
LISTS_A_CORE = 4


def build_session(app: str = "tidings", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A temporary folder stands in for it only in local mode, where the driver is the cluster.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidings-"))
    return spark.sparkContext.getCheckpointDir()


# The folder of the running job below the shared one, if there is one.
JOB: ContextVar[str] = ContextVar("job", default="")


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[None]:
    """Within this block all intermediate tables lie in one folder, which is deleted at its end.

    Use what operators return, or write it, inside the block. Without it the tables stay, as a lazy
    result may still need them.
    """
    token = JOB.set(f"job-{uuid.uuid4().hex}/")
    folder = f"{shared_folder(spark)}/tidings/{JOB.get()}"
    try:
        yield
    finally:
        JOB.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def list_by_few_tasks(spark: SparkSession) -> None:
    """Folders of many files are listed by a few tasks a core.

    By Spark's default each folder, or each file that a batch of a stream names, is a task by itself,
    and starting it costs far more than looking.
    """
    most = LISTS_A_CORE * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING_TASKS)) > most:
        spark.conf.set(LISTING_TASKS, str(most))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/tidings/{JOB.get()}{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Row positions taken from the layout of ``df`` then stay the same for every reader, also when
    executors are lost, and the lineage ends here.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
