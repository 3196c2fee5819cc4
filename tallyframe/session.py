"""Session defaults and the one place that knows where shared files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Megabytes of a partition, below which ``fewer`` joins some.
PART_MB = 16


def get_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) does this make a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside drop their shuffle files once executed, which suits those that run once.

    Else the files stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def fewer(df: DataFrame, mb: float | None = None) -> DataFrame:
    """``df`` in no more partitions than eight a core or one for each PART_MB; it has ``mb`` or what the plan's statistics say.

    A table that is small for its partitions makes as many small files when it is cut.
    """
    if mb is None:
        mb = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6
    most = max(8 * df.sparkSession.sparkContext.defaultParallelism, -(-int(mb) // PART_MB))
    return df.coalesce(most) if most < 1 << 20 else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
