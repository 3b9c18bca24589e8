"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "textprov") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Token lists are put back per text; 128 texts per task would fall back to sorting.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """Let Arrow batches be cut by bytes, so that Python's memory does not grow with rows a task.

    Ten thousand rows, the usual size, are a hundred megabytes of long texts or their words in
    each of a task's buffers. Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A session of one process may do without: it gets a folder of its own, kept as an
    attribute of the session. Any other session has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_textprov_dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark._textprov_dir = tempfile.mkdtemp(prefix="textprov-")
    return path.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed with the other intermediate tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used for tables that several later steps read: the work is done once, a lost
    executor costs nothing but a re-read, and the file size is known to the
    optimizer when it chooses joins. The table lives until the ``scratch`` around it
    ends, or else until the program does.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Remove the intermediate tables made inside when it ends.

    Results that read them have to be written, or collected, before.
    """
    before = len(_made)
    try:
        yield
    finally:
        paths = _made[before:]
        del _made[before:]
        _remove(spark, paths)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        with suppress(Exception):  # the program ends either way
            _remove(spark, _made)
