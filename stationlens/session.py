"""Sessions and the shared folder intermediate tables are written to."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: Name of the innermost open scope.
_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("stationlens_scope", default=None)


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stationlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STATIONLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="stationlens-")
    return _local_dirs[sc.applicationId]


def work_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/stationlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path among the intermediate tables, within the open scope if there is one."""
    scope = _scope.get()
    folder = f"{work_dir(spark)}/{scope}" if scope else work_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Owns the intermediate tables written inside; they are deleted at the end, also after an error.

    Results that read them must be stored or collected before. Scopes may be nested.
    """
    name = f"scope-{uuid.uuid4().hex}"
    outer = _scope.set(f"{_scope.get()}/{name}" if _scope.get() else name)
    folder = f"{work_dir(spark)}/{_scope.get()}"
    try:
        yield folder
    finally:
        _scope.reset(outer)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage, so a lost executor re-reads files instead of repeating
    the work, and gives the optimizer the true size of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application; results read from them are gone too."""
    return _delete(spark, work_dir(spark))
