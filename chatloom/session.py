"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("chatloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Without that setting a machine-local folder is used, which is only right
    when driver and executors are one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="chatloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir()


# Folders landed inside the open scopes, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is landed inside; nothing lazy may outlive the scope."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            store.delete(folder, True)


def land(df: DataFrame, purpose: str, outer: int = 0, codec: str | None = None) -> DataFrame:
    """Write rows to the shared scratch folder once and read them from there.

    With ``outer`` the rows outlive so many of the innermost scopes and belong to the next one;
    ``codec`` is the compression of the files, if not that of the session.
    """
    path = scratch_path(df.sparkSession, purpose)
    owners = _scopes[: len(_scopes) - outer] if outer < len(_scopes) else _scopes[:0]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chatloom-")) / "chatloom"
    context.addPyFile(
        shutil.make_archive(str(target), "zip", package.parent, package.name)
    )
    _shipped.add(context.applicationId)
