"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[Callable[[], None]] | None] = ContextVar("work_scope", default=None)

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Vectors make wide rows: keep Arrow batches to a few megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(
    app_name: str = "passageworks", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_passageworks_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="passageworks-")) / "passageworks.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for module in sorted(here.rglob("*.py")):
            target.write(module, module.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._passageworks_shipped = True


def work_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session may go without one; it then gets a fresh temporary
    folder.  On a cluster a machine-local folder would lose data with its host.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="passageworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{_work_tables(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        made.append(lambda: remove_work(spark, path))
    return path


@contextmanager
def work_scope() -> Iterator[None]:
    """Work tables and shared values made inside go at its end, after a failure as well.

    What is computed inside must be written to a path of its own before the end.  Scopes
    are per thread; an inner one removes what it made itself.
    """
    made: list[Callable[[], None]] = []
    outer = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(outer)
        for remove in reversed(made):
            remove()


def shared(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast value, destroyed at the end of the `work_scope` it is made in, if any.

    The caller checks its size.
    """
    sent = spark.sparkContext.broadcast(value)
    if (made := _scope.get()) is not None:
        made.append(sent.destroy)
    return sent


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a work table and read that: computed once, lineage cut."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `stored`, with the table's path, for `remove_work`."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_work(spark: SparkSession, path: str) -> None:
    """Delete a table made under `work_path`, once nothing reads it any more."""
    if not path.startswith(_work_tables(spark) + "/"):
        raise ValueError(f"not a work path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _work_tables(spark: SparkSession) -> str:
    """This session's folder of work tables, removed when its driver ends."""
    context = spark.sparkContext
    folder = f"{work_root(spark)}/passageworks/{context.applicationId}"
    if getattr(context, "_passageworks_folder", None) != folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._passageworks_folder = folder
    return folder
