"""Table readers, writers and management."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from passageworks.functions import fixed


def read_files(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Scan a Parquet path; a given schema spares the footer inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan with fewer splits than cores, for CPU-heavy steps.

    A scan of many files or row groups comes back as it is, without a shuffle.
    With `keys` a later aggregation or join on them needs no further one.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    splits: int = 1,
    **options: str,
) -> DataFrame:
    """Read a database table, in `splits` parallel ranges of `split_column`.

    Filters and column lists on the result are pushed into the database.  A
    vector column arrives as text `[x,y,...]`; `from_json(..., 'array<float>')`
    reads it.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column is not None:
        if bounds is None:
            raise ValueError("split_column needs bounds")
        reader = reader.options(
            partitionColumn=split_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(splits),
        )
    return reader.load()


def write_jdbc(
    df: DataFrame, url: str, table: str, page_size: int = fixed.INSERT_PAGE, **options: str
) -> None:
    """Full refresh of a database table: truncate, then insert page by page."""
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, truncate="true", batchsize=str(page_size))
        .options(**options)
        .mode("overwrite")
        .save()
    )


def literal_rows(
    spark: SparkSession, rows: Iterable[Sequence[Any]], schema: T.StructType
) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def create_if_missing(
    spark: SparkSession, name: str, schema: T.StructType, path: str | None = None
) -> None:
    location = "" if path is None else f" LOCATION '{path}'"
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
        for f in schema
    )
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{location}")


def drop_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Drop the tables that exist, in the given order (children first)."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def refresh_files(df: DataFrame, path: str) -> None:
    """Replace the files at `path`; the old ones stay until the new ones are complete."""
    jvm = df.sparkSession._jvm
    new = path.rstrip("/") + f"-{uuid.uuid4().hex}"
    df.write.parquet(new)
    old_path, new_path = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    files = old_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    files.delete(old_path, True)
    if not files.rename(new_path, old_path):
        raise OSError(f"could not move {new} to {path}")
    df.sparkSession.catalog.refreshByPath(path)


def refresh_table(df: DataFrame, name: str) -> None:
    """Replace the rows of an existing table, columns matched by name."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


def switch_table(df: DataFrame, name: str, folder: str) -> str:
    """Replace the rows of an existing table by files of their own; returns their path.

    The new files are written beside the old ones, under `folder`, and then the catalog entry
    is set to them in one step.  Readers find the old rows until then and the new ones after;
    a failure before leaves the table as it was.  Old files stay for readers that began
    before; `drop_version` removes them.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.select(*spark.table(name).columns).write.parquet(path)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return path


def location(spark: SparkSession, name: str) -> str:
    """Where a table's files are."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'")
    return rows.first()["data_type"]


def drop_version(spark: SparkSession, name: str, path: str) -> None:
    """Delete files that `name` had before a switch; those it has now are an error."""
    if location(spark, name).rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]):
        raise ValueError(f"{name} still reads {path}")
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def analyze(spark: SparkSession, name: str) -> None:
    """Refresh row count, size and column statistics for the optimizer."""
    atomic = [
        f.name
        for f in spark.table(name).schema
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(atomic)}")
