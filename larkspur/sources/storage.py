"""Table access and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session, where one machine is everything, gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-larkspur-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with less disk than a row checkpoint; a lost executor cannot take the
    result along. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._stored_at = path
    return rows


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables, once nothing will read them again; other tables are left alone."""
    for rows in tables:
        if path := getattr(rows, "_stored_at", None):
            spark = rows.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there; for range reads and writes within tasks."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path := re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))) else (fs.LocalFileSystem(), path)
