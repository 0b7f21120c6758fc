"""Tables between the steps of a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, a temporary folder in local mode, and on a
    cluster one in the user's home on the cluster's file system; an error if that is the machine's own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.startswith("local"):
            place = tempfile.mkdtemp(prefix="tessera-")
        else:
            files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
            if files.getUri().getScheme() == "file":
                raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
            place = f"{files.getHomeDirectory().toString()}/tessera-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as a Parquet table to the shared folder and read again: a short lineage that survives lost executors. The table goes with release, clear, or when
    Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key that differs by row, before work that costs much more than the size of its rows tells: small files and shuffles are read by few tasks otherwise."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def release(*tables: DataFrame | None) -> None:
    """Removes tables that cut made and no plan needs any more."""
    for t in tables:
        _remove(getattr(t, "_tessera_path", None))


def release_of(spark: SparkSession) -> None:
    """Removes the tables that plans of one session made, as a micro-batch has its own."""
    for path in [p for p, s in _held.items() if s is spark]:
        _remove(path)


def clear() -> None:
    """Removes all tables that cut made: when results are written."""
    for path in list(_held):
        _remove(path)


def _remove(path: str | None) -> None:
    spark = _held.pop(path, None)
    if spark:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner clears it
            pass


atexit.register(clear)
