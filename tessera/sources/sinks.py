"""Where results go: JSON, JSON lines, Parquet, flat CSV; all at once, never half written, never over what is there unless asked.

Results are written beside their place and moved there when they are complete; what was there before is kept until then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.results import flat, safe_cell, with_decision

#: Spreadsheets know by it that a file is UTF-8.
BOM = "\ufeff"


def _array(rows: DataFrame) -> DataFrame:
    """The lines of one JSON array. One file has one writer: it streams, but for large results take lines (.jsonl)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            text = batch.column(0).drop_null().to_pylist()
            if text:
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + t for i, t in enumerate(text)])], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    one = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that there is a task where there are no rows
    return text.unionByName(one).coalesce(1).mapInArrow(lines, "value string")


def _publish(rows: DataFrame, path: str, overwrite: bool, save: Callable[[str], None]) -> None:
    spark = rows.sparkSession
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, aside, old = (make(path.rstrip("/") + end) for end in ("", f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and not overwrite:
        raise FileExistsError(f"{path} already exists.")
    try:
        save(aside.toString())
        if files.exists(target):
            if not overwrite:
                raise FileExistsError(f"{path} already exists.")
            files.rename(target, old)
        if not files.rename(aside, target):
            raise OSError(f"{path} could not be put in place.")
    except Exception:
        if files.exists(old) and not files.exists(target):
            files.rename(old, target)
        files.delete(aside, True)
        raise
    files.delete(old, True)


def write(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """By the path's ending: .parquet or .pq (zstd), .json (one array), .jsonl (a line each), .csv. An existing path is an error unless overwrite is set."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    savers = {
        "parquet": lambda p: results.write.option("compression", "zstd").parquet(p), "jsonl": lambda p: results.write.json(p), "json": lambda p: _array(results).write.text(p),
        "csv": lambda p: as_text(results).withColumnRenamed(results.columns[0], BOM + results.columns[0]).write.csv(p, header=True, escape='"'),
    }
    save = savers.get({"pq": "parquet", "ndjson": "jsonl"}.get(kind, kind))
    if not save:
        raise ValueError(f"Results are not written to files that end with .{kind}.")
    _publish(results, path, overwrite, save)


def as_text(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, text cells safe."""
    cell = lambda n, t: F.to_json(n) if t.startswith(("array", "struct", "map")) else safe_cell(F.col(n)) if t == "string" else F.col(n)
    return rows.select(*[cell(n, t).alias(n) for n, t in rows.dtypes])


def export(results: DataFrame, path: str, statuses: list[str] | None = None, source: DataFrame | None = None, overwrite: bool = False) -> None:
    """Flat CSV of chosen decisions; source: rows by record_id whose columns come first."""
    rows = flat(with_decision(results, statuses) if statuses else results)
    if source is not None:
        kept = [c for c in source.columns if c not in rows.columns]
        rows = source.select("record_id", *kept).join(rows, "record_id").select(*kept, *rows.columns)
    write(rows, path, overwrite)
