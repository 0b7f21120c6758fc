"""Records resolved as they arrive, and again when rules or overrides that came later decide them otherwise.

Each micro-batch is one folder of results and one of records, named by the batch's number: a batch that is repeated after a failure
replaces its own folders, so each counts once. ``latest`` gives a record's last result. Each batch looks at all records so far, and
resolves those again that another rule decides now.

In one batch a record is resolved once: of rows with its id, the greatest counts; rows without an id are left to the reader of the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.rules import Rule
from tessera.plans import tables
from tessera.plans.incremental import record_prints
from tessera.plans.resolve import RECORD, Settings, Source, resolve


def canonical(records: DataFrame) -> DataFrame:
    """All columns that records may have, as text, so that batches have one schema."""
    columns = ("record_id", *RECORD, "observation_date")
    return records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast("string").alias(c) for c in columns]).where("record_id is not null")


def _last(rows: DataFrame) -> DataFrame:
    """Each record's row of the last batch it was in."""
    w = Window.partitionBy("record_id").orderBy(F.desc("batch"))
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last result of each record, with its batch."""
    return _last(spark.read.parquet(f"{out}/results"))


def _resolve_batch(rows: DataFrame, batch: int, sources: list[Source], out: str, settings: Settings, forced: list[Rule]) -> None:
    spark = rows.sparkSession
    given = canonical(rows)
    given = given.groupBy("record_id").agg(F.max(F.struct(*[c for c in given.columns if c != "record_id"])).alias("r")).select("record_id", "r.*")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/records")
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        past = spark.read.parquet(f"{out}/records").where(F.col("batch") < batch)
        past = _last(past).join(given.select("record_id"), "record_id", "left_anti")
        said = past.select("record_id", F.col("print").alias("_before"))
        now = record_prints(past, forced).select("record_id", "print")
        other = now.join(said, "record_id").where("print <> _before").select("record_id")
        given = given.unionByName(past.drop("batch", "print").join(other, "record_id", "left_semi"))
    given = tables.cut(given)
    prints = record_prints(given, forced).select("record_id", "print")
    given.join(prints, "record_id").write.mode("overwrite").parquet(f"{out}/records/batch={batch}")
    resolve(given, sources, settings, forced).write.mode("overwrite").parquet(f"{out}/results/batch={batch}")


def resolve_stream(records: DataFrame, sources: Callable[[], list[Source]], out: str, checkpoint: str, settings: Settings = Settings(), forced: Callable[[], list[Rule]] = list, **trigger) -> StreamingQuery:
    """Starts a query that resolves a stream's records into folders below out. sources and forced are asked at each batch, so that a batch sees what was said
    before it; trigger: as DataStreamWriter.trigger takes it."""

    def one(rows: DataFrame, batch: int) -> None:
        try:
            _resolve_batch(rows, batch, sources(), out, settings, forced())
        finally:
            tables.release_of(rows.sparkSession)

    return records.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).foreachBatch(one).start()
