"""Incremental import: pending facts dropped as JSON lines into a folder, by the same function as in batch.

`drain` writes each batch's rows as they are told; `register` also keeps each fact once over time: what an earlier batch
has registered, or says but for spelling, is not registered again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import cut
from ..operators.facts import distinct_facts

PENDING = (
    "ref_number int, fact_type string, statement string, exact_quote string, value double, unit string,"
    " derivation_formula string, source_values array<double>, stated_result double, sections array<string>, tags array<string>"
)


def pending_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PENDING).option("maxFilesPerTrigger", most_files).json(folder)


def drain(spark: SparkSession, folder: str, checkpoint: str, out: str, imported: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch goes through `imported` and is written under its own batch id, so a batch that is run again
    after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        imported(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pending_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registered(spark: SparkSession, registry: str, before: int | None = None) -> DataFrame | None:
    """The rows of a registry, of the batches before one where that is given; None while there are none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(registry)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in files.listStatus(root)] if files.exists(root) else []
    numbers = {int(p.rsplit("=", 1)[1]): p for p in found if "/batch=" in p}
    # a batch that was cut off has no mark of success, and is written again before the next one
    whole = [p for k, p in sorted(numbers.items()) if (before is None or k < before) and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in whole]) if whole else None


def add_batch(batch: DataFrame, number: int, registry: str, imported: Callable[[DataFrame], DataFrame]) -> None:
    """Registers the accepted facts of a batch that no fact of an earlier batch, nor an earlier one of this, equals.

    A fact's place is its batch, its file and its line, so places ascend over batches. Of the registry only the facts of
    references that the batch names are compared. Writing goes by the batch's number and reads smaller numbers alone: a
    batch that is run again replaces itself."""
    spark = batch.sparkSession
    place = F.struct(F.lit(number).cast("long").alias("batch"), F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_line").alias("line"))
    lined = batch.withColumn("_line", F.monotonically_increasing_id())  # ascends within a split
    told = cut(imported(lined).where("status <> 'rejected'").withColumn("_seq", place).drop("_file", "_block", "_line"))
    held = registered(spark, registry, number)
    if held is not None:
        near = held.join(told.select("ref_number").distinct(), "ref_number", "left_semi")
        told = told.withColumn("_new", F.lit(True)).unionByName(near.withColumn("_new", F.lit(False)))
    else:
        told = told.withColumn("_new", F.lit(True))
    kept = distinct_facts(told).where("_new").drop("_new")
    kept.write.mode("overwrite").parquet(f"{registry}/batch={number}")


def register(spark: SparkSession, folder: str, checkpoint: str, registry: str, imported: Callable[[DataFrame], DataFrame], most_files: int = 100) -> StreamingQuery:
    """Everything that the folder holds by now, batch after batch; files are taken in the order of their age."""

    def write(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, registry, imported)

    placed = pending_stream(spark, folder, most_files).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return placed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
