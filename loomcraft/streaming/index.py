"""The example index, fed by results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsons import salvaged
from ..operators.binding import bind
from ..operators.cell_index import CellIndex


def follow_results(
    spark: SparkSession, results_path: str, schema: str, index_path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Stream result files (``source, completion``) into the index; replies without usable JSON go aside.

    Every batch is read once, writes its own folder and overwrites it, so a batch that is run again after a failure
    leaves the same files. There is no state to keep. ``once`` takes what is there and stops."""
    arriving = spark.readStream.schema(schema).parquet(results_path)

    def store(batch: DataFrame, batch_id: int) -> None:
        read = bind(batch, content=salvaged("completion"))
        kept = read.select(
            "source", F.lit(1).alias("seq_num"), "content",
            F.when(F.col("content").isNull(), F.col("completion")).alias("completion"),
            F.col("content").isNotNull().alias("usable"),
        )
        kept.write.mode("overwrite").partitionBy("usable").parquet(f"{index_path}/batch_id={batch_id}")

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow_examples(
    spark: SparkSession, results_path: str, schema: str, index: CellIndex, checkpoint: str, name: str = "results",
    files_per_batch: int | None = None, once: bool = True,
) -> StreamingQuery:
    """Stream result files (``id, completion, embedding``) into an index that tasks search for examples, so what was generated
    becomes an example. Replies without usable JSON are left out. ``content`` is the payload, further payload columns come by name.

    A batch is added under ``name`` and its number: one that is run again after a failure is added once."""
    arriving = spark.readStream.schema(schema)
    if files_per_batch:
        arriving = arriving.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        read = bind(batch, content=salvaged("completion"))
        index.add(f"{name}-{batch_id}", read.filter(F.col("content").isNotNull()))

    writer = arriving.parquet(results_path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def example_index(spark: SparkSession, index_path: str, seeds: DataFrame | None = None) -> DataFrame:
    """The index: seed examples and everything streamed in, each source once, the earliest entry."""
    streamed = spark.read.parquet(index_path).filter(F.col("usable") == "true").select("source", "seq_num", "content", "batch_id")
    if seeds is not None:
        streamed = seeds.select("source", "seq_num", "content", F.lit(-1).alias("batch_id")).unionByName(streamed)
    return streamed.groupBy("source").agg(F.min_by(F.struct("seq_num", "content"), "batch_id").alias("e")).select(
        "source", "e.seq_num", "e.content")


def rejects(spark: SparkSession, index_path: str) -> DataFrame:
    """Results that could not be used, for the log."""
    return spark.read.parquet(index_path).filter(F.col("usable") == "false").select("source", "completion")
