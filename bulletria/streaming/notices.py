"""New bulletins as they arrive: the batch plan over each micro-batch of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import scored_notices


def incoming(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(doc_id, text): Parquet files of documents that appear in a folder."""
    return spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def write_notices(docs: DataFrame, out_dir: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score the notices of each micro-batch into out_dir/batch=N.

    A document is whole in its row, so no state is kept between batches. A batch
    that is run again after a failure overwrites its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        scored_notices(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    writer = docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
