"""An extension: pages that arrive as files are corrected as they come, each batch of pages by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldledger.operators.correction import correct_page

LINES = "batch_id string, page_no long, row_index long, survey_raw string, meter_raw string, remarks_raw string"


def stream_pages(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True):
    """Corrects whole pages (a file holds whole pages) and appends them as Parquet, exactly once for each micro-batch."""

    def correct(batch: DataFrame, number: int) -> None:
        correct_page(batch).write.mode("overwrite").parquet(f"{target}/micro={number}")

    writer = spark.readStream.schema(LINES).parquet(folder).writeStream.foreachBatch(correct).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
