"""Stock files arriving in a folder, each diffed as its own snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotledger.operators.diff import stock_diff
from lotledger.sources.stock import stock_rows

STOCK_SCHEMA = (
    "ord long, model_code string, aed_price string, product_description string, stock_id string, "
    "exterior_color string, interior_color string, available string"
)


def start_stock_feed(
    spark: SparkSession, source: str, reports: str, checkpoint: str, listings: Callable[[], DataFrame], fmt: str = "json"
) -> StreamingQuery:
    """Diff every file against the listings as of its batch: one file is one batch.

    Reports land in ``reports/report_id=<batch>``; a replayed batch replaces its
    own partition, so the sink is idempotent.
    """

    def diff_batch(batch: DataFrame, batch_id: int) -> None:
        (
            stock_diff(stock_rows(batch, "ord"), listings())
            .withColumn("report_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("report_id")
            .parquet(reports)
        )

    return (
        spark.readStream.schema(STOCK_SCHEMA).option("maxFilesPerTrigger", 1).format(fmt).load(source)
        .writeStream.foreachBatch(diff_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
