"""Pending reports as partitions of one Parquet table, one partition per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_report(report: DataFrame, path: str, report_id: str, filename: str, uploaded_at: Column) -> None:
    """Write (or replace) the report's partition; other reports stay untouched."""
    (
        report.withColumns(
            {
                "report_id": F.lit(report_id),
                "excel_filename": F.lit(filename),
                "uploaded_at": uploaded_at.cast("timestamp"),
            }
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_id")
        .parquet(path)
    )


def load_report(spark: SparkSession, path: str, report_id: str | None = None) -> DataFrame:
    """One report, or the latest uploaded one. Both are partition-pruned reads."""
    table = spark.read.parquet(path)
    if report_id is None:
        latest = table.groupBy("report_id").agg(F.max("uploaded_at").alias("at")).orderBy(
            F.desc("at"), F.desc("report_id")
        ).first()
        if latest is None:
            return table
        report_id = latest["report_id"]
    return table.filter(F.col("report_id") == report_id)


def clear_report(spark: SparkSession, path: str, report_id: str) -> None:
    """Remove one report's partition through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/report_id={report_id}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
