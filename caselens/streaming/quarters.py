"""An extension: quarters that arrive as files are taken up as a stream.

Late versions of a case supersede earlier ones when marts are built, so a stream only has to
append: each micro-batch replaces the partitions of the quarters that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.functions import dates


def report_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet drops of reports, by file, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def quarterly_counts(stream: DataFrame, time: str = "fda_date", late: str = "120 days") -> DataFrame:
    """Reports of each day and term, with the day's quarter, as a running count. Days are
    windows of event time, so the watermark closes them: in append and update mode reports
    later than `late` behind the newest are left out, and a closed day's state goes; quarters
    are sums of their days. Complete mode keeps all state, as everywhere."""
    day = F.window(F.col(time), "1 day")
    t = stream.withWatermark(time, late).groupBy(day.alias("day"), "term").agg(F.count("*").alias("reports"))
    return t.select(F.col("day.start").alias("day"), dates.quarter_label(F.col("day.start")).alias("quarter"), "term", "reports")


def into_silver(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends drops by year and quarter, each file once: the checkpoint names those done, and
    a batch that is run again replaces its own part alone."""

    def put(batch: DataFrame, number: int) -> None:
        t = batch.withColumns({"year": F.year("fda_date"), "quarter": F.concat(F.lit("Q"), F.quarter("fda_date").cast("string")), "batch": F.lit(number)})
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter", "batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
