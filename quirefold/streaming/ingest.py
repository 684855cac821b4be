"""Incremental ingestion: page deliveries as a stream, each page once.

The reading operators are batch operators; a stream of deliveries only has to be brought to one row per page. Pages may arrive weeks
late, so the watermark bounds the state, and ``fold`` merges each micro-batch into a table by key for what arrives later than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quirefold.sources.tables import BUCKETS


def page_stream(spark: SparkSession, folder: str, schema: StructType, late: str = "60 days") -> DataFrame:
    """Page deliveries from a folder of Parquet files; a page delivered again within ``late`` of event time is dropped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)
    return stream.withColumn("ingestedat", F.col("ingestedat").cast("timestamp")).withWatermark("ingestedat", late).dropDuplicatesWithinWatermark(["bookid", "pageindex"])


def arrivals(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Pages and books per window of arrival."""
    return stream.groupBy(F.window("ingestedat", window).alias("w")).agg(F.count("*").alias("pages"), F.approx_count_distinct("bookid").alias("books")).select(F.col("w.start").alias("since"), "pages", "books")


def fold(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's pages that the target does not have yet, the earliest of each; a batch that is run again adds nothing.

    The target's folders go by a hash of the book, and a batch reads the keys of the folders that its books are in.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("bookid", "pageindex")]
        first = F.min_by(F.struct(*rest), F.struct(F.col("ingestedat").isNull(), "ingestedat"))
        once = batch.groupBy("bookid", "pageindex").agg(first.alias("r")).select("bookid", "pageindex", "r.*").select(*batch.columns)
        once = once.withColumn("_bucket", F.pmod(F.xxhash64("bookid"), F.lit(BUCKETS)).cast("int")).persist()
        try:
            known = spark.read.parquet(target)
        except Exception as missing:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            new = once
        else:
            touched = [r["_bucket"] for r in once.select("_bucket").distinct().collect()]  # at most BUCKETS
            new = once.join(known.where(F.col("_bucket").isin(touched)).select("bookid", "pageindex"), ["bookid", "pageindex"], "left_anti")
        new.write.mode("append").partitionBy("_bucket").parquet(target)
        once.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
