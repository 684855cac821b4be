"""Stored tables: JSON and Parquet in and out, and the overlay of repaired navigation on stored books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.session import cut


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; what cannot be read becomes a row of nulls with the text in ``_corrupt``."""
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*own.fields]).add("_corrupt", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


BUCKETS = 256  # folders of a table of books, whatever their number


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def write_books(df: DataFrame, path: str, key: str = "bookid") -> None:
    """Put whole books: a book that is there already is replaced, the others stay. Books share folders by hash, and only folders that get a book are written again."""
    own = _bucketed(df, key)
    try:
        stored = df.sparkSession.read.parquet(path)
    except Exception as missing:  # the first books make the table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        touched = stored.join(own.select("_bucket").distinct(), "_bucket", "left_semi").join(df.select(key).distinct(), key, "left_anti")
        own = cut(own.unionByName(touched.select(own.columns)))
    own.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def delete_books(spark: SparkSession, path: str, key: str, gone: DataFrame, to: str) -> None:
    """Write the books that are not in ``gone`` to another place."""
    kept = spark.read.parquet(path).join(gone.select(key).distinct(), key, "left_anti")
    kept.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(to)


def parse_content(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with ``content``, the column's JSON read by schema, null where it is no JSON object."""
    return df.withColumn("content", F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def overlay_navigation(stored: DataFrame, repaired: DataFrame) -> DataFrame:
    """Stored books (bookid, format, revision, chapterversion, chapters) with repaired chapters where these are for the same revision and newer; never for EPUB."""
    r = repaired.select("bookid", F.col("revision").alias("_r"), F.col("chapterversion").alias("_v"), F.col("chapters").alias("_c"))
    take = F.col("_c").isNotNull() & (F.col("format") != "epub") & (F.col("_r").isNull() | F.col("_r").eqNullSafe(F.col("revision"))) & (F.coalesce("_v", F.lit(0)) > F.coalesce("chapterversion", F.lit(0)))
    joined = stored.join(r, "bookid", "left")
    return joined.withColumns({"chapters": F.when(take, F.col("_c")).otherwise(F.col("chapters")), "chapterversion": F.when(take, F.col("_v")).otherwise(F.col("chapterversion"))}).drop("_r", "_v", "_c")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one snapshot that the other lacks, counted as often as they occur, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
