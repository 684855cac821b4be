from quirefold.streaming import ingest

PAGE = "bookid string, pageindex int, text string, ingestedat timestamp"


def test_deliveries_are_folded_once(spark, tmp_path):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 0, "x", day(0)), ("a", 0, "x", day(3)), ("a", 1, "y", day(1))], PAGE).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest.fold(ingest.page_stream(spark, source, schema), target, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("a", 0, "x", day(30)), ("b", 0, "z", day(31))], PAGE).coalesce(1).write.mode("append").parquet(source)
    ingest.fold(ingest.page_stream(spark, source, schema), target, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.bookid, r.pageindex) for r in spark.read.parquet(target).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    counts = ingest.arrivals(ingest.page_stream(spark, source, schema)).writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert sum(r.pages for r in spark.table("arrived").collect()) == 3
