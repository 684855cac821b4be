import pytest
from pyspark.sql import functions as F

from quirefold.operators import inventory, progress, repairs
from quirefold.sources import tables


def test_selection_and_counts(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", None)], "id string, split string")
    ids = spark.createDataFrame([("a",), ("a",), ("d",), (None,)], "id string")
    assert {r.id for r in inventory.selected(records, ids, "x").collect()} == {"a"} and inventory.selected(records).count() == 4
    rows = spark.createDataFrame([("b1", 1), ("b1", 1), ("b1", 2), ("b2", None)], "bookid string, n int")
    got = {r.bookid: (r.n_p, r.n_q) for r in inventory.counts_by_book({"p": (rows, ["n"]), "q": (rows.where("bookid = 'b1'"), ["n"])}).collect()}
    assert got == {"b1": (2, 2), "b2": (1, 0)}
    assert inventory.counts_by_book({"p": (rows.limit(0), ["n"])}).count() == 0


def test_multimap(spark):
    pairs = [("dc.id.DOI", "10.1/x"), ("DC.id.isbn ", " 97 "), ("dc.id.isbn", "97"), ("dc.idx", "no"), ("dc.name", ""), (None, "v"), ("dc.name", "N")]
    df = spark.createDataFrame([(pairs,), ([],)], "e array<struct<key:string,value:string>>").select(inventory.multimap(F.col("e")).alias("m"))
    rows = df.select(inventory.values_of(F.col("m"), "dc.id").alias("v"), inventory.first_of(F.col("m"), "missing", "dc.name").alias("f")).collect()
    assert (rows[0].v, rows[0].f) == (["10.1/x", "97"], "N") and (rows[1].v, rows[1].f) == ([], None)


def test_stratification(spark):
    kind = "id string, publisher string, subjects array<string>, pagetier string, hasoutline boolean"
    df = spark.createDataFrame([("a", "P", ["s", "t"], "short", True), ("b", " ", None, "long", None), ("c", "Q", ["s"], None, False)], kind)
    assert tuple(inventory.stratification(df, 2, 2, 2, 0.3).first()) == (2, 2, 2, pytest.approx(0.333333), "")
    assert inventory.stratification(df, 3, 2, 3, 0.3).first().missed == "n_publishers,n_tiers"
    assert inventory.stratification(df.limit(0), 1, 0, 0, 0.0).first().missed == "n_publishers,outline_share"


def test_nesting_has_no_bound(spark):
    deep = [("b", i, i) for i in range(40)] + [("b", 40, 3), ("b", 41, -2), ("c", 0, 5)]
    found = {(r.bookid, r.sectionno): r.parentno for r in progress.section_parents(spark.createDataFrame(deep, "bookid string, sectionno int, level int")).collect()}
    assert all(found["b", i] == i - 1 for i in range(1, 40)) and found["b", 0] is None and found["b", 40] == 2 and found["b", 41] is None and found["c", 0] is None
    sections = spark.createDataFrame([("b", i, i - 1 if i else None) for i in range(12)], "bookid string, sectionno int, parentno int")
    units = spark.createDataFrame([("b", 7, 11), ("b", 3, 0)], "bookid string, unitno int, sectionno int")
    ranges = {r.sectionno: (r.startunit, r.endunit) for r in repairs.unit_ranges(sections, units).collect()}
    assert ranges[0] == (3, 7) and all(ranges[i] == (7, 7) for i in range(1, 12))
    loop = spark.createDataFrame([("b", 0, 1), ("b", 1, 0)], "bookid string, sectionno int, parentno int")
    with pytest.raises(RuntimeError):
        repairs.unit_ranges(loop, units.limit(1).withColumn("sectionno", F.lit(0)), most_depth=3)


def test_books_share_folders(spark, tmp_path):
    path = str(tmp_path / "books")
    own = spark.createDataFrame([(f"b{i}", i, "old") for i in range(300)], "bookid string, n int, v string")
    tables.write_books(own, path)
    tables.write_books(spark.createDataFrame([("b7", 1, "new"), ("b7", 2, "new")], own.schema), path)
    back = tables.read_books(spark, path)
    assert back.count() == 301 and sorted((r.n, r.v) for r in back.where("bookid = 'b7'").collect()) == [(1, "new"), (2, "new")]
    tables.delete_books(spark, path, "bookid", own.where("n < 10"), str(tmp_path / "kept"))
    assert tables.read_books(spark, str(tmp_path / "kept")).count() == 290
