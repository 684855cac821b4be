import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import progress, repairs

UNIT = "bookid string, unitno int, text string, pageindex int, readingstart int"


def test_offsets_progress_and_marks(spark):
    units = spark.createDataFrame([("b", i, "w " * n, i, 1) for i, n in enumerate((5, 2, 3, 4, 1))], UNIT)
    sections = spark.createDataFrame([("b", 0, "chapter", "A", 1), ("b", 1, "notes", "N", 3), ("b", 2, "chapter", "B", 4)], "bookid string, sectionno int, kind string, title string, startpage int")
    o = progress.word_offsets(progress.units_in_sections(units, sections))
    rows = {r.unitno: r for r in o.collect()}
    assert [rows[i].offset for i in range(5)] == [0, 0, 2, 5, 5] and rows[0].total == 6 and rows[3].sectionkind == "notes"
    f = {r.unitno: r.fraction for r in progress.progress(o).collect()}
    assert f[1] == 0 and f[2] == pytest.approx(2 / 6) and f[4] == 1.0
    chapters = spark.createDataFrame([("b", 1, "chapter"), ("b", 4, "chapter"), ("b", 3, "part")], "bookid string, unitno int, kind string")
    assert progress.chapter_marks(o, chapters).first().marks == pytest.approx([0.0, 5 / 6, 1.0])
    assert repairs.unsteady_progress(progress.progress(o)).count() == 0
    assert progress.word_offsets(progress.units_in_sections(units.limit(0), sections)).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0.0, 0, 0), (0.996, 5, 0), (1.0, 9, 0), (0.5, 3, 1)], "f double, i int, s int")
    assert [r.x for r in df.select(progress.shown_progress(F.col("f"), F.col("i"), F.col("s")).alias("x")).collect()] == ["Not started", "99% read", "Finished", "50% read"]


def test_library(spark):
    books = spark.createDataFrame([("a", None, "2024-01-02"), ("b", "2024-03-01", "2023-01-01"), ("c", None, "2024-01-02"), ("d", "2024-03-02", "2022-01-01")], "id string, lastread string, imported string")
    assert [r.id for r in progress.library_order(books).orderBy("place").collect()] == ["d", "b", "a", "c"]
    named = spark.createDataFrame([("a", "The %Mill", "x.pdf"), ("b", None, "MILL.epub"), ("c", "Other", None)], "id string, title string, filename string")
    assert [r.id for r in progress.library_search(named, " mill ").orderBy("id").collect()] == ["a", "b"]
    assert [r.id for r in progress.library_search(named, "%m").collect()] == ["a"] and progress.library_search(named, "  ").count() == 3


def test_sections(spark):
    s = spark.createDataFrame([("b", 0, 0, "part", 0), ("b", 1, 1, "chapter", 2), ("b", 2, 2, "section", 2), ("b", 3, 1, "chapter", 9), ("b", 4, 0, "part", 9)], "bookid string, sectionno int, level int, kind string, startpage int")
    parents = progress.section_parents(s).orderBy("sectionno")
    assert [r.parentno for r in parents.collect()] == [None, 0, 1, 0, None]
    last = spark.createDataFrame([("b", 20)], "bookid string, lastpage int")
    assert [r.endpage for r in progress.section_ranges(s, last).orderBy("sectionno").collect()] == [1, 2, 8, 9, 20]
    units = spark.createDataFrame([("b", 0, 2), ("b", 1, 2), ("b", 2, 3)], "bookid string, unitno int, sectionno int")
    ranges = repairs.unit_ranges(parents, units).orderBy("sectionno").collect()
    assert [(r.startunit, r.endunit) for r in ranges] == [(0, 2), (0, 1), (0, 1), (2, 2), (-1, -1)]
    assert repairs.reading_starts(repairs.unit_ranges(parents, units)).first().startunit == 0


def test_remap(spark):
    def rows(data, key):
        df = spark.createDataFrame(data, f"bookid string, {key} int, contexttext string, pageindex int, sourcestart int")
        return df.withColumns({"contexthash": T.context_hash("contexttext"), "sourcepages": F.array("pageindex")})

    old = rows([("b", 0, "the mill stood by the river", 3, 0), ("b", 1, "one two three four five six", 4, 10), ("b", 2, "the old clerk left the quiet house at noon", 6, 0), ("b", 3, "nothing of this is there", 40, 0)], "anchorid").drop("sourcepages")
    new = rows([("b", 0, "something else entirely here", 1, 0), ("b", 1, "the mill stood by the river", 9, 0), ("b", 2, "one two three", 4, 10), ("b", 3, "the old clerk left the quiet house", 6, 5)], "unitno")
    got = {r.anchorid: r for r in progress.remap(old, new).collect()}
    assert (got[0].unitno, got[0].confidence, got[0].how) == (1, 0.995, "hash")
    assert (got[1].unitno, got[1].confidence, got[1].how) == (2, 0.99, "prefix")
    assert got[2].unitno == 3 and got[2].confidence == pytest.approx(0.82 * 2 * 5 / 12 + 0.16)
    assert got[3].how == "similarity" and got[3].confidence < 0.1
    assert progress.remap(old, new.limit(0)).count() == 0


def test_quotes(spark):
    assert repairs.move_closing_quotes(["He left.", "” She stayed.", "“Open", "’", ") x"]) == ["He left.”", "She stayed.", "“Open", "’", ") x"]
    units = spark.createDataFrame([("b", i, "He left." if i % 2 == 0 else "” So.") for i in range(40)], "bookid string, unitno int, text string")
    got = [r.text for r in repairs.repaired_units(units, chunk=4).orderBy("unitno").collect()]
    assert got == repairs.move_closing_quotes([r.text for r in units.orderBy("unitno").collect()])


def test_remap_in_documents(spark):
    def rows(data, key):
        return spark.createDataFrame(data, f"bookid string, {key} int, path string, contexttext string, sourcestart int").withColumn("contexthash", T.context_hash("contexttext"))

    old = rows([("b", 0, "a.x", "the mill stood here", 50), ("b", 1, "a.x", "one two three four", 7), ("b", 2, "a.x", "the clerk left the house at noon", 90), ("b", 3, "gone.x", "a lamp burned in the tower", 0), ("b", 4, "a.x", "nothing alike", 1000)], "anchorid")
    new = rows([("b", 0, "c.x", "the mill stood here", 50), ("b", 1, "a.x", "the mill stood here", 10), ("b", 2, "a.x", "the mill stood here", 45), ("b", 3, "a.x", "one two three", 7), ("b", 4, "a.x", "the clerk left the house", 90), ("b", 5, "c.x", "a lamp burned in a tower", 300)], "unitno")
    got = {r.anchorid: r for r in progress.remap_in_documents(old, new).collect()}
    assert (got[0].unitno, got[0].how) == (2, "hash") and (got[1].unitno, got[1].how) == (3, "prefix")
    assert (got[2].unitno, got[2].how) == (4, "prefix") and got[3].unitno == 5 and got[3].confidence == pytest.approx(0.85 * 2 * 2 / 8)
    assert (got[4].unitno, got[4].confidence) == (1, 0.0)
    assert progress.remap_in_documents(old, new.limit(0)).count() == 0


def test_places_in_documents_are_not_broadcast(spark, tmp_path):
    """Sizes of rows that come out of arrays are not known when joins are planned; with a broadcast the words of all books would go through the driver."""
    entry = pytest.importorskip("__spark_entry__")
    docs = [(f"d{i}", "\n\n".join(f"Part {k} of {i}: the mill stood by the river {k * i}." for k in range(i + 1))) for i in range(6)] + [("n", None), ("s", "* * *\n\n* * *\n\n")]
    spark.createDataFrame(docs, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["epub_places"](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.file: (r.n_blocks, r.n_found) for r in found.collect()} == {f"d{i}.epub": (2 * i + 2, 2 * i + 2) for i in range(6)} | {"s.epub": (5, 5)}
    row = lambda no, text, at: ("b", no, "a.x", text, at, f"{hash(text)}")
    old = spark.createDataFrame([row(0, "the mill stood here", 0), row(1, "the clerk left at noon today", 20)], "bookid string, anchorid int, path string, contexttext string, sourcestart int, contexthash string")
    new = spark.createDataFrame([row(0, "the mill stood here", 0), row(1, "at last the clerk left at noon", 20)], "bookid string, unitno int, path string, contexttext string, sourcestart int, contexthash string")
    moved = progress.remap_in_documents(old, new)
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()
    assert {(r.anchorid, r.unitno, r.how) for r in moved.collect()} == {(0, 0, "hash"), (1, 1, "similarity")}


def test_chapters_on_units(spark):
    chapters = spark.createDataFrame([("b", 0, "Chapter One", 1, 1), ("b", 1, "Chapter Two", 3, 1), ("b", 2, "Chapter Three", 5, 1), ("b", 3, "Chapter Four", 6, 1), ("b", 4, "Beyond", 99, 1)], "bookid string, chapterno int, title string, pageindex int, endline int")
    text = "the quiet keeper walked along the narrow path to the lighthouse with oil and bread"
    units = spark.createDataFrame([("b", 0, "Before", 0), ("b", 1, "Still before", 1), ("b", 2, "CHAPTER ONE: it began", 1), ("b", 3, "other words", 3), ("b", 4, text, 3), ("b", 5, "only this", 5), ("b", 6, "last", 7)], "bookid string, unitno int, text string, pageindex int")
    pages = spark.createDataFrame([("b", 3, "Chapter Two\n" + text), ("b", 5, "Chapter Three\nx"), ("b", 6, "Chapter Four")], "bookid string, pageindex int, text string")
    found = progress.chapter_units(chapters, units, pages)
    assert {r.chapterno: r.unitno for r in found.collect()} == {0: 2, 1: 4, 2: 5, 3: 6}
    assert [r.title for r in progress.current_chapters(units, found).orderBy("unitno").collect()] == [None, None, "Chapter One", "Chapter One", "Chapter Two", "Chapter Three", "Chapter Four"]
