from quirefold.operators import layout, repairs

SPAN = "bookid string, pageindex int, spanindex int, text string, sourcestart int, sourceend int, lineindex int, bounds struct<x:double,y:double,width:double,height:double>, fontname string, fontsize double, bold boolean, italic boolean, color string"
PAGE = "bookid string, pageindex int, label string, width double, height double, rotation int, text string, ingestedat timestamp"


def span(page, n, line, text, x=68.0, y=None, size=11.0, bold=False, width=None):
    y = 80.0 + 18 * line if y is None else y
    return ("b", page, n, text, 100 * n, 100 * n + len(text), line, (x, y, min(480.0, 0.48 * len(text) * size) if width is None else width, 1.15 * size), "F", size, bold, False, None)


def book(spark, spans, texts=None, n=None):
    indices = sorted({s[1] for s in spans} | set(texts or {}) | set(range(n or 0)))
    pages = spark.createDataFrame([("b", i, None, 612.0, 792.0, 0, (texts or {}).get(i, ""), None) for i in indices], PAGE)
    own = layout.pages_of(pages)
    return own, layout.page_lines(own, spark.createDataFrame(spans, SPAN))


def test_runs_gaps_and_gutters(spark):
    spans = [span(0, 0, 0, "Small "), span(0, 1, 0, "caps", x=68 + 0.48 * 6 * 11), span(0, 2, 1, "left", width=30.0), span(0, 3, 1, "right", x=400.0)]
    rows = book(spark, spans)[1].orderBy("lineno").collect()
    assert [r.text for r in rows] == ["Small caps", "left", "right"] and [r.piece for r in rows] == [0, 0, 1]


def test_columns_are_read_one_after_the_other(spark):
    spans = []
    for i in range(6):
        spans += [span(0, 2 * i, i, f"left {i} words", x=60.0, width=180.0), span(0, 2 * i + 1, i, f"right {i} words", x=330.0, width=180.0)]
    rows = book(spark, spans)[1].orderBy("lineno").collect()
    assert [r.text for r in rows] == [f"left {i} words" for i in range(6)] + [f"right {i} words" for i in range(6)]


def test_pages_without_spans_use_their_text(spark):
    pages, lines = book(spark, [span(1, 0, 0, "spanned")], {0: "first line\r\nsecond line\n" + "\n".join(f"l{i}" for i in range(60)), 1: "ignored"})
    rows = lines.where("pageindex = 0").orderBy("lineno").collect()
    assert rows[0].text == "first line" and rows[1].sourcestart == 11 and len(rows) == 62 and max(r.y for r in rows) < 792
    assert lines.where("pageindex = 1").first().text == "spanned"


def test_running_lines_and_blocks(spark):
    spans = []
    for p in range(6):
        spans += [span(p, 0, 0, "A RELIABLE BOOK", y=40.0), span(p, 1, 3, f"Prose number {p} that is long enough to be the body of"), span(p, 2, 4, "the page and goes on here."), span(p, 3, 39, str(p + 1), y=750.0)]
    spans += [span(6, 0, 2, "Chapter One", size=18.0, bold=True), span(6, 1, 8, "A note of small size", y=710.0, size=7.0), span(6, 2, 10, "Figure 3. A mill", y=300.0)]
    pages, lines = book(spark, spans)
    clusters = {(r.band, r.key): r for r in layout.running_clusters(lines, pages).collect()}
    assert clusters["top", "a reliable book"].removed and clusters["bottom", "#"].removed
    kept = layout.without_running(lines, layout.running_clusters(lines, pages))
    assert kept.where("text = 'A RELIABLE BOOK'").count() == 0
    assert layout.body_sizes(kept).first().bodysize == 11.0
    found = layout.blocks(kept, layout.body_sizes(kept)).orderBy("pageindex", "blockno").collect()
    assert found[0].text == "Prose number 0 that is long enough to be the body of the page and goes on here." and found[0].kind == "prose"
    assert {r.kind for r in found if r.pageindex == 6} == {"heading", "footnote", "caption"}
    assert next(r for r in found if r.kind == "heading").confidence == 0.89
    units = spark.createDataFrame([("b", 4, 5), ("b", 6, 9)], "bookid string, pageindex int, unitno int")
    assert {r.unitno for r in repairs.supplements(layout.blocks(kept, layout.body_sizes(kept)), units).collect()} == {9}


def test_empty_tables(spark):
    pages, lines = book(spark, [span(0, 0, 0, "x")])
    empty = lines.limit(0)
    assert layout.running_clusters(empty, pages.limit(0)).count() == 0 and layout.blocks(empty, layout.body_sizes(empty)).count() == 0


def test_dots_and_glyphs(spark):
    row = lambda t: {"text": t, "sourcestart": 0}
    assert [r["text"] for r in repairs.joined_dots([row("."), row(".."), row("then he left"), row("End.")])] == [". .. then he left", "End."]
    glyphs = [("b", 0, i, c, 10.0 + 5 * i + (20 if i >= 3 else 0), 50.0 + (i % 2), 5.0, 10.0, "F" if i < 5 else "G", 10.0) for i, c in enumerate("abcdef")] + [("b", 0, 9, "z", 10.0, 80.0, 5.0, 10.0, "F", 10.0)]
    df = spark.createDataFrame(glyphs, "bookid string, pageindex int, glyphno int, char string, x double, y double, width double, height double, fontname string, fontsize double")
    assert [(r.lineindex, r.text) for r in repairs.glyph_runs(df).orderBy("lineindex", "runno").collect()] == [(0, "abc"), (0, "de"), (0, "f"), (1, "z")]


def test_nested_blocks_and_twins(spark):
    df = spark.createDataFrame([("f", i, k, t) for i, (k, t) in enumerate([("prose", "one two"), ("prose", "two"), ("heading", "H"), ("heading", "H"), ("prose", "two")])], "file string, blockno int, kind string, text string")
    assert [r.text for r in repairs.distinct_nested(df).orderBy("blockno").collect()] == ["one two", "H", "two"]
    chapters = spark.createDataFrame([("b", 0, 3, "Chapter 1: The Mill", "chapter"), ("b", 1, 3, "Chapter 1", "chapter"), ("b", 2, 3, "Part One", "part"), ("b", 3, 4, "Chapter 1", "chapter")], "bookid string, chapterno int, pageindex int, title string, kind string")
    assert [r.chapterno for r in repairs.without_prefix_twins(chapters).orderBy("chapterno").collect()] == [0, 2, 3]
    outline = spark.createDataFrame([("b", "Chapter 1"), ("b", "Chapter 2")], "bookid string, title string")
    assert [r.chapterno for r in repairs.only_known_families(chapters, outline).orderBy("chapterno").collect()] == [0, 1, 3]
    assert repairs.only_known_families(chapters, outline.limit(1)).count() == 4
