import random

from quirefold.operators import layout, navigation, repairs, units
from quirefold.plans import catalog

BLOCK = "bookid string, pageindex int, blockno int, kind string, text string, sourcestart int, sourceend int"
SECTION = "bookid string, sectionno int, title string, kind string, pageindex int, blockno int, accepted boolean"


def parsed(spark):
    texts = [(0, 0, "prose", "Before all."), (1, 0, "heading", "Chapter One"), (1, 1, "prose", "It was late. He left."), (2, 0, "prose", "It rained on"), (3, 0, "prose", "and on."), (3, 1, "caption", "Figure 1. A mill"), (3, 2, "heading", "Notes"), (3, 3, "prose", "See the mill."), (4, 0, "footnote", "1 Small print."), (6, 0, "caption", "Figure 2. A lamp")]
    blocks = spark.createDataFrame([("b", p, n, k, t, 0, len(t)) for p, n, k, t in texts], BLOCK)
    sections = spark.createDataFrame([("b", 0, "Chapter One", "chapter", 1, 0, True), ("b", 1, "Notes", "notes", 3, 2, True), ("b", None, "Unsure", "chapter", 2, 0, False), ("b", 2, "Index", "index", 6, 0, True)], SECTION)
    placed = navigation.assign_sections(blocks, sections)
    return placed, sections


def test_sections_are_assigned_and_references_found(spark):
    rows = {(r.pageindex, r.blockno): r for r in parsed(spark)[0].collect()}
    assert [rows[p, n].sectionno for p, n in sorted(rows)] == [None, 0, 0, 0, 0, 0, 1, 1, 1, 2]
    assert {k for k, r in rows.items() if r.kind == "reference"} == {(3, 3)} and rows[1, 1].kind == "prose"


def test_supplements_look_in_their_own_section_first(spark):
    placed, _ = parsed(spark)
    own = spark.createDataFrame([("b", 0, 1, 0, [1]), ("b", 1, 2, 0, [2]), ("b", 2, 3, 1, [3, 4])], "bookid string, unitno int, pageindex int, sectionno int, sourcepages array<int>")
    found = {(r.pageindex, r.blockno): (r.kind, r.unitno) for r in repairs.supplements(placed, own).collect()}
    # The caption on page 3 lies in the chapter, whose last unit is on page 2; the one in the index, which has no units, goes by the whole book.
    assert found == {(3, 1): ("caption", 1), (3, 3): ("reference", 2), (4, 0): ("footnote", 2), (6, 0): ("caption", 2)}


def test_book_units_are_anchored_and_numbered_through_the_book(spark):
    assert "book_units" in catalog.QUERIES
    placed, sections = parsed(spark)
    rows = units.book_units(placed, sections).orderBy("unitno").collect()
    assert [(r.unitno, r.sectionno, r.heading) for r in rows] == [(0, 0, "Chapter One"), (1, 0, None), (2, 1, "Notes"), (3, 2, "Index")]
    assert [r.text for r in rows] == ["It was late. He left.", "It rained on and on.", "Notes See the mill. 1 Small print.", "Figure 2. A lamp"]
    assert [list(r.sourcepages) for r in rows] == [[1], [2, 3], [3, 4], [6]] and [(r.pageindex, r.sourcestart) for r in rows] == [(1, 0), (2, 0), (3, 0), (6, 0)]


def test_segments_are_met_as_anchored_finds_them(spark):
    texts = [("W" * 700 + f" word {i}.") for i in range(12)]
    blocks = spark.createDataFrame([("b", i, 0, "prose", t, 3 * i, 3 * i + 900) for i, t in enumerate(texts)], BLOCK)
    passage = units.passages(blocks, ["bookid"], "pageindex")
    own = units.reading_units(units.passage_sentences(passage, ["bookid", "segments"]), ["bookid", "segments"])
    whole = {(r.unitno, r.pageindex, r.sourcestart, tuple(r.sourcepages)) for r in units.anchored(own).collect()}
    part = units.anchored(units.with_segments(own.drop("segments"), passage, ["bookid"]))
    assert {(r.unitno, r.pageindex, r.sourcestart, tuple(r.sourcepages)) for r in part.collect()} == whole and len(whole) == 6


LINE = "bookid string, pageindex int, lineno int, text string, sourcestart int, sourceend int, x double, y double, width double, height double, pagewidth double, pageheight double, fontsize double, bold boolean, centered boolean"


def lines_of(spark, pages):
    return spark.createDataFrame([("b", p, n, t, 100 * n, 100 * n + len(t), 68.0 + n, 200.0 + 12 * n, 5.0 * len(t), 12.0, 612.0, 792.0, 11.0, False, False) for p, texts in enumerate(pages) for n, t in enumerate(texts)], LINE)


def test_blocks_keep_an_ellipsis_with_its_prose(spark):
    lines = lines_of(spark, [["It was late and", ".", "..", "then he left the mill.", "End of it."]])
    rows = layout.blocks(lines, layout.body_sizes(lines)).collect()
    assert [(r.kind, r.text) for r in rows] == [("prose", "It was late and . .. then he left the mill. End of it.")]


def test_joined_dots_agree_with_the_list_form(spark):
    draw = random.Random(3)
    pages = [[draw.choice([".", "..", "“.", "a", "... b", "'..", "End."]) for _ in range(draw.randrange(1, 9))] for _ in range(60)]
    rows = layout.joined_dots(lines_of(spark, pages)).orderBy("pageindex", "lineno").collect()
    for p, texts in enumerate(pages):
        want = repairs.joined_dots([{"text": t, "sourcestart": 100 * n} for n, t in enumerate(texts)])
        assert [(r.text, r.sourcestart) for r in rows if r.pageindex == p] == [(w["text"], w["sourcestart"]) for w in want], texts
    first = layout.joined_dots(lines_of(spark, [[".", "..", "then"]])).first()
    assert (first.x, first.y, first.width, first.height) == (68.0, 200.0, 22.0, 36.0)
