from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.pieces import oversized_pieces, pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,é字", max_size=300), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, overlap):
    found = pieces(text, limit, overlap)
    if not text:
        assert found == []
        return
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in found)
    for (_, end, _), (start, _, _) in zip(found, found[1:]):
        assert start == end - overlap
    rebuilt = text[: found[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(found, found[1:]))
    assert rebuilt == text


def test_levels():
    text = "First part here.\n\nSecond part is here. It has more, and more words still in it."
    assert [text[a:b] for a, b, _ in pieces(text, 45, 0)][0] == "First part here.\n\n"
    assert pieces("word " * 20, 23, 0)[0][2] == "word"
    assert pieces("字" * 50, 20, 5)[0] == (0, 20, "character")
    assert pieces("One is here. Two is here. Three.", 28, 0)[0][2] == "sentence"
    assert pieces("short", 10, 2) == [(0, 5, "whole")]
    assert pieces(None, 10, 2) == []


def test_marks_stay_with_their_letter():
    found = pieces("e\u0301" * 40, 21, 0)
    assert all((b - a) % 2 == 0 for a, b, _ in found)


def test_tables(spark):
    unit = "array<struct<text:string,wordcount:int,anchor:struct<pageindex:int>>>"
    block = "array<struct<text:string,kind:string,pageindex:int>>"
    predictions = spark.createDataFrame([("b", [("word " * 60, 60, (0,)), (None, 0, (0,)), ("short", 1, (1,))], 5), ("b", [("word " * 60, 60, (0,)), (None, 0, (0,)), ("short", 1, (1,))], 5), ("c", None, 5)], f"bookid string, readingunits {unit}, maxsize int")
    annotations = spark.createDataFrame([("b", [("x" * 1201, "prose", 0), ("x" * 1200, "prose", 0)]), ("c", [])], f"bookid string, blocks {block}")
    limits = spark.createDataFrame([("reading_unit", 240, 40), ("block", 1200, 120)], "itemkind string, maxsize int, overlap int")
    rows = oversized_pieces(predictions, annotations, limits).collect()
    assert sorted({(r.itemkind, r.bookid, r.itemno) for r in rows}) == [("block", "b", 0), ("reading_unit", "b", 0)]
    assert [(r.piecestart, r.pieceend) for r in sorted((r for r in rows if r.itemkind == "block"), key=lambda r: r.pieceno)] == [(0, 1200), (1080, 1201)]
    assert oversized_pieces(predictions.limit(0), annotations.limit(0), limits).count() == 0


def test_pieces_are_filled():
    text = "x" * 205 + "\n\n" + "A sentence of some length stands here. " * 60
    found = pieces(text, 1000, 200)
    assert all((b - a) * 3 >= 1000 for a, b, _ in found[:-1]) and all(name in ("section", "sentence") for *_, name in found[:-1])
