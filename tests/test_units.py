import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.functions.sentences import sentence_spans
from quirefold.operators import units

CASES = [
    ("“Wait...” She stopped. “What?!” He ran.", None, ["“Wait...”", "She stopped.", "“What?!”", "He ran."]),
    ("Dr. Smith met J. R. Jones at 3.14 meters. Another sentence follows.", None, 2),
    ("Dr. Smith met J. R. Jones at 3.14 meters. Another sentence follows.", [17, 20, 42, 67], 2),
    ("“Really?” she asked. Another sentence follows.", [10, 21, 46], 2),
    ("She paused ... then spoke. Another sentence follows.", None, 2),
    ("She paused . . . then spoke. Another sentence follows.", None, 2),
    ("She paused… then spoke. Another sentence follows.", None, 2),
    ("\"... because of … Y .\"", None, 1),
    ("Ä. Enchß came. B. Ro went.", None, 3),
    ("远方的商人来了。他走了！", None, 2),
    ("", None, 0), (None, None, 0), ("...", None, 1),
]


@pytest.mark.parametrize(("text", "ends", "want"), CASES)
def test_cases(text, ends, want):
    found = [t for _, t in sentence_spans(text, ends)]
    assert found == want if isinstance(want, list) else len(found) == want, found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?…”\"( 1。", max_size=40))
def test_sentences_keep_all_text_in_order(text):
    found = sentence_spans(text)
    assert "".join(t for _, t in found).replace(" ", "") == "".join(text.split())
    assert [s for s, _ in found] == sorted(s for s, _ in found)


def passage(spark, sentences):
    return spark.createDataFrame([("p", " ".join(sentences))], "id string, text string")


def words(n, end="."):
    return "W" + " w" * (n - 1) + end


@pytest.mark.parametrize(("sizes", "want"), [((16, 15, 5, 5, 5), [2, 2, 1]), ((16, 16, 5, 5, 5), [2, 2, 1]), ((16, 17, 5, 5, 5), [1, 1, 2, 1])])
def test_pairs(spark, sizes, want):
    rows = units.reading_units(units.passage_sentences(passage(spark, [words(n) for n in sizes]), ["id"]), ["id"]).orderBy("unitno").collect()
    assert [r.sentencecount for r in rows] == want
    assert " ".join(r.text for r in rows) == " ".join(words(n) for n in sizes)
    assert [r.wordcount for r in rows][0] == sizes[0] + (sizes[1] if want[0] == 2 else 0)


def test_passages_and_anchors(spark):
    blocks = spark.createDataFrame([("b", 1, "Second block here.", 4, 100, 140), ("b", 0, "First block. It goes", 3, 0, 20), ("b", 2, None, 5, 0, 0)], "id string, blockno int, text string, pageindex int, sourcestart int, sourceend int")
    p = units.passages(blocks, ["id"])
    row = p.first()
    assert row.text == "First block. It goes Second block here." and [(s.start, s.end) for s in row.segments] == [(0, 20), (21, 39)]
    u = units.reading_units(units.passage_sentences(p, ["id", "segments"]), ["id", "segments"])
    got = units.anchored(u).first()
    assert got.sourcepages == [3, 4] and got.pageindex == 3 and got.sourcestart == 0 and len(got.contexthash) == 8
    assert units.passages(blocks.limit(0), ["id"]).count() == 0
