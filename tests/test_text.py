import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import titles as N


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "line"), [("  a­b​  c d\x00e ", "ab c d e"), ("", ""), (None, None)])
def test_clean_line(spark, text, line):
    assert one(spark, T.clean_line, text) == line


def test_keys(spark):
    assert one(spark, T.key, "Ｔhe “Größe” – Nr. 5_b") == "the größe nr 5 b"
    assert one(spark, T.word_key, "Größe: a_b—C") == "grösse a_b c"
    assert one(spark, T.furniture_key, "page 12 of mild vivid xi prose") == "# of # # # prose"
    assert one(spark, T.furniture_key, "élix 12 of 30") == "é# #"


def test_headings(spark):
    assert one(spark, T.clean_heading, "The Mill ..... 41") == "The Mill"
    assert one(spark, T.navigation_title, "C H A P T E R 1 2") == "CHAPTER 12"
    kind = lambda t: one(spark, lambda c: T.title_kind(c)["kind"], t)
    assert [kind(t) for t in ("Chapter Two: X", "PART IV", "Table of Contents", "Endnotes to chapter three", "The mill", "Acknowledgements")] == ["chapter", "part", "contents", "notes", None, "acknowledgments"]
    for t in ("Chapter Two: X", "PART IV", "Table of Contents", "The mill", "Subject Index", "Books by A"):
        assert (N.title_kind(t) or (None,))[0] == kind(t)


def test_flags(spark):
    assert [one(spark, T.is_page_number, t) for t in ("12", "page xii", "Page 3 of 9", "12 apples")] == [True, True, True, False]
    assert [one(spark, T.looks_tabular, t) for t in ("a  b  c", "a | b | c", "Row 1 2.5 3", "plain text here")] == [True, True, True, False]
    assert [one(spark, T.is_plausible_title, t) for t in ("The Mill", "untitled", "x.pdf", "It ends. So", "ab")] == [True, False, False, False, False]
    assert [one(spark, T.looks_capitalised, t) for t in ("The Old Mill", "the old mill", "42")] == [True, False, False]
    assert one(spark, T.count_words, " a b\tc ") == 3 and one(spark, T.count_words, "") == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBc é.-12", max_size=14), st.text(alphabet="aBc é.-12", max_size=14))
def test_similarity_is_symmetric_and_bounded(a, b):
    assert N.similarity(a, b) == pytest.approx(N.similarity(b, a)) and 0 <= N.similarity(a, b) <= 1


def test_similarities_agree(spark):
    pairs = [("The Old Mill", "the old mill!"), ("Old Mill", "The Old Mill Again"), ("a b c", "c d e"), ("", "x"), ("x y", "z")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.title_similarity(F.col("a"), F.col("b")).alias("s"), T.word_similarity(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r.s for r in rows] == pytest.approx([N.similarity(a, b) for a, b in pairs])
    assert [round(r.w, 4) for r in rows] == [1.0, 0.6667, 0.3333, 0.0, 0.0]


def test_join_hash_and_ids(spark):
    assert one(spark, T.join_lines, ["The garde-", "ner came", "", " in-", "Deed"], "array<string>") == "The gardener came in- Deed"
    assert one(spark, T.context_hash, "") == "811c9dc5" and one(spark, T.context_hash, "a") == "e40c292c"
    assert one(spark, lambda c: T.stable_id(c, F.lit(""), F.lit("Größe")), "Oapen") == __import__("hashlib").sha256("oapen\x1fgrösse".encode()).hexdigest()[:20]
    assert [one(spark, T.page_tier, n, "int") for n in (149, 150, 350, 351, None)] == ["short", "medium", "medium", "long", None]
    assert one(spark, T.strip_extension, "a.b.pdf") == "a.b" and one(spark, T.file_name, "file:///x/My%20Book+1.pdf?q#f") == "My Book+1.pdf"
    assert one(spark, T.context_grams, "a b c d") == ["a b c", "b c d"] and one(spark, T.context_grams, "a b") == ["a", "b"]
    assert [one(spark, T.half_up, x, "double") for x in (0.5, -0.5, 1.4)] == [1, 0, 1]
    assert one(spark, lambda c: T.clamp(c, F.lit(0), F.lit(5)), float("nan"), "double") == 0
