import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import chars

CASES = [
    ("Ｂｅｌ Ｐｒｅｓｓ", "Bel Press"), ("𝐏𝐮𝐛𝐥𝐢𝐬𝐡", "Publish"), ("ﬁnd ﬂow ﬀ", "find flow ff"), ("a​b­c﻿d⁠", "abcd"), ("x y z　w", "x y z w"),
    ("Café über", "Café über"), ("gardеn", "garden"), ("Εthdribanνen", "Ethdribanven"), ("FRΟΜ", "FROM"), ("m² – “q” … 10 ½ ！（）。「」", "m² – “q” … 10 ½ ！（）。「」"), ("А это дом", "А это дом"), ("дoм и сад", "дом и сад"),
    ("", ""), ("가나", "가나"), ("q̣̇", "q̣̇"), ("ϲlerk", "clerk"), ("ｶﾞ", "ガ"), ("कि़", "कि़"),
]


@pytest.mark.parametrize(("text", "plain"), CASES)
def test_cases(text, plain):
    out, changed = chars.plain_texts(pa.array([text]))
    assert out[0].as_py() == plain
    assert bool(changed[0]) == (text != plain)


def test_nulls_and_slices():
    whole = pa.array(["a", None, "b​", "", "é", "é"])
    out, changed = chars.plain_texts(whole.slice(1))
    assert out.to_pylist() == [None, "b", "", "é", "é"]
    assert changed.tolist() == [False, True, False, False, True]
    assert chars.plain_texts(pa.array([], pa.string()))[0].to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12), max_size=8))
def test_composition_is_nfc_and_idempotent(texts):
    out, _ = chars.plain_texts(pa.array(texts, pa.string()))
    plain = out.to_pylist()
    assert all(unicodedata.is_normalized("NFC", t) for t in plain)
    again, changed = chars.plain_texts(pa.array(plain, pa.string()))
    assert not changed.any() and again.to_pylist() == plain


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abeioụ̧́̈é ", max_size=10), max_size=6))
def test_against_unicodedata(texts):
    out, _ = chars.plain_texts(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_round_trip_of_code_points():
    texts = pa.array(["aé", "", "𝐏字", None])
    cps, starts = chars.code_points(texts)
    assert chars.to_arrow(cps, starts).to_pylist() == ["aé", "", "𝐏字", ""]
    assert np.diff(starts).tolist() == [2, 0, 2, 0]


def test_context_and_marks():
    out, _ = chars.plain_texts(pa.array(["the оf house", "Málaga Ö"]), context=True, marks=False)
    assert out.to_pylist() == ["the of house", "Malaga O"]


def test_query_rows(spark):
    spans = spark.createDataFrame([("b", 1, 1, "a​", "x"), ("b", 1, 1, "a​", "y"), ("b", 1, 2, None, "z"), ("b", 2, 1, "plain", "q")], "bookid string, pageindex int, spanindex int, text string, plain string")
    gold = spark.createDataFrame([("b", "ｘ"), ("c", None)], "bookid string, title string")
    rows = sorted(map(tuple, chars.not_plain(spans, gold).collect()))
    assert rows == [("annotation", "b", -1, -1), ("span", "b", 1, 1)]
    assert chars.not_plain(spans.limit(0), gold.limit(0)).count() == 0
    kept = chars.with_plain(spans, "text", "plain", "changed")
    assert kept.columns == ["bookid", "pageindex", "spanindex", "text", "plain", "changed"]
    assert kept.where(F.col("text").isNull()).first()["plain"] is None


def test_long_text(spark):
    text = ("wörd gardеn " * 100_000)
    out, changed = chars.plain_texts(pa.array([text]))
    assert changed[0] and out[0].as_py() == "wörd garden " * 100_000


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 6, None, "b" * 6, "", "c" * 50, "d", "e"])], names=["n", "t"])
    parts = list(chars.bounded(batch, 1, 10))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(7)) and len(parts) == 3
    assert [p.num_rows for p in chars.bounded(batch.slice(0, 0), 1, 10)] == [0]


def test_texts_of_one_line():
    out, changed = chars.plain_texts(pa.array(["Essays\nOn Chapel", "a\tb", "c"]), lines=False)
    assert out.to_pylist() == ["Essays On Chapel", "a b", "c"] and changed.tolist() == [True, True, False]
    assert not chars.plain_texts(pa.array(["a\nb"]))[1].any()
