import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import fit_sentences, sentences
from quirefold.llm.sentence_weights import GUESS
from quirefold.llm.sentences import page_and_unit_sentences, sentence_units, structureless, with_sentences

CASES = [
    ("“Wait...” She stopped. “What?!” He ran.", 4),
    ("Dr. Smith met J. R. Jones at 3.14 meters. Another sentence follows.", 2),
    ("“Really?” she asked. Another sentence follows.", 2),
    ("She paused ... then spoke. Another sentence follows.", 2),
    ("She paused . . . then spoke. Another sentence follows.", 2),
    ("It ended so. 55 mills stood by the river here. See Fig. 51 and pp. 7-9 now.", 3),
    ("He chose plan K. The sharp seminar measured it.", 2),
    ("T. E. Ethnikumar left a thing. It was by 8 a.m. The summer came.", 3),
    ("Nach dem Winter usw. Das Haus war am 4. Mai 1991 neu. „Der alte Müller lobte es.“ Die Bäckerin ging.", 4),
    ("“城里的医生到达了结冰的运河！”图书管理员冒着大雨喊道。老磨坊主来了。", 2),
    ("远方的商人说：“他看见了大门。他离开了。”据说如此。", 3),
    ("遠くの商人は木の階段を渡った？」と尋ねた。 やっとのことで、年老いた。", 2),
    ("船长等了很久……然后走了。他来了。", 2),
    ("«Ο κηπουρός ξέχασε τον μύλο;» ρώτησε ο έμπορος. Ποιος ήρθε; Ο άλλος· αυτός.", 3),
    ("—¿El último mercader describió? —preguntó el mercader. Cerca del río.", 2),
    ("В 1862 г. тихий садовник описал мост, и т. д. Тихий сад. «Городской архив пересёк ворота». Дальний.", 4),
    ("« Le marchand étranger loua la clé ! » s’écria la jeune fille. Il partit.", 2),
    ("من رأى المفتاح الضائع؟ الطحان عبر الجسر؛ ثم ذهب. «البستاني نسي!» قال التاجر.", 3),
    ("ነጋዴው ረሳ! ትንሹ መንደር ጠገነ። ማን ረሳ?", 3),
    ("बूढ़ा पार करता था। “वह गया!” पुराना व्यापारी ने कहा। कौन आया?", 3),
    ("ชาวบ้านเห็นประตูทอง ครูสาวลืม 38 ครั้งแล้ว “หมอละทิ้งสวน” คนสวนซ่อมสะพาน", 4),
    ("She left the house.The man came. It is at www.Method.Example/x.html today.", 3),
    ("A house (see p. 4). (He saw it all.) Then he left; she did too.", 3),
    ("Figure 38. The seminar at Skanibrebury", 1),
    ("8 See Pelthavaéa, a weary debt, p. 392.", 1),
    ("Memory, Staircase and Fountain in the Private Silk. Part 3", 1),
]


@pytest.mark.parametrize(("text", "n"), CASES)
def test_cases(text, n):
    assert [text[a:b] for a, b in sentence_units(text)].__len__() == n, [text[a:b] for a, b in sentence_units(text)]


def test_blocks_wraps_and_edges():
    text = "  HEAD OF PAGE\n\nOne line\nwraps here. Second​ \n\n \n- 4 -​\n"
    assert [text[a:b] for a, b in sentence_units(text)] == ["HEAD OF PAGE", "One line\nwraps here.", "Second", "- 4 -"]
    assert sentence_units(None) == [] and sentence_units("") == [] and sentence_units("​ \n") == []


def test_structureless():
    assert structureless("Quiet Loom of Ostnirix and Corthabreth") and structureless("Chapter 1: A Proof") and structureless("[12]")
    assert not structureless("Der Händler verließ die Bücherei. Die Bäckerin ging in das Haus und")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA. !?\n“”\"«»;。！。กข1", max_size=60))
def test_units_tile_the_visible_text(text):
    units = sentence_units(text)
    last = 0
    for a, b in units:
        assert last <= a < b <= len(text)
        assert not text[last:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        last = b
    assert not text[last:].strip()


def test_long_text_is_processed_whole():
    text = "The mill stood by the river and waited. " * 20_000
    assert len(sentence_units(text)) == 20_000


def test_tables(spark):
    pages = spark.createDataFrame([("b", 0, "One. Two."), ("b", 0, "One. Two."), ("b", 1, None), ("b", 2, "")], "bookid string, pageindex int, text string")
    units = spark.createDataFrame([("b", [("He left. She stayed.", 4, (0,)), (None, 1, (0,))]), ("c", None)], "bookid string, readingunits array<struct<text:string,wordcount:int,anchor:struct<pageindex:int>>>")
    rows = sorted(map(tuple, page_and_unit_sentences(pages, units).collect()))
    assert rows == [("page", "b", 0, 0, 4), ("page", "b", 0, 5, 9), ("unit", "b", 0, 0, 8), ("unit", "b", 0, 9, 20)]
    assert page_and_unit_sentences(pages.limit(0), units.limit(0)).count() == 0
    clash = spark.createDataFrame([(7, "He left. She ran.", 3)], "sentno long, text string, sentstart int")
    assert with_sentences(clash, ["sentno"], "text").count() == 2


def tilings(ends):
    if len(ends) == 1:
        yield []
        return
    for j in range(1, len(ends)):
        for rest in tilings(ends[j:]):
            yield [(ends[0], ends[j]), *rest]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Dr. ", "A. ", "he said. ", "“Go! ", "Now?” ", "etc. ", "The end. ", "4. ", "May ", "x.Y "]), min_size=1, max_size=8))
def test_programme_against_all_tilings(parts):
    text = "".join(parts).strip()
    places = sentences.candidates(text)
    scores = sentences.SCORES
    at = {p: scores.at(close, open_) for p, close, open_ in places}

    def worth(spans):
        depth = dict(zip([0, *(b for _, b in spans)], sentences._balance(text, [0, *(b for _, b in spans)])))
        total = 0.0
        for a, b in spans:
            total += at.get(b, (0.0, 0.0))[0] + at.get(a, (0.0, 0.0))[1] + scores.lengths[sentences.length_of(b - a)] + scores.balance[sentences.balance_of(depth[a], depth[b])]
            total -= 20.0 * (not sentences.BREAKS_LEFT.search(text, a, b))
        return total

    best = max(worth(t) for t in tilings([0, *(p for p, *_ in places), len(text)]))
    assert abs(worth(sentences.best_spans(text, places, scores)) - best) < 1e-9


def test_weights_are_learned():
    text = "小村庄的人们等了很久……然后画下了它。他来了。"
    places = sentences.candidates(text)
    gold = [(0, 19), (19, 23)]
    assert text[:19].endswith("它。") and len(text) == 23
    learned = fit_sentences.learn([(text, places, gold)] * 20, GUESS)
    assert fit_sentences.wrong([(text, places, gold)], GUESS)[0] == 1 and fit_sentences.wrong([(text, places, gold)], learned)[0] == 0
