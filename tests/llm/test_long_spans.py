import re

from quirefold.llm import sentences as S
from quirefold.llm.sentence_weights import WEIGHTS


def test_a_sentence_may_span_any_number_of_candidates():
    # All ends but the last are weak, so one span is best however many there are; none is so weak that it is left out beforehand.
    text = "Names " + "word. " * 100 + "end."
    places = [(m.end(), "weak", "other") for m in re.finditer(r"\.(?= )", text)]
    scores = S.Scores(WEIGHTS | {"close weak": 2.0})
    assert len(places) == 100 and sum(scores.at("weak", "other")) + scores.slack >= 0
    assert S.best_spans(text, places, scores) == [(0, len(text))]
