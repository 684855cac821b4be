"""Weights of the sentence programme: cues at boundaries, length and quotations of spans.

GUESS is what they were before any gold was seen; WEIGHTS are GUESS with what ``fit_sentences`` learned, see there.
"""

from __future__ import annotations

BOUNDS = (4, 12, 40, 160, 600, 1500)
LENGTHS = ("below 4", "below 12", "below 40", "below 160", "below 600", "below 1500", "any")
QUOTES = ("even", "opened", "closed", "within")

GUESS = {
    "span": -2.5,
    **{f"close {c}": 6.0 for c in ("edge", "wide", "pause", "mark", "quoted", "stop")},
    **{f"close {c}": 5.0 for c in ("space", "number", "large number", "may end", "lettered", "single")},
    **{f"close {c}": 3.0 for c in ("gapless", "gapless pause")},
    "close bare": -2.0,
    **{f"close {c}": -4.0 for c in ("late initial", "dotted")},
    **{f"close {c}": -6.0 for c in ("initial", "counting", "counting short")},
    **{f"close {c}": -9.0 for c in ("abbreviation",)},
    **{f"close {c}": -15.0 for c in ("semicolon", "inside")},
    **{f"open {c}": -15.0 for c in ("sign", "small", "speaker")},
    "open named": -11.0,
    "open opener": 0.5,
    "close pause open uncased": -15.0,
    "close number open month": -14.0,
    **{f"close {c} open digit": -14.0 for c in ("may end", "single")},
    **{f"close {c} open digit": -3.0 for c in ("initial", "late initial", "counting", "counting short")},
    "close lettered open digit": -14.0,
    **{f"close late initial open {c}": 8.5 for c in ("opener",)},
    "close dotted open opener": 6.5,
    **{f"close counting open {c}": 10.0 for c in ("capital", "opener")},
    **{f"length {b}": 0.0 for b in LENGTHS},
    "length below 4": -0.5,
    "length any": -1.0,
    **{f"quotes {b}": -0.3 for b in QUOTES},
    "quotes even": 0.0,
}

LEARNED = {
    "close gapless pause": 2.54,
    "close gapless pause open uncased": -0.46,
    "length below 12": -0.46,
    "open uncased": -0.46,
}
WEIGHTS = GUESS | LEARNED
