"""Per-document text quality statistics (problem 9).

All lines of an Arrow batch are measured at once: the text is one numpy array of code points, classes of characters are
table gathers, sums over lines are differences of running sums, and words are compared by hash. A hidden Markov model
over the line statistics with the states prose, list, table and junk then labels every line (Viterbi, run for all
documents of the batch side by side), and the labels' shares of a document's visible characters say what it is made of.

The model's weights are a guess (FEATURES, STAY, START) that labelled documents correct: expectation maximisation on at most LABELLED of
them, in which the lines of a document are held to its label. The guess counts like GUESS lines, so a few labels change little.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.chars import LIMIT, bounded, code_points

STATES = ("prose", "list", "table", "junk")
STAY = 0.86  # probability that the next line has the same label, as a guess
START = (0.55, 0.2, 0.1, 0.15)
LABELLED, LABELLED_CHARS = 2000, 100_000  # labelled documents that the weights are fitted on, and how long each may be
GUESS = 300.0  # lines that the guess counts for
ROUNDS, STEPS = 6, 12  # of expectation maximisation, and of ascent in each

# Common words by language.
COMMON = """
the an of and to in was it that had not for with as on at by they he she his her from were is be or but which this have their has who what when where there been would could its all one after before behind near within more than about into over under while although if so then no we you my our do did how if also only other some such these those
der die das den dem des ein eine einen einem einer eines und in im am an auf mit ohne zu zum zur von vom war es er sie nicht aber als wie für bei nach vor aus über unter obwohl sich ist hat wer was auch um dass wird
le la les un une des du de et en au aux il elle qui que ne pas mais dans par pour sur avec sans se est était près plus selon après fois son sa ses ce cette où même
el los las una del al y con sin por para su sus que no pero se lo más según después muy como fue era es quien donde cuando
и в во на с со не но что он она они как по за из от к у без до о после несмотря а бы это его её для при же кто
ο η το οι τα του της των τον την ένα μια και με χωρίς στο στη στην στον στις από για δεν αλλά που πως ποιος κατά μετά να θα είναι ήταν σε όταν πριν πέρα νωρίς πιο
في من على إلى عن مع و ثم أو لا لم ما هذا هذه التي الذي كان كانت قد بعد قبل تحت فوق قرب خلف دون لكن حيث بين كل أن إن
में का की के को से ने पर और था थी थे है हैं यह वह एक नहीं भी ही तो कि जो बाद लिए कौन पार बिना कुछ
እና ነው ነበር በ ለ ከ ላይ ውስጥ ግን ይህ ያ አጠገብ በኋላ ጊዜ ያለ ማን ሲሆን ስለ ወደ
"""
COMMON_HAN = "的了在是不和有这那我他她们到说过后而但就也都着又与被把为上下中来去时个从据冒"
WIDE_PUNCTUATION = "。、，！？；：「」『』（）《》〈〉…—·“”‘’"
NORMAL_PUNCTUATION = ".,;:!?'\"()-’‘“”«»„–—…¿¡।॥።፣፤፥،؛؟、。，！？；：「」『』（）·"
TERMINATORS = ".!?…।॥።؟。！？;:"
CLOSERS = "”’\"'»)]」』）“ "
BULLETS = "•*-–—▪‣◦·#>"
ODD_LETTERS = "ÃÂâœž"

STUCK = np.array([ord(c) for c in ",;:!?|^~"], np.uint32)

LETTER, DIGIT, MARK, SPACE, NORMAL, SYMBOL, GONE = range(7)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    kind = np.full(LIMIT, SYMBOL, np.uint8)
    lower = np.arange(LIMIT, dtype=np.uint32)
    upper = np.zeros(LIMIT, bool)
    for cp in range(0x30000):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp < 0xE000 or cp >= 0x20000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[cp] = LETTER
            if cat in ("Lu", "Lt"):
                upper[cp] = True
            low = ch.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
        elif cat == "Nd":
            kind[cp] = DIGIT
        elif cat[0] == "M":
            kind[cp] = MARK
        elif cat[0] == "Z" or ch in "\t\r\n\x0b\x0c":
            kind[cp] = SPACE
        elif cat in ("Cf", "Cc"):
            kind[cp] = GONE
    kind[0x3400:0xA000] = kind[0xAC00:0xD7A4] = kind[0x20000:0x30000] = LETTER
    for c in NORMAL_PUNCTUATION:
        kind[ord(c)] = NORMAL
    wide = np.zeros(LIMIT, bool)  # scripts without spaces between words
    wide[0x0E00:0x0E80] = wide[0x3040:0x3100] = wide[0x3400:0xA000] = wide[0x20000:0x30000] = True
    han = np.zeros(LIMIT, bool)
    han[[ord(c) for c in COMMON_HAN]] = True
    han[0x3041:0x3097] = True  # hiragana
    han[0x0E30:0x0E50] = True  # Thai vowels and tone marks
    is_in = lambda s: np.isin(np.arange(LIMIT), [ord(c) for c in s])
    powers = np.array([pow(1_000_003, i, 2**64) for i in range(64)], np.uint64)
    out = {"kind": kind, "lower": lower, "upper": upper, "wide": wide, "han": han, "terminal": is_in(TERMINATORS), "closer": is_in(CLOSERS), "bullet": is_in(BULLETS), "odd": is_in(ODD_LETTERS), "powers": powers}
    words = COMMON.split()
    out["common"] = np.unique(np.array([_hash_one(w, powers) for w in words], np.uint64))
    return out


def _hash_one(word: str, powers: np.ndarray) -> int:
    return sum((ord(c) * int(powers[min(i, 63)])) for i, c in enumerate(word)) & (2**64 - 1)


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics of all lines, the document of each line, and how many lines each document has."""
    t = _tables()
    cps, rows = code_points(texts)
    n_docs = len(rows) - 1
    breaks = np.flatnonzero(cps == 10)
    doc_of_break = np.searchsorted(rows, breaks, side="right") - 1
    order = np.lexsort((np.concatenate([rows[:-1], breaks + 1]), np.concatenate([np.arange(n_docs), doc_of_break])))
    starts, doc = np.concatenate([rows[:-1], breaks + 1])[order], np.concatenate([np.arange(n_docs), doc_of_break])[order]
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.where(last, rows[doc + 1], np.append(starts[1:], 0) - 1)
    kind = t["kind"][cps]
    n = len(starts)
    line: dict[str, np.ndarray] = {}
    count = lambda mask: _sums(mask, starts, ends).astype(np.float64)
    line["letters"], line["digits"] = count((kind == LETTER) | (kind == MARK)), count(kind == DIGIT)
    line["normal"], line["symbols"] = count(kind == NORMAL), count(kind == SYMBOL)
    line["visible"] = line["letters"] + line["digits"] + line["normal"] + line["symbols"]
    line["upper"], line["wide"], line["han"] = count(t["upper"][cps]), count(t["wide"][cps]), count(t["han"][cps])
    line["thai"] = count((cps >= 0x0E00) & (cps < 0x0E80))
    line["latin"] = count((kind == LETTER) & (cps < 0x250))
    stuck = np.zeros(len(cps), bool)  # punctuation with a letter right behind it
    if len(cps) > 1:
        stuck[:-1] = np.isin(cps[:-1], STUCK) & (kind[1:] == LETTER)
    line["stuck"] = count(stuck)
    line["odd"] = count(t["odd"][cps])
    line["commas"], line["tabs"] = count((cps == ord(",")) | (cps == 0x3001) | (cps == 0xFF0C)), count(cps == 9)
    line["parens"], line["pipes"] = count(cps == ord("(")), count(cps == ord("|"))
    space = kind == SPACE
    gap = np.zeros(len(cps), bool)
    if len(cps) > 2:
        gap[2:] = space[2:] & space[1:-1] & space[:-2] & (cps[2:] != 10)
    line["gaps"] = count(gap)
    dots = cps == ord(".")
    line["stops"] = count(t["terminal"][cps])
    leader = np.zeros(len(cps), bool)
    if len(cps) > 4:
        leader[4:] = dots[4:] & ((dots[3:-1] & dots[2:-2] & dots[1:-3]) | (space[3:-1] & dots[2:-2] & space[1:-3] & dots[:-4]))
    line["leaders"] = count(leader)

    # Words: runs of letters, marks, digits and apostrophes inside.
    wordy = (kind == LETTER) | (kind == MARK) | (kind == DIGIT)
    inside = np.zeros(len(cps), bool)
    inside[starts[starts < len(cps)]] = True
    begins = wordy & (np.append(False, ~wordy[:-1]) | inside) if len(cps) else wordy
    at = np.flatnonzero(begins)
    word_of = np.cumsum(begins) - 1
    where = np.flatnonzero(wordy)
    place = np.minimum(where - at[word_of[where]], 63) if len(at) else where
    hashed = np.zeros(len(at), np.uint64)
    if len(at):
        parts = t["lower"][cps[where]].astype(np.uint64) * t["powers"][place]
        hashed = np.add.reduceat(parts, np.searchsorted(where, at))
    size = np.bincount(word_of[where], minlength=len(at)).astype(np.int64)
    word_line = np.searchsorted(starts, at, side="right") - 1 if len(at) else at
    # Empty lines share their start with nothing visible, so the last line with that start is the right one.
    line["words"] = np.bincount(word_line, minlength=n).astype(np.float64)
    line["common"] = np.bincount(word_line, weights=np.isin(hashed, t["common"]), minlength=n)
    line["word_chars"] = np.bincount(word_line, weights=size, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, word_line, size)
    line["longest"] = longest
    digit_word = np.zeros(len(at), bool)
    if len(at):
        digit_word = np.add.reduceat((kind[where] == DIGIT).astype(np.int64), np.searchsorted(where, at)) > 0
        mixed = digit_word & (np.add.reduceat((kind[where] == LETTER).astype(np.int64), np.searchsorted(where, at)) > 0)
        line["mixed"] = np.bincount(word_line, weights=mixed, minlength=n)
    else:
        line["mixed"] = np.zeros(n)
    line["numbers"] = np.bincount(word_line, weights=digit_word, minlength=n)
    # Two words and their neighbour: how many pairs of neighbours differ, in the line.
    follow = np.append(hashed[1:], np.uint64(0)) * np.uint64(31) + hashed if len(hashed) else hashed
    line["distinct_pairs"] = _distinct(word_line, follow, n)
    line["distinct"] = _distinct(word_line, hashed, n)
    whole = np.zeros(n, np.uint64)
    if len(at):
        np.add.at(whole, word_line, hashed * (np.arange(len(hashed), dtype=np.uint64) - np.searchsorted(word_line, word_line).astype(np.uint64) + np.uint64(1)))
    _, inverse, times = np.unique(whole * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_inverse=True, return_counts=True)
    line["times"] = np.where(line["words"] > 0, times[inverse.ravel()], 1).astype(np.float64) if n else np.zeros(0)

    # First and last visible characters.
    visible = (kind != SPACE) & (kind != GONE)
    spots = np.flatnonzero(visible)
    first = np.searchsorted(spots, starts)
    final = np.searchsorted(spots, ends) - 1
    has = final >= first
    line["bulleted"] = np.zeros(n, bool)
    line["enumerated"] = np.zeros(n, bool)
    line["ends"] = np.zeros(n, bool)
    line["ends_digit"] = np.zeros(n, bool)
    if len(spots):
        f = spots[np.minimum(first, len(spots) - 1)]
        second = cps[np.minimum(f + 1, len(cps) - 1)]
        line["bulleted"] = has & t["bullet"][cps[f]] & ((second == 32) | (second == 9) | (second == 0xA0))
        ahead = cps[np.minimum(f + 2, len(cps) - 1)]
        line["enumerated"] = has & (kind[f] == DIGIT) & (np.isin(second, [41, 46]) | (np.isin(ahead, [41, 46]) & (t["kind"][second] == DIGIT)))
        e = spots[np.maximum(final, 0)]
        for _ in range(4):
            back = has & t["closer"][cps[e]] & (e > starts)
            e = np.where(back, spots[np.maximum(np.searchsorted(spots, e) - 1, 0)], e)
        line["ends"] = has & t["terminal"][cps[e]] & (e >= starts)
        line["ends_digit"] = has & (kind[e] == DIGIT)
    line["length"] = (ends - starts).astype(np.float64)
    return line, doc, np.bincount(doc, minlength=n_docs)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if not len(group):
        return np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
    return np.bincount(g, weights=new, minlength=n)


#: What a line's statistics say for prose, list, table and junk, as a guess.
FEATURES = {
    "any": (-1.5, -0.6, -1.6, -1.4),
    "common": (7.0, 0, 0, 0),
    "five_words": (1.2, 0, 0, 0),
    "ends": (0.8, 0, 0, 0),
    "ends_any": (0, 0, -1.0, 0),
    "many_words": (0.8, 0, 0, 0),
    "commas": (-9.0, 0, 0, 0),
    "comma_list": (0, 2.2, 0, 0),
    "some_symbols": (-12.0, 0, 0, 0),
    "symbols": (0, 0, 0, 9.0),
    "many_symbols": (0, -4.0, 0, 0),
    "digits": (-6.0, 0, 0, 0),
    "structure": (-2.0, 0, 0, 0),
    "structured": (0, 0, 2.2, 0),
    "bulleted": (-2.5, 2.5, 0, 0),
    "enumerated": (0, 2.5, 0, 0),
    "short_enumerated": (-2.5, 0, 0, 0),
    "cited": (-3.0, 3.0, 0, 0),
    "index": (-3.0, 3.0, 0, 0),
    "few_letters": (-2.0, 0, 0, 0),
    "fewer_letters": (0, 0, 0, 1.5),
    "other_script": (1.5, 0, 0, 0),
    "stuck": (-8.0, 0, 0, 10.0),
    "nothing_common": (-3.5, 0, 0, 0),
    "nothing_listed": (0, 0, 0, 2.2),
    "again": (-6.0, 0, 0, 3.0),
    "little_variety": (-6.0, 0, 0, 3.5),
    "short": (0, 1.2, 0, 0),
    "leaders": (0, 2.5, 0, 0),
    "pipes": (0, 1.0, 0, 0),
    "numbers": (0, 0, 6.0, 0),
    "tabs": (0, 0, 1.2, 0),
    "gaps": (0, 0, 1.5, 0),
    "long_word": (0, 0, 0, 3.0),
    "odd": (0, 0, 0, 6.0),
    "mixed": (0, 0, 0, 3.0),
    "common_once": (0, 0, 0, -2.0),
}


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for every line, weighted by its length: what a line says grows with it, up to a point; blank lines say nothing."""
    visible, words = np.maximum(x["visible"], 1), np.maximum(x["words"], 1)
    wide = x["wide"] / np.maximum(x["letters"], 1) > 0.5
    letters, digits, symbols = x["letters"] / visible, x["digits"] / visible, x["symbols"] / visible
    common = np.where(wide, np.minimum(0.4, 2.5 * x["han"] / np.maximum(x["wide"], 1)), x["common"] / words)
    per_word = np.where(x["thai"] > 0.5 * x["wide"], 5.0, 2.0)
    amount = np.where(wide, np.maximum(x["letters"] / per_word, x["words"]), x["words"])  # words, or what they would be
    again = (x["times"] >= 3) & (x["visible"] > np.where(wide, 5, 12))
    commas = x["commas"] / np.maximum(amount, 1)
    numbers = x["numbers"] / words
    long_ = amount >= 6
    variety = np.where(long_ & ~wide, x["distinct_pairs"] / words, 1.0)
    structure = (x["tabs"] > 0) * 1.0 + (x["gaps"] > 0) + (x["leaders"] > 1)
    foreign = x["latin"] < 0.5 * x["letters"]
    nothing = (common == 0) & (amount >= 7) & ~wide & ~foreign
    f = {
        "any": np.ones(len(visible)),
        "common": np.minimum(common, 0.35),
        "five_words": amount >= 5,
        "ends": x["ends"] & (amount >= 3),
        "ends_any": x["ends"],
        "many_words": amount > 25,
        "commas": np.maximum(commas - 0.3, 0),
        "comma_list": (commas > 0.45) & long_,
        "some_symbols": np.maximum(symbols - 0.03, 0),
        "symbols": np.minimum(np.maximum(symbols - 0.08, 0), 0.4),
        "many_symbols": np.maximum(symbols - 0.1, 0),
        "digits": np.maximum(digits - 0.1, 0),
        "structure": structure,
        "structured": structure > 0,
        "bulleted": x["bulleted"],
        "enumerated": x["enumerated"],
        "short_enumerated": x["enumerated"] & (amount < 9),
        "cited": (x["parens"] >= 1) & (numbers >= 0.15) & (digits > 0.06) & (common < 0.24),
        "index": x["ends_digit"] & (~long_ | (amount <= 14) & (x["commas"] == 0) & (x["stops"] == 0)) | (digits > 0.12) & (x["commas"] >= 2) & ~(x["ends"] & (common > 0.2)),
        "few_letters": letters < 0.6,
        "fewer_letters": letters < 0.5,
        "other_script": foreign & ~wide & (common < 0.2) & (symbols < 0.02) & (digits < 0.1),
        "stuck": np.minimum(x["stuck"] / np.maximum(amount, 1), 0.5) * (x["stuck"] >= 2),
        "nothing_common": nothing,
        "nothing_listed": nothing & (commas < 0.4),
        "again": again,
        "little_variety": variety < 0.5,
        "short": ~long_ & ~x["ends"],
        "leaders": x["leaders"] > 1,
        "pipes": x["pipes"] > 0,
        "numbers": np.minimum(numbers, 0.5) * (digits > 0.15),
        "tabs": x["tabs"] >= 2,
        "gaps": x["gaps"] >= 2,
        "long_word": (x["longest"] > 34) & ~wide,
        "odd": np.minimum(x["odd"] / visible, 0.5),
        "mixed": x["mixed"] / words > 0.3,
        "common_once": (common > 0.2) & ~again,
    }
    weight = np.clip(x["visible"] / 30.0, 0.35, 2.5) * (x["visible"] > 0)
    return np.stack([f[name] * weight for name in FEATURES], 1)


class Model(NamedTuple):
    """Weights of the features for each state, and log probabilities of the steps from state to state and of the first state."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray


def guess() -> Model:
    step = np.full((4, 4), (1 - STAY) / 3)
    np.fill_diagonal(step, STAY)
    return Model(np.array(list(FEATURES.values())).T, np.log(step), np.log(np.array(START)))


def _rows_at(n_lines: np.ndarray) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """The documents by length, longest first, and the rows of their lines number ``t``."""
    offset = np.concatenate([[0], np.cumsum(n_lines)[:-1]]).astype(np.int64)
    by = np.argsort(-n_lines, kind="stable")
    lengths, offset = n_lines[by], offset[by]
    return lengths, lambda t: offset[: int(np.searchsorted(-lengths, -t, side="left"))] + t


def marginals(scores: np.ndarray, n_lines: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probability of each state for every line, the expected number of steps from state to state, and of first states."""
    lengths, rows_at = _rows_at(n_lines)
    scores = scores - scores.max(1, keepdims=True)
    likely, step = np.exp(scores), np.exp(model.step)
    ahead, behind = np.zeros_like(scores), np.ones_like(scores)
    first = rows_at(0)
    steps = np.zeros((4, 4))
    for t in range(int(lengths.max(initial=0))):
        at = rows_at(t)
        now = likely[at] * (np.exp(model.start) if t == 0 else ahead[at - 1] @ step)
        ahead[at] = now / now.sum(1, keepdims=True)
    for t in range(int(lengths.max(initial=0)) - 1, 0, -1):
        at = rows_at(t)
        back = (likely[at] * behind[at]) @ step.T
        behind[at - 1] = back / back.sum(1, keepdims=True)
        both = ahead[at - 1][:, :, None] * step[None] * (likely[at] * behind[at])[:, None, :]
        steps += (both / both.sum((1, 2), keepdims=True)).sum(0)
    found = ahead * behind
    found /= np.maximum(found.sum(1, keepdims=True), 1e-300)
    return found, steps, found[first].sum(0)


def _prose_share(state_prose: np.ndarray, visible: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(doc, weights=visible, minlength=n)
    return np.bincount(doc, weights=visible * state_prose, minlength=n) / np.maximum(total, 1)


def fit(x: dict[str, np.ndarray], doc: np.ndarray, n_lines: np.ndarray, is_prose: np.ndarray, model: Model | None = None) -> Model:
    """The model after expectation maximisation on documents that are known to be prose or not.

    A document whose lines' probabilities contradict its label gets the least bonus or malus for prose that makes them agree
    (found by halving), so its label is spread over its lines. Emissions are log-linear: a step of bounded ascent towards the
    expected states, held to the guess by GUESS; so are the steps and first states, as counts.
    """
    model = first = model or guess()
    phi, n = features(x), len(n_lines)
    kept = x["visible"] > 0
    bound = 0.5 * phi.T @ phi + GUESS * np.eye(phi.shape[1])
    for _ in range(ROUNDS):
        scores = phi @ model.weights.T
        found, steps, starts = marginals(scores, n_lines, model)
        wrong = (_prose_share(found[:, 0], x["visible"], doc, n) >= 0.5) != is_prose
        if wrong.any():
            rows = wrong[doc]
            mine, lines = np.cumsum(wrong)[doc[rows]] - 1, n_lines[wrong]
            sign = np.where(is_prose[wrong], 1.0, -1.0)
            low, high = np.zeros(len(lines)), np.full(len(lines), 16.0)
            for _ in range(8):
                middle = (low + high) / 2
                pushed = scores[rows].copy()
                pushed[:, 0] += (sign * middle)[mine]
                share = _prose_share(marginals(pushed, lines, model)[0][:, 0], x["visible"][rows], mine, len(lines))
                agrees = (share >= 0.5) == is_prose[wrong]
                low, high = np.where(agrees, low, middle), np.where(agrees, middle, high)
            scores[rows, 0] += (sign * high)[mine]
            found, steps, starts = marginals(scores, n_lines, model)
        share = np.log(found[kept].mean(0) + 1e-6) if kept.any() else np.zeros(4)
        weights = model.weights
        for _ in range(STEPS):
            logits = phi @ weights.T + share
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            up = ((found - p) * kept[:, None]).T @ phi - GUESS * (weights - first.weights)
            weights = weights + np.linalg.solve(bound, up.T).T
        steps, starts = steps + GUESS * np.exp(first.step) / 4, starts + GUESS * np.exp(first.start) / 10
        model = Model(weights, np.log(steps / steps.sum(1, keepdims=True)), np.log(starts / starts.sum()))
    return model


def fitted(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text") -> Model:
    """The model fitted on labelled rows (key, label: ``prose`` or ``other``); the guess without any.

    At most LABELLED documents of at most LABELLED_CHARS characters, picked by hash of the key; only they come to the driver.
    """
    if labels is None:
        return guess()
    sample = labels.where(F.col("label").isin("prose", "other")).select(F.col(key).alias("_k"), (F.col("label") == "prose").alias("_prose")).where(F.col("_k").isNotNull()).distinct().orderBy(F.xxhash64("_k"), "_prose").limit(LABELLED)
    own = docs.where((F.length(text) > 0) & (F.length(text) <= LABELLED_CHARS)).join(F.broadcast(sample), F.col(key) == F.col("_k")).select("_k", "_prose", F.col(text).alias("_text")).orderBy("_k", "_prose", "_text").limit(2 * LABELLED).toArrow()
    if not own.num_rows:
        return guess()
    x, doc, n_lines = measure(own.column("_text").combine_chunks())
    return fit(x, doc, n_lines, own.column("_prose").combine_chunks().to_numpy(zero_copy_only=False).astype(bool))


def viterbi(scores: np.ndarray, n_lines: np.ndarray, model: Model | None = None) -> np.ndarray:
    """The best state of every line; documents are stacked in ``scores`` with ``n_lines`` rows each."""
    model = model or guess()
    lengths, rows_at = _rows_at(n_lines)
    back = np.zeros((len(scores), 4), np.int8)
    state = np.zeros(len(scores), np.int8)
    if not len(scores):
        return state
    best = model.start[None, :] + scores[rows_at(0)]
    last = best.copy()
    for t in range(1, int(lengths.max(initial=0))):
        at = rows_at(t)
        through = last[: len(at), :, None] + model.step[None]
        back[at] = through.argmax(1)
        last[: len(at)] = through.max(1) + scores[at]
    now = last.argmax(1).astype(np.int8)
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        at = rows_at(t)
        state[at] = now[: len(at)]
        now[: len(at)] = back[at, now[: len(at)]]
    return state


FIELDS = ("n_chars_visible", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share", "prose_share", "list_share", "table_share", "junk_share")


def document_statistics(texts: pa.Array, model: Model | None = None) -> list[np.ndarray]:
    """FIELDS for every text."""
    model = model or guess()
    x, doc, n_lines = measure(texts)
    state = viterbi(features(x) @ model.weights.T, n_lines, model)
    n = len(n_lines)
    total = lambda v: np.bincount(doc, weights=v, minlength=n)
    visible, words = total(x["visible"]), total(x["words"])
    filled = total(x["visible"] > 0)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    out = [visible.astype(np.int64), words.astype(np.int64), over(total(x["word_chars"]), words), over(total(x["symbols"]), visible), over(total(x["ends"].astype(float)), filled), over(total(x["common"]), words)]
    return out + [over(total(x["visible"] * (state == s)), visible) for s in range(4)]


def with_statistics(docs: DataFrame, keys: list[str], text: str, model: Model | None = None) -> DataFrame:
    """keys and FIELDS for every row. Null, empty and invisible texts have zeros throughout; long texts are measured whole."""
    own = docs.select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, whole.num_columns - 1)):
            found = document_statistics(batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*batch.schema.names[:-1], *FIELDS])

    return own.mapInArrow(run, f"{kinds}, n_chars_visible long, n_words long, " + ", ".join(f"{f} double" for f in FIELDS[2:]))


def not_prose(docs: DataFrame, key: str = "doc_id", text: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """Keys of the documents of which less than half the visible text is prose; texts without any are no cases."""
    return with_statistics(docs, [key], text, fitted(docs, labels, key, text)).where((F.col("n_chars_visible") > 0) & (F.col("prose_share") < 0.5)).select(key).distinct()
