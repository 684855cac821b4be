"""Fits the weights of the sentence programme on gold sentence ends: ``python -m quirefold.llm.fit_sentences DIRECTORY``.

Gold annotations have a checksum (CRC-32 of the stored text) of every sentence of a book's reading units. A block counts if its candidates can be tiled with spans
that all have a gold checksum; that tiling is what the programme should find. An averaged structured perceptron with a margin
moves the weights: each boundary that is missing or too many costs MARGIN more than it scores. Blocks of half of the books (by hash)
are learned from, the others are measured, also with groups of cues left out.
"""

from __future__ import annotations

import sys
from collections import Counter
from zlib import crc32

import pyarrow.parquet as pq

from quirefold.llm import sentence_weights as W
from quirefold.llm import sentences as S

EPOCHS, RATE, MARGIN = 4, 0.1, 1.0
FIXED = ("span", "quotes even")  # every boundary has these, so moving them would also move cues that the gold does not show
Block = tuple[str, list[tuple[int, str, str]], list[tuple[int, int]]]


def gold_tiling(text: str, stored: str, places: list[tuple[int, str, str]], gold: set[str]) -> list[tuple[int, int]] | None:
    """The tiling with most spans, all of which are gold; none if there is none."""
    ends = [0, *(p for p, *_ in places), len(text)]
    best: list[tuple[int, int] | None] = [(0, -1)] + [None] * (len(ends) - 1)  # spans so far, place before
    for j in range(1, len(ends)):
        for i in range(j):
            if best[i] and f"{crc32(stored[ends[i] : ends[j]].strip().encode()):08x}" in gold and (not best[j] or best[i][0] + 1 > best[j][0]):
                best[j] = (best[i][0] + 1, i)
    if not best[-1]:
        return None
    out, j = [], len(ends) - 1
    while j > 0:
        out.append((ends[best[j][1]], ends[j]))
        j = best[j][1]
    return out[::-1]


def blocks(directory: str) -> tuple[list[Block], list[Block]]:
    """Blocks to learn from and blocks to measure, each distinct one once."""
    gold = {r["bookid"]: set(r["sentenceends"] or []) for r in pq.read_table(f"{directory}/annotation.parquet", columns=["bookid", "sentenceends"]).to_pylist()}
    parts: tuple[dict[str, Block], dict[str, Block]] = ({}, {})
    for row in pq.read_table(f"{directory}/prediction.parquet", columns=["bookid", "readingunits"]).to_pylist():
        mine = parts[crc32(row["bookid"].encode()) % 2]
        for unit in row["readingunits"] or []:
            for part in S.BLANK.split(unit["text"] or ""):
                stored = part.strip()
                text = S.ODD_SPACE.sub(" ", stored)
                if not text or text in mine or row["bookid"] not in gold or S.INVISIBLE.search(text) or S.structureless(text):
                    continue
                places = S.candidates(text)
                if places and len(places) < 200 and (tiled := gold_tiling(text, stored, places, gold[row["bookid"]])):
                    mine[text] = (text, places, tiled)
    return list(parts[0].values()), list(parts[1].values())


def cues(text: str, places: list[tuple[int, str, str]], spans: list[tuple[int, int]]) -> Counter:
    """How often each weight counts in a tiling."""
    at = {p: (close, open_) for p, close, open_ in places}
    depth = dict(zip(ends := [0, *(b for _, b in spans)], S._balance(text, ends)))
    n: Counter = Counter()
    for a, b in spans:
        n[f"length {W.LENGTHS[S.length_of(b - a)]}"] += 1
        n[f"quotes {W.QUOTES[S.balance_of(depth[a], depth[b])]}"] += 1
        if b in at:
            close, open_ = at[b]
            for cue in ("span", f"close {close}", f"open {open_}", f"close {close} open {open_}"):
                n[cue] += 1
    for cue in FIXED:
        n.pop(cue, None)
    return n


def wrong(data: list[Block], weights: dict[str, float]) -> tuple[int, int]:
    """Boundaries missing or too many, and gold boundaries."""
    scores = S.Scores(weights)
    found = [({b for _, b in S.best_spans(text, places, scores)}, {b for _, b in spans}) for text, places, spans in data]
    return sum(len(a ^ b) for a, b in found), sum(len(b) for _, b in found)


def learn(data: list[Block], guess: dict[str, float]) -> dict[str, float]:
    weights, total, n = Counter(guess), Counter(), 0
    for _ in range(EPOCHS):
        for text, places, spans in data:
            gold = {b for _, b in spans}
            extra = [-MARGIN if p in gold else MARGIN for p, *_ in places]
            got = S.best_spans(text, places, S.Scores(weights), extra)
            if got != spans:
                for cue, k in cues(text, places, spans).items():
                    weights[cue] += RATE * k
                for cue, k in cues(text, places, got).items():
                    weights[cue] -= RATE * k
            n += 1
            # Averaged over what was seen so far, by how long each value stood.
            total.update(weights)
    return {cue: round(total[cue] / n, 2) for cue in total}


def without(weights: dict[str, float], *groups: str) -> dict[str, float]:
    return {cue: 0.0 if any(cue.startswith(g) and (g != "close" or " open " not in cue) for g in groups) else w for cue, w in weights.items()}


def main(directory: str) -> None:
    known, held = blocks(directory)
    print(f"{len(known)} blocks to learn from, {len(held)} to measure")
    weights = learn(known, W.GUESS)
    for name, w in {
        "guess": W.GUESS, "fitted": weights, "without opening cues": without(weights, "open"), "without closing cues": without(weights, "close"), "without pairs of cues": {c: 0.0 if " open " in c else x for c, x in weights.items()},
        "without length": without(weights, "length"), "without quotations": without(weights, "quotes"),
    }.items():
        print(name, "wrong: %d of %d" % wrong(held, w), "(learned from: %d of %d)" % wrong(known, w))
    print({c: w for c, w in sorted(weights.items()) if abs(w - W.GUESS.get(c, 0.0)) >= 0.005})


if __name__ == "__main__":
    main(sys.argv[1])
