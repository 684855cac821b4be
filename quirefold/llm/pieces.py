"""Splitting oversized items at natural boundaries (problem 3).

Separators form a hierarchy: sections (blank lines), paragraphs (line breaks), sentences, clauses, words, joints of an
address, characters. A text is split by the highest level; only a part that does not fit is split by the next one, and so on down.
The parts are packed greedily: a piece takes whole parts while they fit, a part that does not fit is split further while the piece is
less than half full, and a piece that is at least half full ends at the highest boundary of its second half; the end of a section
counts from a third on. Each piece but the first
starts exactly ``overlap`` code points before the end of the one before.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.sentences import sentence_units

SECTION = re.compile(r"\n[^\S\n]*\n\s*")
PARAGRAPH = re.compile(r"\n\s*")
CLAUSE = re.compile(r"[;:,—–、，；：،؛·፣፤]\s+|[、，；：፣፤]")
WORD = re.compile(r"\s+")
JOINT = re.compile(r"[/&?=#_+.-](?=\w)")
LEVELS = ("section", "paragraph", "sentence", "clause", "word", "joint", "character")


def boundaries(text: str) -> list[list[int]]:
    """Where parts end, by level, each list in order."""
    ends = lambda pattern: [m.end() for m in pattern.finditer(text)]
    sentences = [s for s, _ in sentence_units(text)][1:]
    return [ends(SECTION), ends(PARAGRAPH), sentences, ends(CLAUSE), ends(WORD), ends(JOINT)]


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut) of the pieces of a text; one piece if it is within the limit, none if null or empty."""
    if not text:
        return []
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and exceed the overlap")
    if len(text) <= limit:
        return [(0, len(text), "whole")]
    levels = boundaries(text)
    waiting = [(0, len(text), 0, 0)]  # spans still to be packed, the next one last: start, end, level to split it by, level of its end
    taken: list[tuple[int, int, int, int]] = []
    found, start = [], 0
    while waiting:
        span = waiting.pop()
        a, b, level, after = span
        if b <= start + limit:
            taken.append(span)
        elif late := [i for i, t in enumerate(taken) if (t[1] - start) * (2 if t[3] else 3) >= limit]:
            waiting.append(span)
            last = min(late, key=lambda i: (taken[i][3], -taken[i][1]))
            waiting += taken[:last:-1]
            end = taken[last][1]
            found.append((start, end, LEVELS[taken[last][3]]))
            start, taken = end - overlap, []
        else:
            waiting += reversed(_parts(text, span, levels, start + limit))
    found.append((start, len(text), "end"))
    return found


def _parts(text: str, span: tuple[int, int, int, int], levels: list[list[int]], most: int) -> list[tuple[int, int, int, int]]:
    """A span split by the first level from its own down that has a boundary in it; in two, at ``most``, if none has."""
    a, b, level, after = span
    while level < len(levels):
        places = levels[level]
        inner = places[bisect_right(places, a) : bisect_left(places, b)]
        if inner:
            return [(x, y, level + 1, level if y < b else after) for x, y in zip([a, *inner], [*inner, b])]
        level += 1
    cut = most
    while cut - 1 > a and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut])[0] == "M" or text[cut - 1] == "\u200d"):
        cut -= 1
    return [(a, cut, level, level), (cut, b, level, after)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns - 3
        texts, limits, overlaps = (batch.column(n + i).to_pylist() for i in range(3))
        rows: list[int] = []
        out: list[list] = [[], [], [], [], []]
        for i, (text, limit, overlap) in enumerate(zip(texts, limits, overlaps)):
            for no, (a, b, level) in enumerate(pieces(text, limit, overlap)):
                rows.append(i)
                for column, value in zip(out, (no, a, b, level, text[a:b])):
                    column.append(value)
        take = batch.select(range(n)).take(pa.array(rows, pa.int64()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*take.columns, *(pa.array(c, t) for c, t in zip(out, kinds))], names=[*take.schema.names, "pieceno", "piecestart", "pieceend", "cutat", "piece"])


def split_items(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """keys, pieceno, piecestart, pieceend, cutat, piece of every item. Null and empty texts have no piece; rows with a null limit stay whole."""
    own = items.select(*keys, text, F.coalesce(F.col(limit), F.lit(2**31 - 1)).cast("int").alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("int").alias("_overlap"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-3])
    return own.mapInArrow(_run, f"{kinds}, pieceno int, piecestart int, pieceend int, cutat string, piece string")


def oversized(predictions: DataFrame, annotations: DataFrame, limits: DataFrame) -> DataFrame:
    """itemkind, bookid, itemno, text, maxsize, overlap of the reading units and blocks above their limit.

    The few limits (a row for each kind) go to the entries where these are read, so that only what is too long is compared: repeated rows count once.
    """
    units = predictions.select(F.lit("reading_unit").alias("itemkind"), "bookid", F.posexplode("readingunits").alias("itemno", "e"))
    blocks = annotations.select(F.lit("block").alias("itemkind"), "bookid", F.posexplode("blocks").alias("itemno", "e"))
    both = units.select("itemkind", "bookid", "itemno", F.col("e.text").alias("text")).unionByName(blocks.select("itemkind", "bookid", "itemno", F.col("e.text").alias("text")))
    limited = both.join(F.broadcast(limits.select("itemkind", "maxsize", "overlap")), "itemkind")
    return limited.where(F.length("text") > F.col("maxsize")).distinct()


def oversized_pieces(predictions: DataFrame, annotations: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every entry above its limit."""
    return split_items(oversized(predictions, annotations, limits), ["itemkind", "bookid", "itemno"], "text", "maxsize", "overlap")


def pieces_checked(predictions: DataFrame, annotations: DataFrame, limits: DataFrame) -> DataFrame:
    """Per kind: items cut, and how many of them have a piece above the limit, a wrong overlap, a gap, changed text or a piece but the last that is not a third full."""
    over = oversized(predictions, annotations, limits)
    cut = split_items(over.withColumn("id", F.xxhash64("text")), ["itemkind", "bookid", "itemno", "id"], "text", "maxsize", "overlap")
    item = ["itemkind", "bookid", "itemno", "id"]
    piece = F.struct("pieceno", "piecestart", "pieceend", "piece")
    per = cut.groupBy(*item).agg(F.array_sort(F.collect_list(piece)).alias("p"))  # the pieces of one item
    per = per.join(over.withColumn("id", F.xxhash64("text")), item)
    n = F.size("p")
    at = lambda i, f: F.get(F.col("p"), i)[f]
    off = F.exists(F.sequence(F.lit(1), n - 1), lambda i: at(i, "piecestart") != at(i - 1, "pieceend") - F.col("overlap"))
    low = F.exists(F.slice("p", 1, n - 1), lambda p: F.length(p["piece"]) * 3 < F.col("maxsize"))
    text = F.aggregate("p", F.lit(""), lambda s, p: F.concat(s, F.substring(p["piece"], F.length(s) - p["piecestart"] + 1, F.length(p["piece"]))))
    bad = {
        "n_above": F.exists("p", lambda p: F.length(p["piece"]) > F.col("maxsize")), "n_overlap_off": (n < 2) | off, "n_changed": text != F.col("text"), "n_low": low,
    }
    return per.groupBy("itemkind").agg(F.count("*").alias("n_items"), *[F.sum(b.cast("long")).alias(c) for c, b in bad.items()])
