"""Finding scanned passages in books.

Runs of three words of the scan meet those of its book in an equi-join; hits vote for places, and the best-voted places are
aligned word by word. A book's words stay in the arrays of their units, written once with their place in the book; only the runs
that a scan asks for leave them, and a window costs the units it touches and not the book.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, StringType

from quirefold.operators.scans import running_sum, spread
from quirefold.session import cut

# Fixed values of the method.
QUERY_WORDS, LEAST_WORDS, LEAST_DISTINCT, MOST_PLACES, BUCKET, CANDIDATES = 400, 16, 10, 80, 32, 96
BEFORE, BEHIND, MATCH, MISS = 48, 80, 3, -2
SHARE, SCORE, RIVAL = 0.65, 0.5, 0.85
CHUNK = 512
TOGETHER = 32  # windows scored side by side
BROKEN = re.compile(r"([^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
TOKEN = re.compile(r"[^\W_]+")


def scan_words(text: str | None) -> list[str]:
    """Words without accents, soft hyphens, apostrophes and hyphens at line ends."""
    if not text:
        return []
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).replace("­", "")
    return TOKEN.findall(re.sub("[’']", "", BROKEN.sub(r"\1", bare).lower()))


@pandas_udf(ArrayType(StringType()))
def words(texts: pd.Series) -> pd.Series:
    return texts.map(scan_words)


def placed_words(units: DataFrame) -> DataFrame:
    """bookid, unitno, first, w: the words of each unit (bookid, unitno, text) and the place of its first in the book."""
    own = units.select("bookid", F.col("unitno").cast("long").alias("unitno"), words("text").alias("w")).withColumn("n", F.size("w").cast("long"))
    return running_sum(own, ["bookid"], "unitno", "n", "first").where("n > 0").select("bookid", "unitno", "first", "w")


def grams_of(placed: DataFrame) -> DataFrame:
    """bookid, pos, gram: runs of three words by their place. A unit's last runs go on with the words at the next two places, which are met by place."""
    heads = placed.select("bookid", F.posexplode(F.slice("w", 1, 2)).alias("i", "word"), "first").select("bookid", (F.col("first") + F.col("i")).alias("at"), "word")
    end = F.col("first") + F.size("w")
    own = placed.withColumn("at", end).join(heads.withColumnRenamed("word", "h1"), ["bookid", "at"], "left").withColumn("at", F.col("at") + 1).join(heads.withColumnRenamed("word", "h2"), ["bookid", "at"], "left")
    x = F.filter(F.concat("w", F.array("h1", "h2")), lambda v: v.isNotNull())
    runs = F.transform(F.sequence(F.lit(1), F.size("x") - 2), lambda i: F.array_join(F.slice("x", i, 3), " "))
    return own.select("bookid", "first", x.alias("x")).where("size(x) >= 3").select("bookid", "first", F.posexplode(runs).alias("i", "gram")).select("bookid", (F.col("first") + F.col("i")).alias("pos"), "gram")


def scan_queries(scans: DataFrame) -> DataFrame:
    """bookid, scanid, query, enough: the words of each scan, at most 400 from its top."""
    q = scans.select("bookid", "scanid", F.slice(words("text"), 1, QUERY_WORDS).alias("query"))
    return q.withColumn("enough", (F.size("query") >= LEAST_WORDS) & (F.size(F.array_distinct("query")) >= LEAST_DISTINCT))


def votes(queries: DataFrame, placed: DataFrame) -> DataFrame:
    """bookid, scanid, bucket, n, first: places that at least two runs of the scan point to. Runs at more than 80 places of a book do not vote.

    Only runs that are asked for are counted and shuffled on.
    """
    spots = F.sequence(F.lit(0), F.size("query") - 3)
    asked = queries.where("enough").select("bookid", "scanid", "query", F.explode(spots).alias("i")).select("bookid", "scanid", "i", F.array_join(F.slice("query", F.col("i") + 1, 3), " ").alias("gram"))
    own = grams_of(placed).join(asked.select("bookid", "gram").distinct(), ["bookid", "gram"], "left_semi")
    rare = own.groupBy("bookid", "gram").agg(F.count("*").alias("places")).where(F.col("places") <= MOST_PLACES).select("bookid", "gram")
    hits = asked.join(own.join(rare, ["bookid", "gram"]), ["bookid", "gram"]).withColumn("bucket", F.floor((F.col("pos") - F.col("i")) / BUCKET))
    return hits.groupBy("bookid", "scanid", "bucket").agg(F.count("*").alias("n"), F.min(F.struct("i", "pos")).alias("first")).where("n >= 2")


def align(query: list[str], text: list[str], offset: int) -> list[tuple[int, int, int, int, int]]:
    """(score, matches, start, end, anchor) of the best local alignment and of others nearly as good elsewhere in the window.

    Nothing is traced back: each cell of the current row carries where its alignment began, how many words match, how many of the last ones in a
    row, and where three in a row first did (the anchor). What a gap in the text brings comes from the last cell that reaches the running maximum.
    """
    n, m = len(query), len(text)
    if not n or not m:
        return []
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in query])
    b = np.array([codes.setdefault(w, len(codes)) for w in text])
    at = np.arange(m + 1)
    slope = -MISS * at
    score = np.zeros(m + 1, np.int64)
    state = np.stack([at, np.zeros_like(at), np.zeros_like(at), np.full_like(at, -1)])  # start, matches, matches in a row, anchor
    best, column = (0, 0, 0, 0, 0), np.zeros(m + 1, np.int64)
    ends = np.zeros((4, m + 1), np.int64)  # the state where each column is highest
    for word in a:
        same = np.append(False, b == word)
        diagonal = np.append(0, score[:-1]) + np.where(same, MATCH, MISS)
        diagonal[0] = -1
        own = np.maximum(0, np.maximum(diagonal, score + MISS))
        straight = (own == diagonal) & (own > 0)
        came = np.where(straight, at - 1, at)
        new = state[:, came]
        matched = straight & same
        new[1] += matched
        new[2] = np.where(matched, new[2] + 1, 0)
        new[3] = np.where((new[2] == 3) & (new[3] < 0), at - 3, new[3])
        reached = np.maximum.accumulate(own + slope)
        source = np.maximum.accumulate(np.where(own + slope >= reached, at, 0))
        score = reached - slope
        gapped = source != at
        new = new[:, source]
        new[2] = np.where(gapped, 0, new[2])
        zero = score <= 0
        state = np.where(zero, np.stack([at, 0 * at, 0 * at, 0 * at - 1]), new)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(state[1, top]), int(state[0, top]), top, int(state[3, top]))
        higher = score > column
        column, ends = np.where(higher, score, column), np.where(higher, state, ends)
    first, last = best[2], best[3]
    shared = np.maximum(0, np.minimum(last, at) - np.maximum(first, ends[0]))
    apart = (column > 0) & (column >= best[0] * RIVAL) & (shared < np.minimum(last - first, at - ends[0]) * 0.5)
    found = [best, *((int(column[j]), int(ends[1, j]), int(ends[0, j]), int(j), int(ends[3, j])) for j in np.flatnonzero(apart))]
    return [(s, k, offset + i, offset + j, offset + (t if t >= 0 else i)) for s, k, i, j, t in found]


def best_scores(queries: list[list[str]], texts: list[list[str]]) -> np.ndarray:
    """The best local alignment score of each pair, all pairs side by side and without keeping a table.

    Shorter ones are filled up with words that equal nothing; those can only lower a score, so the best is not touched.
    """
    codes: dict[str, int] = {}
    n, m = max(map(len, queries), default=0), max(map(len, texts), default=0)
    q, t = np.full((len(queries), n), -1, np.int32), np.full((len(texts), m), -2, np.int32)
    for k, (a, b) in enumerate(zip(queries, texts)):
        q[k, : len(a)] = [codes.setdefault(w, len(codes)) for w in a]
        t[k, : len(b)] = [codes.setdefault(w, len(codes)) for w in b]
    slope = (2 * np.arange(m + 1)).astype(np.int16)
    last, best = np.zeros((len(queries), m + 1), np.int16), np.zeros(len(queries), np.int16)
    row = np.zeros_like(last)
    for i in range(n):
        step = np.where(t == q[:, i : i + 1], np.int16(MATCH), np.int16(MISS))
        np.maximum(last[:, :-1] + step, last[:, 1:] + np.int16(MISS), out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row[:, 0] = 0
        last = np.maximum.accumulate(row + slope, axis=1) - slope
        np.maximum(best, last.max(1), out=best)
    return best.astype(np.int64)


ALIGNED = "array<struct<minus:bigint,rank:int,no:int,matches:bigint,start:bigint,end:bigint,anchor:bigint,unitno:bigint>>"


def verdict(found, size):
    """status, unitno, matchedwords from all alignments of a scan, best first: enough words and score, and no rival elsewhere that is nearly as good."""
    top = F.try_element_at(found, F.lit(1))
    length = lambda r: r["end"] - r["start"]
    shared = lambda r: F.greatest(F.lit(0), F.least(r["end"], top["end"]) - F.greatest(r["start"], top["start"]))
    rival = F.try_element_at(F.filter(found, lambda r: shared(r) < F.least(length(r), length(top)) * 0.5), F.lit(1))
    weak = top.isNull() | (top["matches"] < LEAST_WORDS) | (top["matches"] / size < SHARE) | (-top["minus"] / (size * MATCH) < SCORE)
    status = F.when(weak, "not-found").when(F.coalesce(-rival["minus"] >= -top["minus"] * RIVAL, F.lit(False)), "ambiguous").otherwise("matched")
    return status, top["unitno"], top["matches"]


def match_scans(scans: DataFrame, units: DataFrame) -> DataFrame:
    """bookid, scanid, status, unitno, matchedwords of every scan (bookid, scanid, text); a scan of a book without units is not found."""
    queries, placed = cut(scan_queries(scans)), cut(placed_words(units))
    order = Window.partitionBy("bookid", "scanid").orderBy(F.desc("n"), "first")
    places = votes(queries, placed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES)
    windows = places.join(queries.select("bookid", "scanid", "query"), ["bookid", "scanid"]).withColumns({"w0": F.greatest(F.lit(0), F.col("bucket") * BUCKET - BEFORE), "w1": F.col("bucket") * BUCKET + F.size("query") + BEHIND})
    over = lambda a, b: F.explode(F.sequence(F.floor(a / CHUNK), F.floor(F.greatest(a, b - 1) / CHUNK))).alias("chunk")
    touched = windows.select("bookid", "scanid", "rank", "w0", "w1", over(F.col("w0"), F.col("w1")))
    held = placed.select("bookid", "unitno", "first", "w", over(F.col("first"), F.col("first") + F.size("w")))
    met = touched.join(held, ["bookid", "chunk"]).where((F.col("first") < F.col("w1")) & (F.col("first") + F.size("w") > F.col("w0")))
    part = met.groupBy("bookid", "scanid", "rank", "w0", "w1").agg(F.array_sort(F.collect_set(F.struct("first", "unitno", "w"))).alias("u")).join(queries.select("bookid", "scanid", "query"), ["bookid", "scanid"])
    part = part.select("bookid", "scanid", "rank", "w0", "w1", "query", F.transform("u", lambda x: x["first"]).alias("firsts"), F.transform("u", lambda x: x["unitno"]).alias("units"), F.flatten(F.transform("u", lambda x: x["w"])).alias("w"))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(DataType.fromDDL(ALIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, w0, w1, query, firsts, numbers, own = (batch.column(i).to_pylist() for i in range(2, 9))
            base = [max(a, f[0]) for a, f in zip(w0, firsts)]
            t = [w[a - f[0] : b - f[0]] for a, b, f, w in zip(base, w1, firsts, own)]
            # A match scores half of what is possible, its rival 85 % of it; a window below that changes nothing and is not aligned in full.
            worth = []
            for k in range(0, len(query), TOGETHER):
                q, x = query[k : k + TOGETHER], t[k : k + TOGETHER]
                worth += (best_scores(q, x) >= RIVAL * SCORE * MATCH * np.array([len(a) for a in q])).tolist()
            found = []
            for q, x, o, good, r, f, u in zip(query, t, base, worth, rank, firsts, numbers):
                rows = align(q, x, o) if good else []
                found.append([{"minus": -s, "rank": r, "no": i, "matches": k, "start": a, "end": b, "anchor": c, "unitno": u[bisect_right(f, c) - 1]} for i, (s, k, a, b, c) in enumerate(rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, kind)], names=["bookid", "scanid", "found"])

    sid = dict(scans.dtypes)["scanid"]
    aligned = spread(part, ["bookid", "scanid", "rank"]).mapInArrow(run, f"bookid string, scanid {sid}, found {ALIGNED}")
    gathered = aligned.groupBy("bookid", "scanid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("f"))
    judged = queries.select("bookid", "scanid", "enough", F.size("query").alias("size")).join(gathered, ["bookid", "scanid"], "left")
    status, unit, matches = verdict(F.coalesce("f", F.array().cast(ALIGNED)), F.col("size"))
    judged = judged.select("bookid", "scanid", F.when(F.col("enough"), status).otherwise("too-short").alias("status"), unit.alias("u"), matches.alias("m"))
    hit = F.col("status") == "matched"
    return judged.select("bookid", "scanid", "status", F.when(hit, F.col("u")).alias("unitno"), F.when(hit, F.col("m")).alias("matchedwords"))
