"""Filling fixed-capacity containers with items (problem 7).

Only sizes matter to the packing, and there are at most as many sizes as the capacity, however many documents there are.
So the documents are counted by size, and bin completion runs on that table: around the largest item left, the fillings
that no other one dominates are enumerated from the least waste up, the first is applied as often as its items last, and choices are
taken back while the waste spent stays below the best solution's; a best-fit packing is the first incumbent. The result is a list of
patterns; every document finds its container from its rank among the documents of its size. A document is divided only
if it exceeds a container: then it fills containers of its own, and what is left over is packed like another document.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.tokens import VOCABULARY, with_tokens
from quirefold.session import cut

BACKTRACKS = 2000  # choices taken back after the first solution; the search then ends unproven, and says so
LOOKS = 500_000  # fillings looked at in backtracking, dominated ones included; the same holds
RANKED = 200_000  # documents ranked together, about


class _Counts:
    """How many items of each size are left."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = dict(counts)
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def give(self, size: int, n: int) -> None:
        if not self.left[size]:
            bisect.insort(self.sizes, size)
        self.left[size] += n


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be put into the items of ``a`` as into bins, so that ``a`` does whatever ``b`` does.

    Two fillings of many items are not compared: a dominated filling that is kept costs time and no solution.
    """
    if len(a) > 8 or len(b) > 8:
        return False

    def place(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= b[i] and room not in tried:
                tried.add(room)
                if place(i + 1, (*rooms[:k], room - b[i], *rooms[k + 1 :])):
                    return True
        return False

    return place(0, a)


def fillings(counts: _Counts, room: int, most_waste: int | None = None, looks: list[int] | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, sizes) of the undominated fillings of ``room``, least waste first and larger items first; lazily, without a bound on their number
    (but that of ``looks``, which counts down over a whole search, and at which the enumeration ends early).

    The sums that the sizes can make are bit sets, one for each size with all smaller ones (a size that is left n times is
    added in parts of 1, 2, 4, ... items). They say what waste is possible at all, and lead the enumeration, which so meets no dead end.
    """
    sizes = counts.sizes[: bisect.bisect_right(counts.sizes, room)]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        sums, n, step = reach[-1], min(counts.left[s], room // s), 1
        while n > 0:
            step = min(step, n)
            sums |= sums << (s * step) & mask
            n, step = n - step, step * 2
        reach.append(sums)

    def exact(top: int, total: int) -> Iterator[tuple[int, ...]]:
        """Multisets of the first ``top`` sizes with the sum ``total``, larger items first."""
        chosen: list[tuple[int, int]] = []  # (size number, items taken of it)
        stack = [(top, total, 0)]  # size numbers below ``top`` are open
        while stack:
            top, total, depth = stack.pop()
            del chosen[depth:]
            if top < 0:
                chosen.append((-top - 1, total))
                continue
            if total == 0:
                yield tuple(sizes[k] for k, n in chosen for _ in range(n))
                continue
            k = min(top, bisect.bisect_right(sizes, total)) - 1
            if k < 0 or not reach[k + 1] >> total & 1:
                continue
            # Without this size last, then with more and more of it, so that most of it is popped first.
            stack.append((k, total, depth))
            for n in range(1, min(counts.left[sizes[k]], total // sizes[k]) + 1):
                if reach[k] >> (total - n * sizes[k]) & 1:
                    stack.append((k, total - n * sizes[k], depth + 1))
                    stack.append((-k - 1, n, depth))

    kept: list[tuple[int, ...]] = []
    for waste in range(room + 1 if most_waste is None else min(room, most_waste) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for chosen in exact(len(sizes), room - waste):
            if looks is not None:
                looks[0] -= 1
                if looks[0] < 0:
                    return
            used = {s: chosen.count(s) for s in set(chosen)}
            if any(s <= waste and counts.left[s] > used.get(s, 0) for s in sizes[: bisect.bisect_right(sizes, waste)]):
                continue  # something still fits: a fuller filling dominates it
            if not any(_dominates(k, chosen) for k in kept):
                if len(chosen) <= 8 and len(kept) < 64:
                    kept.append(chosen)
                yield waste, chosen


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, times): every container takes the largest item that fits, again and again."""
    left, patterns = _Counts({s: n for s, n in counts.items() if n > 0}), []
    while left.sizes:
        room, sizes, used = capacity, [], {}
        while True:
            at = bisect.bisect_right(left.sizes, room) - 1
            while at >= 0 and left.left[left.sizes[at]] <= used.get(left.sizes[at], 0):
                at -= 1
            if at < 0:
                break
            size = left.sizes[at]
            n = min(room // size, left.left[size] - used.get(size, 0))
            sizes += [size] * n
            used[size] = used.get(size, 0) + n
            room -= size * n
        times = min(left.left[s] // n for s, n in used.items())
        for s, n in used.items():
            left.take(s, n * times)
        patterns.append((tuple(sizes), times))
    return patterns


def least_containers(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by size, and by the items that cannot share a container with one above a threshold."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    number, weight = [0], [0]
    for s in sizes:
        number.append(number[-1] + counts[s])
        weight.append(weight[-1] + s * counts[s])
    half = bisect.bisect_right(sizes, capacity // 2)
    for k in range(half + 1):
        least = sizes[k] if k < half else capacity // 2 + 1  # smaller items are left out
        above = bisect.bisect_right(sizes, capacity - least)
        alone = number[-1] - number[above]
        big, big_weight = number[above] - number[half], weight[above] - weight[half]
        small = weight[half] - weight[min(k, half)]
        best = max(best, alone + big + max(0, -(-(small - (big * capacity - big_weight)) // capacity)))
    return best


def bin_completion(counts: dict[int, int], capacity: int, backtracks: int = BACKTRACKS) -> tuple[list[tuple[tuple[int, ...], int]], str]:
    """(sizes, times) of the containers of the best packing found, and how the search ended.

    That is ``bound`` (no packing can have fewer containers), ``exhausted`` (every undominated choice was tried, so none has) or ``stopped``
    (``backtracks`` choices were taken back, or LOOKS fillings looked at). Each container around the largest item left takes a filling as often as it lasts, or,
    when that is taken back, once: so every packing can be met.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return [], "bound"
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must lie between one and the capacity")
    total = sum(s * n for s, n in counts.items())
    bound = least_containers(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(t for _, t in best)
    left = _Counts(counts)
    path: list[tuple[tuple[int, ...], int, int, Iterator]] = []  # what was applied, how often, the waste of it, other choices
    bins = waste = 0

    def choices() -> Iterator[tuple[int, tuple[int, ...], int]]:
        first = left.sizes[-1]
        left.take(first, 1)
        slack = (fewest - 1) * capacity - total - waste  # more waste than this a better solution cannot afford
        found = fillings(_Counts({s: left.left[s] for s in left.sizes}), capacity - first, slack, looks)
        left.give(first, 1)
        for lost, filling in found:
            need: dict[int, int] = {}
            for s in (first, *filling):
                need[s] = need.get(s, 0) + 1
            times = min(left.left[s] // n for s, n in need.items())
            yield lost, (first, *filling), times
            if times > 1:
                yield lost, (first, *filling), 1

    looks = [LOOKS]
    ended, options = "bound", choices()
    while fewest > bound:
        choice = next(options, None)
        if choice is not None and waste + choice[0] * choice[2] <= (fewest - 1) * capacity - total:
            lost, pattern, times = choice
            for s in pattern:
                left.take(s, times)
            path.append((pattern, times, lost, options))
            bins, waste = bins + times, waste + lost * times
            if left.sizes:
                options = choices()
                continue
            if bins < fewest:
                best, fewest = [(p, t) for p, t, _, _ in path], bins
        elif choice is not None:
            continue
        # Nothing more to choose here, or a solution: the last choice is taken back.
        if not path:
            ended = "exhausted"
            break
        if backtracks <= 0 or looks[0] < 0:
            ended = "stopped"
            break
        backtracks -= 1
        pattern, times, lost, options = path.pop()
        for s in pattern:
            left.give(s, times)
        bins, waste = bins - times, waste - lost * times
    return best, ended


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows size, first rank, first container, items of that size in one: where each rank of each size goes."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for sizes, times in patterns:
        for s in sorted(set(sizes)):
            n = sizes.count(s)
            rows.append((s, rank.get(s, 0), base, n))
            rank[s] = rank.get(s, 0) + n * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    return packed_and_ended(docs, capacity, key, text, vocabulary)[0]


def packed_and_ended(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, str]:
    """How the search ended (see ``bin_completion``), and key, part, container, n_tokens, tokenstart of every document (or, for one above the capacity, of each of its parts).

    Documents without tokens (null and empty texts) go to container 0 with size 0. Rows with the same key count each.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    sized = cut(with_tokens(docs.select(key, text), [key], text, vocabulary))
    whole = sized.select(key, F.expr(f"n_tokens div {capacity}").alias("full"), (F.col("n_tokens") % capacity).alias("rest"))
    items = whole.where("rest > 0").select(key, F.col("full").cast("int").alias("part"), F.col("rest").alias("size"), (F.col("full") * capacity).alias("tokenstart"))
    full = whole.where("full > 0").select(key, F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part"))
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    patterns, ended = bin_completion(counts, capacity)
    slots, packed = _slots(patterns), sum(t for _, t in patterns)
    ranked = max(1, -(-sum(counts.values()) // RANKED))
    where = {s: np.searchsorted(slots[:, 0], [s, s + 1]) for s in counts}

    items = items.withColumn("bucket", F.pmod(F.xxhash64(key, "part"), F.lit(ranked)))
    before = items.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "part"))
    items = items.withColumn("r", place.cast("long") - 1).join(before, ["size", "bucket"]).select(key, "part", "size", "tokenstart", (F.col("r") + F.col("before")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                rows = slots[slice(*where[int(s)])]
                at = np.searchsorted(rows[:, 1], rank[mine], side="right") - 1
                container[mine] = rows[at, 2] + (rank[mine] - rows[at, 1]) // rows[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(container), batch.column(2), batch.column(3)], names=[*batch.schema.names[:2], "container", "n_tokens", "tokenstart"])

    kind = dict(docs.dtypes)[key]
    small = items.mapInArrow(assign, f"`{key}` {kind}, part int, container long, n_tokens long, tokenstart long")
    # Documents that fill containers of their own are numbered behind the packed ones, bucket by bucket.
    many = full.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(ranked)))
    ahead = many.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("bucket").orderBy(key, "part")).cast("long") - 1
    large = many.withColumn("r", number).join(ahead, "bucket").select(key, "part", (F.lit(packed) + F.col("before") + F.col("r")).alias("container"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("part") * F.lit(capacity)).cast("long").alias("tokenstart"))
    none = sized.where("n_tokens = 0").select(key, F.lit(0).alias("part"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("tokenstart"))
    return small.unionByName(large).unionByName(none), ended


def packing_report(packed: DataFrame, capacity: int, ended: str = "") -> DataFrame:
    """n_containers, n_tokens, least_containers possible by size, unused_share, fullest, and how the search ended."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    return per.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("n_tokens"), F.ceil(F.coalesce(F.sum("held"), F.lit(0)) / F.lit(capacity)).alias("least_containers"),
        F.round(1 - F.sum("held") / (F.count("*") * F.lit(float(capacity))), 6).alias("unused_share"), F.max("held").alias("fullest"), F.lit(ended).alias("ended"),
    )


def packing_checked(packed: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row: documents, containers above the capacity, documents that are divided though one container holds them, and documents of which a part is missing."""
    above = packed.groupBy("container").agg(F.sum("n_tokens").alias("held")).agg(F.count_if(F.col("held") > capacity).alias("n_above"))
    per = packed.groupBy(key).agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("tokenstart") != F.col("part") * capacity).alias("off"), F.max("part").alias("last"))
    gap = (F.col("off") > 0) | (F.col("last") + 1 != F.col("parts")) | (F.col("parts") != F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)))
    docs = per.agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= capacity)).alias("n_divided"), F.count_if(gap).alias("n_gaps"))
    return docs.join(F.broadcast(above)).select("n_documents", "n_above", "n_divided", "n_gaps")  # one row each
