"""Choosing and checking corpus records."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.scans import number_rows
from quirefold.session import cut


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Null keys are keys. A hot key is reduced before it is shuffled (the smallest row, not a window)."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_o").alias("_r")).select(*keys, "_r.*").select(*df.columns)


def record_keys(df: DataFrame) -> Column:
    """The keys by which two catalogue records are one: DOI, ISBNs, title with publisher."""
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), T.word_key(F.col("doi"))))
    isbns = F.transform(F.coalesce("isbns", F.array().cast("array<string>")), lambda x: F.concat(F.lit("isbn:"), F.regexp_replace(F.upper(x), "[^0-9X]", "")))
    title = F.concat(F.lit("title:"), T.word_key(F.coalesce("title", F.lit(""))), F.lit("|publisher:"), T.word_key(F.coalesce("publisher", F.lit(""))))
    return F.array_distinct(F.filter(F.concat(F.array(doi, title), isbns), lambda k: k.isNotNull()))


def greedy_keep(df: DataFrame, row: str, order: str, keys: str, most_rounds: int = 200) -> DataFrame:
    """``row`` of the rows that a pass in ``order`` keeps, where a row goes if any of its keys is on a row kept before.

    The pass is made in rounds: a row that is first among the undecided under each of its keys is kept, and the undecided rows that share
    a key with it go. That decides as the sequential pass does. ``order`` has no ties.
    """
    open_ = cut(df.select(row, order, F.explode(keys).alias("key")).distinct())
    kept = df.select(row).where(F.size(keys) == 0)
    for _ in range(most_rounds):
        if open_.isEmpty():
            return kept
        firsts = open_.groupBy("key").agg(F.min(order).alias("_least"))
        marked = open_.join(firsts, "key").groupBy(row).agg(F.min((F.col(order) == F.col("_least")).cast("int")).alias("ok"))
        now = cut(marked.where("ok = 1").select(row))
        taken = open_.join(now, row, "left_semi").select("key").distinct()
        gone = open_.join(taken, "key", "left_semi").select(row).distinct()
        kept = kept.unionByName(now)
        open_ = cut(open_.join(gone, row, "left_anti"))
    raise RuntimeError("the pass did not end")


def dedupe_records(df: DataFrame, order: str) -> DataFrame:
    """The records that the pass over the catalogue keeps."""
    keyed = df.withColumn("_keys", record_keys(df))
    return df.join(greedy_keep(keyed, "id", order, "_keys"), "id", "left_semi")


def quota_splits(df: DataFrame, order: list[Column], discovery: int, development: int, locked: int) -> DataFrame:
    """``df`` with place, newsplit by quotas along the order (what is over goes to discovery), and needsreview."""
    placed = number_rows(df, order, "place")
    a, b, c = discovery, discovery + development, discovery + development + locked
    split = F.when(F.col("place") <= a, "discovery").when(F.col("place") <= b, "development").when(F.col("place") <= c, "locked-test").otherwise("discovery")
    return placed.withColumn("newsplit", split).withColumn("needsreview", T.needs_second_review(F.col("id"), F.col("newsplit")))


def varied_sample(df: DataFrame, target: int) -> DataFrame:
    """id, pick of ``target`` records taken one by one: a new publisher and new subjects count most, then a rare length and outline; ties take the largest id.

    Records alike in all that counts differ by id only, so no more than ``target`` of each kind can be picked and the others are left out before the
    records meet in one task. What a record scores only falls as others are picked, so a heap of old scores finds the next pick.
    """
    kind = df.select(
        "id", T.word_key(F.coalesce("publisher", F.lit(""))).alias("publisher"), F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: s != ""), T.word_key))).alias("subjects"),
        F.coalesce("pagetier", F.lit("medium")).alias("tier"), F.coalesce("hasoutline", F.lit(False)).alias("outline"),
    )
    w = Window.partitionBy("publisher", "subjects", "tier", "outline").orderBy(F.desc("id"))
    pruned = kind.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= target).drop("_n")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        publishers: set[str] = set()
        subjects: set[str] = set()
        tiers: dict[str, int] = {}
        outlines = {True: 0, False: 0}

        def score(r) -> float:
            new = (4 if r.publisher and r.publisher not in publishers else 0) + min(4, len(set(r.subjects) - subjects))
            return new + 2 / (1 + tiers.get(r.tier, 0)) + 1 / (1 + outlines[bool(r.outline)])

        rows = sorted(pdf.itertuples(index=False), key=lambda r: r.id, reverse=True)
        heap = [(-score(r), i) for i, r in enumerate(rows)]
        heapq.heapify(heap)
        picked = []
        while heap and len(picked) < target:
            old, i = heapq.heappop(heap)
            now = -score(rows[i])
            if heap and (now, i) > heap[0]:
                heapq.heappush(heap, (now, i))
                continue
            r = rows[i]
            picked.append(r.id)
            if r.publisher:
                publishers.add(r.publisher)
            subjects.update(r.subjects)
            tiers[r.tier] = tiers.get(r.tier, 0) + 1
            outlines[bool(r.outline)] += 1
        return pd.DataFrame({"id": pd.Series(picked, dtype="str"), "pick": pd.Series(range(1, len(picked) + 1), dtype="int32")})

    return pruned.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda pdf: pick(pdf), "id string, pick int")


def born_digital(pages: DataFrame) -> DataFrame:
    """bookid, n_sampled, textratio, meanchars, borndigital: up to eleven pages spread evenly over each book, those with text and the characters on them."""
    sizes = pages.groupBy("bookid").agg(F.count_distinct("pageindex").alias("n"), F.max("pageindex").alias("last"))
    k = F.least(F.lit(11), F.col("n"))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * F.col("last") / F.greatest(F.lit(1), k - 1)).cast("int")))
    wanted = sizes.select("bookid", F.explode(spots).alias("pageindex"))
    sampled = pages.select("bookid", "pageindex", "text").join(wanted, ["bookid", "pageindex"], "left_semi")  # only these texts are measured
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), f"{T.WS}+", ""))
    seen = wanted.join(sampled.groupBy("bookid", "pageindex").agg(F.max(chars).alias("chars")), ["bookid", "pageindex"], "left")
    per = seen.groupBy("bookid").agg(F.count("*").alias("n_sampled"), F.round(F.sum((F.coalesce("chars", F.lit(0)) >= 50).cast("int")) / F.count("*"), 4).alias("textratio"), F.round(F.sum(F.coalesce("chars", F.lit(0))) / F.count("*"), 4).alias("meanchars"))
    return per.withColumn("borndigital", (F.col("textratio") >= 0.7) & (F.col("meanchars") >= 100))


def record_violations(df: DataFrame) -> DataFrame:
    """rule, value, n: ids and checksums that different records share, among records delivered once each."""
    once = df.select("id", "sha256", "title", "downloadurl").distinct()
    ids = once.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id").alias("rule"), F.col("id").alias("value"), "n")
    sums = once.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count_distinct("id").alias("n")).where("n > 1").select(F.lit("checksum").alias("rule"), F.col("sha256").alias("value"), "n")
    return ids.unionByName(sums)
