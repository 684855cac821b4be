"""Mixing sources to target weights (problem 8).

Weighted fair queueing: the documents of a source, shuffled by hash and repeated at most as often as allowed, finish at
virtual times, the source's tokens so far divided by its target share. All finish times are put in one order, which is cut
where the next document would exceed the budget of tokens. A long document that is in flight at the cut, begun but not finished,
would leave its source short of its share by what has begun of it: it waits at the end of its source's queue instead, and the next one
is looked at. Only such documents change their place, so the queue chooses the rows and the cut is made by the total alone. Running sums are made in two steps, so no source and no stretch of time is one task: sums
per bucket of the shuffle, their prefix, then sums within a bucket; the same for the order of finish times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.tokens import VOCABULARY, with_tokens
from quirefold.session import cut

BUCKET = 50_000  # rows of a bucket, about
SPAN = 1 << 30
NEAR = 0.002  # of its share a source may lack at the cut
IN_FLIGHT = 200  # documents of a source that are looked at behind the cut


def _prefixes(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """The sum of each column of ``sums`` over the rows of the group before this one; a row per bucket, not per document."""
    before = Window.partitionBy(*group).orderBy(*order)
    return df.select(*group, *order, *[(F.sum(c).over(before) - F.col(c)).alias(out) for c, out in sums.items()])


def _without_overhang(timed: DataFrame, spend: float, part: dict[str, float], whole: dict[str, float]) -> DataFrame:
    """``timed`` with the long documents that are in flight at time ``spend`` put behind all others of their source.

    The next IN_FLIGHT documents of each source are walked in their order: one that what is left of the source's share can hold is
    taken, one that it cannot hold waits at the queue's end, until the share is nearly full. A few rows of each target come to the driver.
    """
    order = Window.partitionBy("source").orderBy("finish", F.desc("n_tokens"))
    ahead = timed.where(F.col("finish") > spend * (1 + 1e-12)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= IN_FLIGHT).select("source", "r", "finish", "n_tokens").collect()
    rows = []
    for s in whole:
        moved: list[tuple[float, int]] = []
        left = None
        for r in sorted((r for r in ahead if r["source"] == s), key=lambda r: r["r"]):
            if left is None:
                left = (spend - r["finish"]) * part[s] + r["n_tokens"]
            if left <= NEAR * spend * part[s]:
                break
            if r["n_tokens"] <= left:
                left -= r["n_tokens"]
            else:
                moved.append((r["finish"], r["n_tokens"]))
        behind = whole[s]  # the queue's end, from which those that wait are placed backwards
        for end, n in reversed(moved):
            rows.append((s, end, n, behind / part[s]))
            behind -= n
    if not rows:
        return timed
    waits = timed.sparkSession.createDataFrame(rows, "source string, end double, n long, new double").groupBy("source").agg(F.collect_list(F.struct("end", "n", "new")).alias("_waits"))
    joined = timed.join(F.broadcast(waits), "source", "left")  # at most IN_FLIGHT entries in each of as many rows as targets
    own = F.filter("_waits", lambda w: (w["end"] == F.col("finish")) & (w["n"] == F.col("n_tokens")))
    shift = F.aggregate(F.filter("_waits", lambda w: w["end"] <= F.col("finish")), F.lit(0).cast("long"), lambda total, w: total + w["n"])
    share = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])[F.col("source")]
    new = F.when(F.col("_waits").isNull(), F.col("finish")).when(F.size(own) > 0, F.try_element_at(own, F.lit(1))["new"]).otherwise(F.col("finish") - shift / share)
    return joined.withColumn("finish", new).drop("_waits")


def mixture(docs: DataFrame, targets: DataFrame, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """place, key, copy, source, n_tokens: the mixture in order.

    ``targets`` has source, targetshare, maxrepeat, a handful of rows. Without a budget, the mixture is as large as the
    shares allow: until one source is used up ``maxrepeat`` times. Documents of other sources or of none are left out; those
    without tokens come with the documents beside which they finish. A source without tokens is reported, and the others mixed.
    """
    aims = targets.groupBy("source").agg(F.max("targetshare").alias("share"), F.max("maxrepeat").alias("most")).where("share > 0 and most > 0")
    own = docs.where(F.col(source).isNotNull()).join(F.broadcast(aims.select(F.col("source").alias(source))), source, "left_semi")
    sized = cut(with_tokens(own.select(key, source, text), [key, source], text, vocabulary).withColumnRenamed(source, "source"))
    have = {r["source"]: (r["tokens"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # as many rows as targets
    aim = {r["source"]: (r["share"], r["most"]) for r in aims.collect()}
    whole = sum(share for s, (share, _) in aim.items() if have.get(s, (0, 0))[0])
    able = min((have[s][0] * most / (share / whole) for s, (share, most) in aim.items() if have.get(s, (0, 0))[0]), default=0.0)
    spend = able if budget is None else min(float(budget), able)
    rows = sum(n * aim[s][1] for s, (_, n) in have.items())
    buckets = max(1, -(-rows // BUCKET))

    copies = sized.join(F.broadcast(aims), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1))).drop("most")
    part = {s: share / (whole or 1.0) for s, (share, _) in aim.items()}
    copies = copies.withColumn("luck", F.pmod(F.xxhash64(F.lit("mix"), key, "copy"), F.lit(SPAN))).withColumn("bucket", F.expr(f"luck * {buckets} div {SPAN}"))
    mine = ["source", "copy", "bucket"]
    ahead = _prefixes(copies.groupBy(*mine).agg(F.sum("n_tokens").alias("n")), ["source"], ["copy", "bucket"], {"n": "before"})
    inside = F.sum("n_tokens").over(Window.partitionBy(*mine).orderBy("luck", key).rowsBetween(Window.unboundedPreceding, 0))
    timed = copies.withColumn("inside", inside).join(ahead, mine)
    timed = cut(timed.select(((F.col("before") + F.col("inside")) / (F.col("share") / F.lit(whole or 1.0))).alias("finish"), key, "copy", "source", "n_tokens"))
    timed = _without_overhang(timed, spend, part, {s: float(tokens * aim[s][1]) for s, (tokens, _) in have.items() if tokens})

    # The global order: stretches of virtual time hold about as many tokens each; stretches that begin beyond the budget are never ordered.
    timed = timed.withColumn("stretch", F.floor(F.col("finish") / F.lit(max(spend, 1.0)) * buckets))
    sums = cut(timed.groupBy("stretch").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")))
    sums = _prefixes(sums.withColumn("all", F.lit(1)), ["all"], ["stretch"], {"t": "t0", "c": "c0"}).where(F.col("t0") <= spend).drop("all")
    order = Window.partitionBy("stretch").orderBy("finish", "source", "copy", key)
    placed = timed.join(sums, "stretch").withColumns({"t1": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "c1": F.row_number().over(order)})
    return placed.where(F.col("t0") + F.col("t1") <= F.lit(spend) * (1 + 1e-12)).select((F.col("c0") + F.col("c1")).alias("place"), key, "copy", "source", "n_tokens")


def mixture_report(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """source, targetshare, share reached, n_tokens, n_rows, most_used (times one document is used), maxrepeat of every target."""
    times = mixed.groupBy("source", key).agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens"))
    per = times.groupBy("source").agg(F.sum("tokens").alias("n_tokens"), F.sum("times").alias("n_rows"), F.max("times").alias("most_used"))
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("share", F.round(share, 6))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.select("source", "targetshare", "maxrepeat").join(per, "source", "left").select("source", "targetshare", zero("share"), zero("n_tokens"), zero("n_rows"), zero("most_used"), "maxrepeat")


def mixture_checked(mixed: DataFrame, targets: DataFrame, near: float = 0.01, key: str = "doc_id") -> DataFrame:
    """Every target: whether its share is ``near`` what is asked and no document is used more often than allowed; and over all, places that are used twice or left out."""
    report = mixture_report(mixed, targets, key)
    off = mixed.agg((F.greatest(F.coalesce(F.max("place"), F.lit(0)), F.count("*")) - F.count_distinct("place")).alias("n_places_off"))
    checked = report.select("source", "targetshare", (F.abs(F.col("share") - F.col("targetshare")) <= near).alias("is_near"), (F.col("most_used") <= F.col("maxrepeat")).alias("is_within"))
    return checked.join(F.broadcast(off))  # one row
