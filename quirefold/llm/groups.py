"""Splits that keep related records together (problem 4).

Records that share a publishing house or an author are joined to components by alternating star contractions, each
written to the shared checkpoint folder. Splits are then searched by component: from a hashed assignment, whole
components are moved or exchanged by annealing, several replicas at a time, and the best replica of each bucket is kept.
Components too large to be spread evenly by chance (at most LARGE of them can exist) are placed first, together; the
others are annealed in buckets, each towards its share of what is left to fill.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import hot
from quirefold.llm.chars import with_plain
from quirefold.session import cut

LARGE = 2048  # a component is large if it has this part of all records or more
BUCKET = 2000  # components annealed together, about
REPLICAS = 4
STEPS = 20_000
LABELS = 32  # label values balanced one by one; rarer ones share REST more bins by hash
REST = 8

# Legal forms and usual abbreviations in names of publishing houses.
LEGAL_FORMS = "gmbh|ag|kg|ohg|se|sa|sas|sarl|srl|spa|sl|bv|nv|oy|ab|as|aps|ltd|limited|inc|incorporated|llc|llp|lp|plc|pty|corp|corporation|co|company|cie|and co|and company|und co|et cie|gmbh and co kg|mbh|ooo|kk"
ABBREVIATIONS = {"publ": "publishing", "pub": "publishing", "pubs": "publishing", "publg": "publishing", "pr": "press", "bks": "books", "bk": "books", "univ": "university", "uni": "university", "ed": "editions", "eds": "editions", "edns": "editions", "edn": "editions", "hse": "house", "ho": "house", "verl": "verlag", "vlg": "verlag", "intl": "international", "natl": "national", "acad": "academic", "soc": "society", "inst": "institute", "lib": "library"}


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.upper(c)), "ς", "σ")


def house_key(folded: Column) -> Column:
    """The house behind a publisher's name whose accents and look-alikes are folded; null for none."""
    t = F.regexp_replace(folded, "\\s*[\\(\\[][^\\)\\]]*[\\)\\]]?", "")
    t = F.regexp_replace(t, "[&＆]", " and ")
    t = F.regexp_replace(t, "\\.(?=[\\p{L}]\\b)", "")  # S.A. is one word
    t = F.regexp_replace(t, "(?<=[\\p{L}\\p{N}.])\\s*[,;:|/].*$|\\s+[–—-]\\s+.*$", "")  # an added place
    t = F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))
    for _ in range(2):
        t = F.regexp_replace(t, f"\\s(?:{LEGAL_FORMS})$", "")
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])[w], w))
    return F.when(t != "", F.array_join(words, ""))


def author_key(folded: Column) -> Column:
    """The person behind an author's name: its names in one order; null for none."""
    words = F.filter(F.split(F.regexp_replace(folded, "[^\\p{L}\\p{N}'’-]+", " "), " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " "))


def links(records: DataFrame) -> DataFrame:
    """id, key: the houses and persons of each record. Null and empty ones give none."""
    houses = with_plain(records.select("id", F.col("publisher").alias("name")).where(F.col("name").isNotNull()).distinct(), "name", context=True, marks=False)
    persons = with_plain(records.select("id", F.explode("authors").alias("name")).where(F.col("name").isNotNull()).distinct(), "name", context=True, marks=False)
    a = houses.select("id", F.concat(F.lit("h:"), house_key(_folded(F.col("plain")))).alias("key"))
    b = persons.select("id", F.concat(F.lit("a:"), author_key(_folded(F.col("plain")))).alias("key"))
    return a.unionByName(b).where(F.col("key").isNotNull() & F.col("id").isNotNull()).distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return hot.joined(both.where("v > u"), least, ["u"], "v", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    across = hot.joined(down, least, ["u"], "v", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(linked: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, root for every id that belongs with another: root is the smallest id of its component, and has a row too.

    Rounds grow with the logarithm of the longest chain; should ``most_rounds`` not do, an error is raised and no result given.
    """
    linked = cut(linked)
    least = linked.groupBy("key").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1")
    edges = cut(hot.joined(linked, least, ["key"], "id", linked.count()).select(F.col("id").alias("u"), "v").where("u <> v").distinct())
    before = None
    total = edges.count()
    for _ in range(most_rounds):
        edges = cut(_small_star(_large_star(edges, 2 * total), total))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def belong_together(records: DataFrame) -> DataFrame:
    """ida, idb: the smallest id of each component with each of its others."""
    return components(links(records)).where("id <> root").select(F.col("root").alias("ida"), F.col("id").alias("idb"))


def anneal(size: np.ndarray, labels: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int, steps: int = STEPS, weight: float = 0.25) -> tuple[np.ndarray, float]:
    """The best assignment met, and its deviation: that of the sizes, and by ``weight`` that of the labels, over all splits.

    ``target`` has the records wanted in each split; the labels wanted are in proportion.
    """
    rng = np.random.default_rng(seed)
    total, k, n = max(float(size.sum()), 1.0), len(target), len(size)
    share = target / max(target.sum(), 1e-9)
    wanted = np.concatenate([target[:, None], share[:, None] * labels.sum(0)[None, :]], 1)
    scale = np.concatenate([[1.0], np.full(labels.shape[1], weight)]) / total
    rows = np.concatenate([size[:, None], labels], 1).astype(float)
    have = np.zeros((k, rows.shape[1]))
    np.add.at(have, start, rows)
    off = lambda s, x: float((np.abs(x - wanted[s]) * scale).sum())
    costs = [off(s, have[s]) for s in range(k)]
    cost, now = sum(costs), start.copy()
    best, best_cost = now.copy(), cost
    if n == 0 or k < 2:
        return best, best_cost
    pick, other, to, luck = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(1, k, steps), rng.random(steps)
    for step in range(steps):
        heat = 0.02 * (1 - step / steps) ** 2 + 1e-9
        i, j = pick[step], other[step]
        a = now[i]
        if step % 2 and now[j] != a:
            b, delta = now[j], rows[i] - rows[j]
        else:
            b, delta, j = (a + to[step]) % k, rows[i], -1
        at_a, at_b = have[a] - delta, have[b] + delta
        cost_a, cost_b = off(a, at_a), off(b, at_b)
        change = cost_a + cost_b - costs[a] - costs[b]
        if change <= 0 or luck[step] < np.exp(-change / heat):
            have[a], have[b], costs[a], costs[b] = at_a, at_b, cost_a, cost_b
            now[i] = b
            if j >= 0:
                now[j] = a
            cost += change
            if cost < best_cost - 1e-12:
                best, best_cost = now.copy(), cost
    return best, best_cost


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("root", ignore_index=True)
    labels = np.array(pdf["labels"].tolist(), float).reshape(len(pdf), -1)
    target = np.asarray(pdf["target"].iloc[0], float)
    bucket, replica = int(pdf["bucket"].iloc[0]), int(pdf["replica"].iloc[0])
    best, cost = anneal(pdf["size"].to_numpy(float), labels, pdf["start"].to_numpy().astype(int), target, seed=(bucket + 1) * 1009 + replica)
    return pd.DataFrame({"bucket": bucket, "replica": replica, "cost": cost, "root": pdf["root"], "place": best.astype("int32")})


def _annealed(parts: DataFrame) -> DataFrame:
    """root, place by the best replica of each bucket; ``parts`` has root, size, labels, start, bucket, target."""
    tried = parts.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1)))).groupBy("bucket", "replica").applyInPandas(_search, "bucket long, replica int, cost double, root string, place int")
    tried = cut(tried)
    won = tried.groupBy("bucket").agg(F.min(F.struct("cost", "replica")).alias("w")).select("bucket", F.col("w.replica").alias("replica"))
    return tried.join(won, ["bucket", "replica"]).select("root", "place")


def split_assignment(records: DataFrame, targets: DataFrame, label: str = "pagetier") -> DataFrame:
    """id, root, split for every id, related ids together and the shares near ``targets`` (split, share), of all records and of each value of ``label``.

    The root is the smallest id of those that belong together, an id's own if it belongs with none.
    Ids delivered twice count once; null ids are left out. A component larger than its split's share goes where it
    does least harm. The targets are a handful of rows fixed by the user.
    """
    wanted = [(r["split"], float(r["share"])) for r in targets.orderBy("split").collect()]
    names, shares = [w[0] for w in wanted], np.array([w[1] for w in wanted]) / sum(w[1] for w in wanted)
    ids = records.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(label).alias("label"))
    values = [r["label"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()]
    bin_ = F.lit(len(values)) + F.pmod(F.xxhash64("label"), F.lit(REST)).cast("int")
    for i, value in enumerate(values):
        bin_ = F.when(F.col("label").eqNullSafe(F.lit(value)), i).otherwise(bin_)
    bins = len(values) + (REST if len(values) == LABELS else 0)
    roots = cut(ids.join(components(links(records)), "id", "left").select("id", F.coalesce("root", "id").alias("root"), bin_.alias("bin")))
    parts = roots.groupBy("root").agg(F.count("*").alias("size"), *[F.sum((F.col("bin") == b).cast("long")).alias(f"b{b}") for b in range(bins)])
    luck = F.pmod(F.xxhash64(F.lit("start"), "root"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    edges = np.cumsum(shares)[:-1].tolist()
    start = sum([F.when(luck >= e, 1).otherwise(0) for e in edges], F.lit(0))
    parts = cut(parts.select("root", "size", F.array(*[f"b{b}" for b in range(bins)]).alias("labels"), start.cast("int").alias("start")))
    total, n = parts.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return roots.select("id", "root", F.lit(None).cast("string").alias("split"))
    large = parts.where(F.col("size") * LARGE >= total)
    small = parts.where(F.col("size") * LARGE < total)
    place_large = cut(_annealed(large.withColumns({"bucket": F.lit(-1).cast("long"), "target": F.lit(0)}).withColumn("target", F.array(*[F.lit(float(s) * total) for s in shares]))))
    filled = {r["place"]: r["n"] for r in large.join(place_large, "root").groupBy("place").agg(F.sum("size").alias("n")).collect()}
    left = np.maximum(shares * total - np.array([filled.get(i, 0) for i in range(len(names))], float), 0)
    buckets = max(1, -(-n // BUCKET))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(buckets)))
    sizes = small.groupBy("bucket").agg(F.sum("size").alias("whole"))
    aim = left / max(left.sum(), 1e-9)
    small = small.join(sizes, "bucket").withColumn("target", F.array(*[F.lit(float(a)) * F.col("whole") for a in aim]))
    # What is left to fill may be far from the shares, so the hashed start follows it.
    follow = np.cumsum(aim)[:-1].tolist()
    small = small.withColumn("start", sum([F.when(luck >= e, 1).otherwise(0) for e in follow], F.lit(0)).cast("int")).drop("whole")
    place = place_large.unionByName(_annealed(small))
    chosen = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("place") + 1)
    return roots.join(place, "root").select("id", "root", chosen.alias("split"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split, n_ids, n_groups, share reached, target."""
    whole = assigned.groupBy("split").agg(F.count("*").alias("n_ids"), F.count_distinct("root").alias("n_groups"))
    every = whole.withColumn("share", F.col("n_ids") / F.sum("n_ids").over(Window.partitionBy(F.lit(1))))
    return targets.select("split", F.col("share").alias("target")).join(every, "split", "left").select("split", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), "target")


def kept_together(assigned: DataFrame) -> DataFrame:
    """ida, idb: the smallest id of each group that the assignment keeps together, with each of its others."""
    return assigned.where("id <> root").select(F.col("root").alias("ida"), F.col("id").alias("idb"))


def splits_checked(records: DataFrame, assigned: DataFrame, targets: DataFrame, near: float = 0.01) -> DataFrame:
    """split, target, whether its share is ``near`` the target, and over all splits: houses and persons that stand in several, ids that have no split or two."""
    per_key = links(records).join(assigned, "id").groupBy("key").agg(F.count_distinct("split").alias("n"))
    apart = per_key.agg(F.count_if(F.col("n") > 1).alias("n_apart"))
    wrong = records.where(F.col("id").isNotNull()).select("id").distinct().join(assigned.groupBy("id").agg(F.count("*").alias("n")), "id", "full")
    wrong = wrong.agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("n_wrong"))
    reached = split_report(assigned, targets).select("split", "target", (F.abs(F.col("share") - F.col("target")) <= near).alias("is_near"))
    return reached.join(F.broadcast(apart)).join(F.broadcast(wrong))  # tables of one row
