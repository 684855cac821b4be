import bisect
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import scans

pytestmark = pytest.mark.usefixtures("compiled")


def test_running_sum_over_chunks(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in range(300)]
    got = {(r.g, r.i): r.s for r in scans.running_sum(spark.createDataFrame(rows, "g string, i int, v long"), ["g"], "i", "v", "s", chunk=16).collect()}
    for g in "ab":
        total = 0
        for _, i, v in (r for r in rows if r[0] == g):
            assert got[g, i] == total
            total += v


def test_asof_and_nearest(spark):
    rng = random.Random(2)
    left = [(g, rng.randint(-50, 400), n) for n, g in enumerate("ab" * 60)] + [("c", 5, 999)]
    right = [(g, rng.randint(0, 350), n) for n, g in enumerate("ab" * 25)]
    l, r = spark.createDataFrame(left, "g string, at int, n int"), spark.createDataFrame(right, "g string, at int, m int")
    got = {x.n: (x.c.m if x.c else None) for x in scans.backward_asof(l, r.select("g", "at", F.struct("m").alias("c")), ["g"], "at", "c", chunk=32).collect()}
    near = {x.n: x.m for x in scans.nearest(l, r, ["g"], "at", "m", chunk=32).collect()}
    assert len(got) == len(near) == len(left)
    for g, at, n in left:
        own = sorted((a, m) for h, a, m in right if h == g)
        k = bisect.bisect_right(own, (at, 10**9)) - 1
        assert got[n] == (own[k][1] if k >= 0 else None)
        assert near[n] == (min((abs(a - at), min(m for b, m in own if b == a)) for a, _ in own)[1] if own else None)


def test_islands_numbers_and_groups(spark):
    df = spark.createDataFrame([("a", i, i % 3 != 0) for i in range(9)], "g string, i int, j boolean")
    assert [r.island for r in scans.islands(df, ["g"], ["i"], F.col("j")).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    placed = scans.number_rows(spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 500)], "x int"), [F.asc("x")], "place").orderBy("x").collect()
    assert [r.place for r in placed] == list(range(1, 501))
    run = lambda c: {"g": c["g"][:1], "n": [len(c["i"])], "ok": [c["i"] == sorted(c["i"])]}
    rows = scans.map_groups(df.unionByName(df.withColumn("g", F.lit("b"))), ["g"], ["i"], run, "g string, n int, ok boolean").collect()
    assert sorted(map(tuple, rows)) == [("a", 9, True), ("b", 9, True)]
    assert scans.map_groups(df.limit(0), ["g"], ["i"], run, "g string, n int, ok boolean").count() == 0


def test_union_then_aggregate_gives_each_key_once(spark):
    a = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    b = spark.range(50).groupBy((F.col("id") % 7).alias("k")).agg(F.max("id").alias("n"))
    assert a.unionByName(b).groupBy("k").count().count() == 7
