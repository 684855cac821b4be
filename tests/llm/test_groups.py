import random

import numpy as np

from quirefold.llm import groups, hot

FIELDS = "id string, publisher string, authors array<string>, pagetier string, root string, split string, key string"


def df(spark, rows):
    return spark.createDataFrame([(i, p, a, "short", "r", "s", "k") for i, p, a in rows], FIELDS)


def found(spark, rows):
    return {(r.ida, r.idb) for r in groups.belong_together(df(spark, rows)).collect()}


def test_houses(spark):
    same = ["Halbreöd & Marbrewiska House", "HALBREOD AND MARBREWISKA HOUSE", "Halbreöd-& Marbrewiska House GmbH", "halbreöd & marbrewiska house (Thisaholt)", "Halbreöd & Marbrewiska House, Inc.", "Hаlbreöd & Marbrewiska House & Co.", "Halbreöd & Marbrewiska House S.A., Jushita"]
    other = ["Halbreöd & Marbrewiska Press", "Halbreöd House", "", None, " ", "Muddy Court Bks."]
    rows = [(f"a{i}", p, None) for i, p in enumerate(same)] + [(f"b{i}", p, []) for i, p in enumerate(other)] + [("z", "Muddy Court Books Ltd", [])]
    assert found(spark, rows) == {("a0", f"a{i}") for i in range(1, len(same))} | {("b5", "z")}


def test_authors(spark):
    rows = [("a", None, ["Lué A. Marlinbreholt"]), ("b", None, ["Marlinbreholt, Lue A.", None, ""]), ("c", None, ["Lué Marlinbreholt"]), ("d", None, ["LUÉ  MARLINBREHOLT"]), ("e", None, None)]
    assert found(spark, rows) == {("a", "b"), ("c", "d")}


def test_chains_repeats_and_empty(spark):
    rows = [(f"{i:03d}", None, [f"Person X{i}y", f"Person X{i + 1}y"]) for i in range(40)]
    assert found(spark, rows + rows) == {("000", f"{i:03d}") for i in range(1, 40)}
    assert found(spark, []) == set()


def test_against_union_find(spark):
    rng = random.Random(2)
    rows = [(f"{i:03d}", f"House {rng.randrange(30)}" if rng.random() < 0.5 else None, [f"Name N{rng.randrange(90)}" for _ in range(rng.randrange(3))]) for i in range(120)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, p, a in rows:
        for k in ([p] if p else []) + a:
            up[top(("k", k))] = top(("i", i))
    parts = {}
    for i, *_ in rows:
        parts.setdefault(top(("i", i)), []).append(i)
    want = {(min(v), x) for v in parts.values() for x in v if x != min(v)}
    assert found(spark, rows) == want


def test_splits(spark):
    rng = random.Random(4)
    rows = [(f"{i:04d}", f"House {rng.randrange(60)}", []) for i in range(800)] + [(f"z{i:04d}", None, None) for i in range(200)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = groups.split_assignment(df(spark, rows + rows[:50]), targets).collect()
    assert len(got) == 1000 and len({r.id for r in got}) == 1000
    by_root = {}
    for r in got:
        by_root.setdefault(r.root, set()).add(r.split)
    assert all(len(s) == 1 for s in by_root.values())
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.split == split for r in got) / 1000 - share) < 0.02
    assert groups.split_assignment(df(spark, []), targets).count() == 0


def test_giant_component(spark):
    rows = [(f"{i:04d}", "One House", []) for i in range(500)] + [(f"z{i:04d}", None, None) for i in range(500)]
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split string, share double")
    got = groups.split_assignment(df(spark, rows), targets).collect()
    assert len({r.split for r in got if not r.id.startswith("z")}) == 1
    assert abs(sum(r.split == "train" for r in got) / 1000 - 0.6) < 0.02


def test_anneal_improves():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 30, 200).astype(float)
    labels = rng.integers(0, 3, (200, 4)).astype(float)
    target = np.array([0.8, 0.1, 0.1]) * size.sum()
    start = rng.integers(0, 3, 200)
    _, before = groups.anneal(size, labels, start, target, 1, steps=0)
    best, after = groups.anneal(size, labels, start, target, 1)
    assert after < before / 5
    got = np.bincount(best, weights=size, minlength=3) / size.sum()
    assert np.abs(got - [0.8, 0.1, 0.1]).max() < 0.01


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_ROWS", 5)
    monkeypatch.setattr(hot, "HOT_KEYS", 50)
    rows = [(f"{i:03d}", "One House" if i % 3 else None, [f"Person X{i // 2}y"]) for i in range(90)]
    with_hot = found(spark, rows)
    monkeypatch.undo()
    assert with_hot == found(spark, rows) and len(with_hot) == 89


def test_labels_and_checks(spark):
    rng = random.Random(6)
    rows = [(f"{i:04d}", f"House {rng.randrange(100)}", [], rng.choice(["short", "medium", "long", None]), "r", "s", "k") for i in range(900)]
    records = spark.createDataFrame(rows, FIELDS)
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split string, share double")
    assigned = groups.split_assignment(records, targets)
    assert {(r.split, r.is_near, r.n_apart, r.n_wrong) for r in groups.splits_checked(records, assigned, targets).collect()} == {("train", True, 0, 0), ("test", True, 0, 0)}
    label = {r[0]: r[3] for r in rows}
    got = assigned.collect()
    for value in ("short", "medium", "long", None):
        mine = [r.split for r in got if label[r.id] == value]
        assert abs(mine.count("train") / len(mine) - 0.7) < 0.05
