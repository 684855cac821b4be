import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import packing


def check(counts, patterns, capacity):
    used = Counter()
    for sizes, times in patterns:
        assert sum(sizes) <= capacity
        for s in sizes:
            used[s] += times
    assert used == Counter({s: n for s, n in counts.items() if n})


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 30), max_size=12))
def test_every_item_is_packed_once(counts):
    patterns, _ = packing.bin_completion(counts, 50)
    check(counts, patterns, 50)
    assert sum(t for _, t in patterns) <= sum(t for _, t in packing.best_fit({s: n for s, n in counts.items() if n}, 50))


def fewest(items, capacity):
    for k in range(1, len(items) + 1):
        for where in itertools.product(range(k), repeat=len(items)):
            room = [0] * k
            for i, b in zip(items, where):
                room[b] += i
            if max(room) <= capacity:
                return k
    return 0


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        items = [rng.randint(1, 20) for _ in range(6)]
        patterns, _ = packing.bin_completion(dict(Counter(items)), 20)
        assert sum(t for _, t in patterns) == fewest(items, 20)


def test_fillings_are_exact_and_undominated():
    left = packing._Counts({6: 1, 4: 1, 7: 1, 3: 2, 2: 1})
    assert list(packing.fillings(left, 10)) == [(0, (7, 3)), (0, (6, 4))]
    waste, filling = next(packing.fillings(packing._Counts({1: 5000, 3: 5000}), 2000))
    assert waste == 0 and sum(filling) == 2000 and len(filling) > 600
    rng = random.Random(3)
    for _ in range(40):
        items = [rng.randint(1, 15) for _ in range(7)]
        sums = {sum(c) for n in range(8) for c in itertools.combinations(items, n)}
        assert next(packing.fillings(packing._Counts(dict(Counter(items))), 30))[0] == 30 - max(s for s in sums if s <= 30)


def test_how_the_search_ended():
    assert packing.bin_completion({5: 4}, 10)[1] == "bound"
    patterns, ended = packing.bin_completion({4: 3, 5: 2, 7: 2}, 12)
    assert ended in ("bound", "exhausted") and sum(t for _, t in patterns) == fewest([4] * 3 + [5] * 2 + [7] * 2, 12)
    rng = random.Random(4)
    hard = Counter(rng.randint(400, 900) for _ in range(500))
    assert packing.bin_completion(dict(hard), 2048, backtracks=5)[1] == "stopped"


def test_many_items_reach_the_bound():
    rng = random.Random(2)
    counts = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    patterns, _ = packing.bin_completion(dict(counts), 2048)
    check(counts, patterns, 2048)
    total = sum(s * n for s, n in counts.items())
    assert sum(t for _, t in patterns) <= -(-total // 2048) + 1


def test_documents(spark):
    rows = [(1, "word " * 30, 9), (2, None, 9), (3, "", 9), (4, "long text here " * 200, 9), (5, "one", 9), (6, "one", 9), (7, "two words", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container int")
    got = packing.pack(docs, 64).collect()
    assert {r.doc_id for r in got} == set(range(1, 8))
    held = Counter()
    for r in got:
        held[r.container] += r.n_tokens
        assert r.tokenstart == r.part * 64
    assert max(held.values()) <= 64
    parts = sorted((r.part, r.n_tokens, r.container) for r in got if r.doc_id == 4)
    assert len(parts) > 1 and all(n == 64 for _, n, _ in parts[:-1])
    assert all(sum(r.doc_id != 4 for r in got if r.container == c) == 0 for _, n, c in parts if n == 64)
    assert len({(r.doc_id, r.part) for r in got}) == len(got)
    report = packing.packing_report(packing.pack(docs, 64), 64).first()
    assert report.n_containers >= report.least_containers and report.fullest <= 64
    assert packing.pack(docs.limit(0), 64).count() == 0


def test_checks_find_what_is_wrong(spark):
    kind = "doc_id long, part int, container long, n_tokens long, tokenstart long"
    good = spark.createDataFrame([(1, 0, 0, 6, 0), (2, 0, 0, 4, 0), (3, 0, 1, 10, 0), (3, 1, 2, 3, 10), (4, 0, 0, 0, 0)], kind)
    assert tuple(packing.packing_checked(good, 10).first()) == (4, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 0, 6, 0), (2, 0, 0, 5, 0), (3, 0, 1, 4, 0), (3, 1, 2, 3, 10), (4, 1, 3, 2, 10)], kind)
    assert tuple(packing.packing_checked(bad, 10).first()) == (4, 1, 1, 2)
