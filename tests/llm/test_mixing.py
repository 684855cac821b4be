from collections import Counter

from quirefold.llm import mixing


def tables(spark):
    docs = [(i, "word " * (5 + i % 7), "a", "x") for i in range(300)] + [(1000 + i, "tree " * 6, "b", "x") for i in range(30)] + [(2000 + i, "leaf " * 6, "z", "x") for i in range(20)]
    docs += [(3000, None, "a", "x"), (3001, "", "b", "x"), (3002, "no source", None, "x"), (3003, "huge " * 3000, "a", "x")]
    aims = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3), ("missing", 0.1, 2)], "source string, targetshare double, maxrepeat int")
    return spark.createDataFrame(docs, "doc_id long, text string, source string, share string"), aims


def test_shares_repeats_and_order(spark):
    docs, aims = tables(spark)
    rows = mixing.mixture(docs, aims).collect()
    tokens, times = Counter(), Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
        times[r.doc_id] += 1
    assert set(tokens) == {"a", "b"}
    total = sum(tokens.values())
    assert abs(tokens["a"] / total - 0.7) < 0.02 and abs(tokens["b"] / total - 0.3) < 0.02
    assert max(n for i, n in times.items() if i < 1000) == 1 and max(times.values()) <= 3
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    half = Counter()
    for r in sorted(rows, key=lambda r: r.place)[: len(rows) // 2]:
        half[r.source] += r.n_tokens
    assert abs(half["a"] / sum(half.values()) - 0.7) < 0.08


def test_budget_and_report(spark):
    docs, aims = tables(spark)
    mixed = mixing.mixture(docs, aims, budget=400)
    assert sum(r.n_tokens for r in mixed.collect()) <= 400
    report = {r.source: r for r in mixing.mixture_report(mixed, aims).collect()}
    assert report["missing"].n_rows == 0 and abs(report["a"].share - 0.7) < 0.1


def test_empty(spark):
    docs, aims = tables(spark)
    assert mixing.mixture(docs.limit(0), aims).count() == 0
    assert mixing.mixture(docs, aims.limit(0)).count() == 0
    assert mixing.mixture_report(mixing.mixture(docs.limit(0), aims), aims).count() == 3


def test_long_documents_in_flight_wait(spark):
    docs = [(i, "word " * (40 if i % 9 == 0 else 3), "a") for i in range(400)] + [(1000 + i, "tree " * (60 if i % 5 == 0 else 2), "b") for i in range(300)]
    aims = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, targetshare double, maxrepeat int")
    mixed = mixing.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string"), aims, budget=1500)
    rows = mixed.collect()
    assert 1480 <= sum(r.n_tokens for r in rows) <= 1500 and max(Counter(r.doc_id for r in rows).values()) == 1
    assert all(abs(r.share - 0.5) < 0.01 for r in mixing.mixture_report(mixed, aims).collect())
    assert any(r.n_tokens > 30 for r in rows)


def test_checks_find_what_is_wrong(spark):
    aims = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, targetshare double, maxrepeat int")
    kind = "place long, doc_id long, copy int, source string, n_tokens long"
    rows = lambda *r: {x.source: tuple(x)[2:] for x in mixing.mixture_checked(spark.createDataFrame(list(r), kind), aims).collect()}
    assert rows((1, 1, 0, "a", 4), (2, 9, 0, "b", 2), (3, 9, 1, "b", 2)) == {"a": (True, True, 0), "b": (True, True, 0)}
    assert rows((1, 1, 0, "a", 4), (1, 1, 1, "a", 4), (4, 9, 0, "b", 2)) == {"a": (False, False, 2), "b": (False, True, 2)}
