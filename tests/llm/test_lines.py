from collections import defaultdict

from quirefold.llm import lines


def pages(spark, rows):
    return spark.createDataFrame(rows, "bookid string, pageindex int, label string, text string, source string, doc string, key string")


def page(book, i, text, label=None):
    return (book, i, label, text, "s", "d", "k")


def test_labels_case_spacing_and_repeats(spark):
    rows = [page("a", i, f"The Book | {i + 1}\n\nbody {i} text\n\n- {i + 1} -") for i in range(5)]
    rows[2] = page("a", 2, "T H E  BOOK | iii\n\nbody 2 text\n\n- iii -", "iii")
    rows.append(rows[0])
    found = lines.page_lines(pages(spark, rows))
    assert sorted((r.pageindex, r.lineindex) for r in found.collect()) == sorted((i, n) for i in range(5) for n in (0, 4))
    assert lines.page_lines(pages(spark, rows[:4])).count() == 0


def test_label_is_a_word_of_its_own(spark):
    found = lines.page_lines(pages(spark, [page("a", i, f"room{i + 1} x", str(i + 1)) for i in range(6)]))
    assert found.count() == 0


def test_look_alikes_count_as_equal(spark):
    rows = [page("a", i, "Running head" if i % 2 else "Runnіng heаd") for i in range(5)]
    assert lines.page_lines(pages(spark, rows)).count() == 5


def test_nulls_empty_and_clashing_columns(spark):
    assert lines.page_lines(pages(spark, [page(None, 1, "x"), page("a", 1, None), page("a", 2, ""), page("a", 3, "​\n \n")])).count() == 0
    assert lines.page_lines(pages(spark, [])).count() == 0


def test_rebuilt_pages(spark):
    rows = [page("a", i, f"head\nown {i}\nfoot") for i in range(6)] + [page("b", 0, "head\nother"), page("b", 1, None)]
    df = pages(spark, rows).select("bookid", "pageindex", "text", "label")
    found = lines.page_lines(df).withColumnsRenamed({"bookid": "source", "pageindex": "doc"})
    clean = {(r.bookid, r.pageindex): (r.clean_text, r.n_removed) for r in lines.without_lines(df, found, "bookid", "pageindex", "text").collect()}
    assert clean["a", 3] == ("own 3", 2)
    assert clean["b", 0] == ("head\nother", 0)
    assert clean["b", 1] == (None, 0)


def test_share_threshold(spark):
    rows = [page("a", i, "rare" if i < 5 else f"p {i} q") for i in range(50)]
    df = pages(spark, rows)
    assert lines.repeated_lines(df, "bookid", "pageindex", "text", None, 5, 0.0).count() == 5
    assert lines.repeated_lines(df, "bookid", "pageindex", "text", None, 5, 0.5).count() == 0


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma  delta", "x", ""]
    rows = [page(rng.choice("ab"), i, "\n".join(rng.choice(words) for _ in range(rng.randint(1, 5))), "zz") for i in range(40)]
    seen = defaultdict(set)
    for b, p, _, text, *_ in rows:
        for line in text.split("\n"):
            if line.strip():
                seen[b, "".join(line.lower().split())].add(p)
    want = sorted((b, p, n) for b, p, _, text, *_ in rows for n, line in enumerate(text.split("\n")) if line.strip() and len(seen[b, "".join(line.lower().split())]) >= 5)
    assert sorted((r.bookid, r.pageindex, r.lineindex) for r in lines.page_lines(pages(spark, rows)).collect()) == want
