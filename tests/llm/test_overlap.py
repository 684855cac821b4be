import itertools
import random

from quirefold.llm import overlap

FIELDS = "id string, title string, split string, sha256 string, bytes bigint, source string, full string, key string"
SUM = "ab" * 32


def df(spark, rows):
    return spark.createDataFrame([(i, t, s, h, b, "src", "f", "k") for i, t, s, h, b in rows], FIELDS)


def pairs(spark, rows):
    return {(r.ida, r.idb) for r in overlap.found_pairs(df(spark, rows)).collect()}


LONG = "The Quiet Lantern of Belramelthstad: A Study of the Silver Ferry"


def test_titles(spark):
    same = ["the quiet lantern of belramelthstad — a study of the silver ferry", "Quiet Lantern of Belramelthstad", "The Quiet Lantrn of Belramelthstad: A Study of the Silver Ferry (2nd ed.)", "The Quiet Lantеrn of  Belramelthstad: A Study of the Silver Ferry [open access]", "The Quiet Lantern of Belramelthstad: A Stuyd of the Silver Ferry, revised edition", "The Quiet Lantern of Belramelthstad: A Study of the Silver Ferry, revied edition"]
    other = ["The Quiet Lantern of Belramelthstad: A Study of the Wooden Ledger", "The Quiet Lantern of Belramelthstad, Volume 2", "", None]
    rows = [("t", LONG, "discovery", None, None)] + [(f"s{i}", t, "control", None, None) for i, t in enumerate(same)] + [(f"u{i}", t, "development", None, None) for i, t in enumerate(other)]
    assert pairs(spark, rows) == {tuple(sorted((f"s{i}", "t"))) for i in range(len(same))}


def test_parts_of_series_and_articles(spark):
    rows = [("a", "Essays on Clerk and Pier: Yearbook 1964", "discovery", None, 1), ("b", "Essays on Clerk and Pier: Yearbook 1965", "control", None, 1), ("c", "essays on clerk & pier: yearbook 1964", "control", None, 1), ("d", "The The Essays on Clerk and Pier: Yearbook 1964", "control", None, 1)]
    assert pairs(spark, rows) == {("a", "c"), ("a", "d")}


def test_checksums(spark):
    rows = [("a", "One quite different title", "discovery", "SHA256:" + SUM.upper(), 5), ("b", "Another unlike title here", "control", " " + SUM, 5), ("c", "Third thing altogether", "control", overlap.EMPTY_SHA256, 0), ("d", "Fourth thing entirely", "discovery", overlap.EMPTY_SHA256, 0), ("e", "Fifth", None, SUM, 5), ("f", "Sixth", "control", "abc", 5), ("g", "Seventh", "discovery", "abc", 5)]
    assert pairs(spark, rows) == {("a", "b")}


def test_repeats_and_empty_tables(spark):
    rows = [("a", LONG, "discovery", SUM, 1)] * 3 + [("b", LONG, "control", SUM, 1)] * 2
    assert pairs(spark, rows) == {("a", "b")}
    assert overlap.found_pairs(df(spark, [])).count() == 0
    assert overlap.overlap_report(df(spark, [])).count() == 0
    report = overlap.overlap_report(df(spark, rows)).collect()
    assert [(r.split, r.source, r.n_records, r.n_overlapping, r.checksum_pairs, r.title_pairs) for r in report] == [("control", "src", 1, 1, 1, 1)]


def _slow_distance(a, b):
    old2, old = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i]
        for j in range(1, len(b) + 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, old2[j - 2] + 1)
            new.append(best)
        old2, old = old, new
    return old[-1]


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(5)
    keys = set()
    for _ in range(25):
        base = "".join(rng.choice("abcd") for _ in range(rng.randint(10, 34)))
        keys.add(base)
        for _ in range(5):
            k = list(base)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(k) - 1)
                how = rng.randrange(4)
                if how == 0:
                    k[i] = rng.choice("abcd")
                elif how == 1:
                    del k[i]
                elif how == 2:
                    k.insert(i, rng.choice("abcd"))
                else:
                    k[i], k[i + 1] = k[i + 1], k[i]
            keys.add("".join(k))
    rows = [(k, rng.random() < 0.6, rng.random() < 0.6) for k in sorted(keys)]
    found = {(r.key_e, r.key_t) for r in overlap.near_keys(spark.createDataFrame(rows, "key string, in_e boolean, in_t boolean")).collect()}
    most = lambda k: 0 if len(k) < 10 else 1 if len(k) < 24 else 2
    want = {(a, b) for (a, e, _), (b, _, t) in itertools.product(rows, rows) if e and t and _slow_distance(a, b) <= min(most(a), most(b))}
    assert found == want


def test_signatures_bound_slips():
    import random

    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(200):
        a = [rng.choice("abcdefghijé字") for _ in range(rng.randint(10, 30))]
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b) - 1)
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + ["q"] + b[i:], b[:i] + ["z"] + b[i + 1 :], b[:i] + [b[i + 1], b[i]] + b[i + 2 :]])
        x, y = overlap._signatures(pa.array(["".join(a), "".join(b)]))
        assert bin(int(x) ^ int(y)).count("1") <= 4
