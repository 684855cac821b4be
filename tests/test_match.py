import random

from quirefold.operators import match

OPENING = "The house stood above the quiet water and nobody had opened its doors since the autumn when the ferry stopped coming to the old stone landing below the hill"
PASSAGE = "Every morning the keeper walked along the narrow path to the lighthouse carrying oil and bread for the winter while gulls turned slowly over the grey rocks and the tide drew back"
ENDING = "In the end only the clock remained and it told the hours to an empty room where dust settled on the ledgers and the maps that no captain would ever need again"


def run(spark, paragraphs, scan):
    units = spark.createDataFrame([("b", i, t) for i, t in enumerate(paragraphs)], "bookid string, unitno int, text string")
    scans = spark.createDataFrame([("b", 1, scan)], "bookid string, scanid int, text string")
    return match.match_scans(scans, units).first()


def test_matches_and_statuses(spark):
    book = ["Title and copyright", OPENING, PASSAGE, ENDING]
    hit = run(spark, book, f"THE RIVER\n127\n{PASSAGE}\n128")
    assert (hit.status, hit.unitno) == ("matched", 2) and hit.matchedwords == len(PASSAGE.split())
    assert run(spark, book, "too few words here").status == "too-short"
    assert run(spark, book, " ".join(f"word{i} other{i}" for i in range(30))).status == "not-found"
    assert run(spark, [*book, PASSAGE], PASSAGE).status == "ambiguous"
    assert run(spark, ["Title"], PASSAGE).status == "not-found"


def test_noise_accents_and_hyphens(spark):
    words = PASSAGE.split()
    words[4], words[9], words[20] = "wa1ked", "líghthouse", "gu11s"
    noisy = " ".join(words).replace("carrying", "carry-\ning").replace("slowly", "")
    assert run(spark, [OPENING, PASSAGE, ENDING], noisy).unitno == 1
    assert match.scan_words("Café d’été — re-\nader’s ﬁn") == ["cafe", "dete", "readers", "fin"]


def test_long_book(spark):
    rng = random.Random(741)
    vocabulary = [f"w{i}" for i in range(2000)]
    tokens = [rng.choice(vocabulary) for _ in range(30_000)]
    paragraphs = [" ".join(tokens[i : i + 48]) for i in range(0, len(tokens), 48)]
    scan = tokens[21_984 : 21_984 + 260]
    for i in range(0, 260, 17):
        scan[i] = "noise"
    hit = run(spark, paragraphs, " ".join(scan))
    assert hit.status == "matched" and hit.unitno == 21_984 // 48


def test_alignment_against_a_plain_table():
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (3 if x == y else -2), table[i - 1][j] - 2, table[i][j - 1] - 2)
        assert match.align(a, b, 0)[0][0] == max(map(max, table))
        assert match.best_scores([a, a[:2]], [b, b])[0] == max(map(max, table))
