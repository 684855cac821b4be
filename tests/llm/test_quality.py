import itertools

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import quality

PROSE = [
    "The bridge restored the ancient tapestry near the river. They had not seen the mill, nor the village of the humble province, before the rains came.",
    "Der alte Müller sah die Brücke nicht. Die Bäckerin verließ das Haus, obwohl es kalt war.",
    "远方的商人说他看见了金色的大门。城里的医生离开了废弃的磨坊，而图书管理员提到了古老的车站。",
    "В конце века усталый писарь осмотрел зимний сад, но не длинный коридор. Тихий садовник описал мост.",
    "The bridge restored the ancient\ntapestry near the river. They had\nnot seen the mill, nor the village\nof the humble province.",
]
OTHER = [
    "The mirror at Soltelinra 232\nThe early baker 73\nThe lonely cemetery 367\nThe marble mirror 55\nThe golden proof 64",
    "law\tn/a\t2895\t43.52\nsalt\t12\t1206\t–\ndebt\t2.35\t62.34\tn/a",
    "Home\nSign in »\nCite | Help\nAdd to shelf\nNext",
    "ha ha ha ha ha ha ha ha ha\nha ha ha ha ha ha ha ha ha",
    "PN6ogFtCtAPG21OkDN877eMY7tprQvwV7ETrHdwVPy5K2fMzKjo8rbcGivGs0\nOJxOfIkgY2dp1ouq94sUT/KD9qQAceRztjl82AoGMm//228FaExwQ3WWLbDv",
    "Fenteström, H. (1627). The distant tunnel. Corkuven: Tax Books, pp. 49–223.\nRuwibanholt, E. (1584). The scarce parish. Amlinne: Court Press, pp. 44–270.",
    "• hidden corridor\n• tall debt\n• inner railway\n• frozen portrait",
    "grain, ledger, survey, theorem, portrait, island, museum, dictionary, coin, voyage, miller, library",
    "A winter ferry governed the custom at Ethralis\n" * 8,
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert quality.document_statistics(pa.array([text]))[6][0] >= 0.5


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert quality.document_statistics(pa.array([text]))[6][0] < 0.5


def test_documents_do_not_touch_each_other():
    texts = [*PROSE, None, "", *OTHER, "\n\n", "x"]
    together = quality.document_statistics(pa.array(texts))
    for i, t in enumerate(texts):
        alone = quality.document_statistics(pa.array([t], pa.string()))
        assert [np.round(float(v[i]), 9) for v in together] == [np.round(float(v[0]), 9) for v in alone], t


def test_simple_statistics():
    stats = dict(zip(quality.FIELDS, quality.document_statistics(pa.array(["The cat sat.\nIt was # ok"]))))
    assert stats["n_words"][0] == 6 and stats["n_chars_visible"][0] == 18
    assert stats["mean_word_length"][0] == pytest.approx(16 / 6)
    assert stats["symbol_ratio"][0] == pytest.approx(1 / 18)
    assert stats["line_end_share"][0] == pytest.approx(0.5)
    assert stats["common_share"][0] == pytest.approx(3 / 6)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 1, 3, 0, 2])
    scores = rng.normal(0, 2, (lengths.sum(), 4))
    got = quality.viterbi(scores, lengths)
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        best = max(
            itertools.product(range(4), repeat=int(n)),
            key=lambda p: (np.log(quality.START[p[0]]) if p else 0) + sum(part[i, s] for i, s in enumerate(p)) + sum(np.log(quality.STAY if a == b else (1 - quality.STAY) / 3) for a, b in zip(p, p[1:])),
        )
        assert tuple(got[at : at + n]) == best
        at += n


def test_tables(spark):
    docs = spark.createDataFrame([(1, PROSE[0], 0.1), (2, OTHER[0], 0.1), (3, None, 0.1), (4, "", 0.1), (5, " ​\n", 0.1), (2, OTHER[0], 0.2)], "doc_id long, text string, prose_share double")
    assert [r.doc_id for r in quality.not_prose(docs).collect()] == [2]
    rows = {r.doc_id: r for r in quality.with_statistics(docs, ["doc_id"], "text").collect()}
    assert rows[3].n_words == 0 and rows[5].prose_share == 0
    assert quality.not_prose(docs.limit(0)).count() == 0
    assert quality.document_statistics(pa.array(["word. " * 300_000]))[1][0] == 300_000


def test_marginals_against_brute_force():
    rng = np.random.default_rng(3)
    model = quality.guess()
    scores = rng.normal(size=(5, 4))
    ways = {}
    for path in itertools.product(range(4), repeat=4):
        ways[path] = np.exp(model.start[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:])))
    total = sum(ways.values())
    found, steps, starts = quality.marginals(scores, np.array([4, 1]), model)
    for i in range(4):
        for s in range(4):
            assert abs(found[i, s] - sum(w for p, w in ways.items() if p[i] == s) / total) < 1e-9
    assert abs(steps.sum() - 3) < 1e-9 and abs(starts.sum() - 2) < 1e-9
    assert abs(steps[0, 1] - sum(w * sum(a == 0 and b == 1 for a, b in zip(p, p[1:])) for p, w in ways.items()) / total) < 1e-9


def test_labels_correct_the_guess():
    lines = ["Glimmer stone walks over dark river\nquietly"] * 1000
    x, doc, n = quality.measure(pa.array(lines))
    before = quality.marginals(quality.features(x) @ quality.guess().weights.T, n, quality.guess())[0][:, 0].mean()
    other = quality.fit(x, doc, n, np.zeros(1000, bool))
    after = quality.marginals(quality.features(x) @ other.weights.T, n, other)[0][:, 0].mean()
    assert after < 0.5 < before


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat and it was warm."), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "prose"), (1, "prose"), (2, "other"), (9, "other"), (None, "prose")], "doc_id long, label string")
    assert quality.fitted(docs, None).weights.shape == quality.fitted(docs, labels).weights.shape
    assert np.allclose(quality.fitted(docs, labels.limit(0)).weights, quality.guess().weights)
    assert quality.not_prose(docs, labels=labels).count() == 0
