import random

import numpy as np
import pytest

from gavel.llm import quality as Q
from gavel.llm import toxicity as T
from gavel.llm.labelled import in_fold, sample

SYLLABLES = "an er on st th re in ou ti la ve mo".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)) + "."


def test_fold(spark):
    import zlib

    df = spark.range(200).selectExpr("id AS doc_id")
    got = {r.doc_id for r in df.where(in_fold((4, 2))).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_sample(spark, docs):
    table = docs([(i, f"t{i}") for i in range(100)] + [(200, None), (None, "n")])
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(100)] + [(0, 1), (200, 1), (None, 1), (3, None), (5, 7), (777, 0)], "doc_id long, quality int"
    )
    import zlib

    rows = dict(sample(table, labels, "quality", (4, 2), 1000))
    want = {f"t{i}": i % 2 for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}
    if "t0" in want:
        want["t0"] = 1
    assert rows == want
    assert [y for _, y in sample(table, labels, "quality", (4, 2), 5)] == [0] * 5 + [1] * 5


def chains(good, pair, sizes):
    """All label sequences of each text by brute force: marginals and log partition."""
    at, marginals, logs = 0, [], []
    for n in sizes:
        total, own = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += w
            own += w * np.array(y)
        marginals += list(own / total)
        logs.append(np.log(total) if n else 0.0)
        at += n
    return np.array(marginals), np.array(logs)


def test_forward_backward():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 6, 2])
    starts = np.cumsum(sizes) - sizes
    good, pair = rng.normal(size=12), rng.normal(size=(2, 2))
    forward, backward, logz = Q.forward_backward(good, pair, starts, sizes)
    text = np.repeat(np.arange(5), sizes)
    marginals, logs = chains(good, pair, sizes)
    assert np.exp(forward[:, 1] + backward[:, 1] - logz[text]) == pytest.approx(marginals)
    assert logz == pytest.approx(logs)


def test_line_features_by_hand(monkeypatch):
    lines = Q.line_features([b"Ab 12.\n\n \nab ab ab", None, "é|!#".encode()])
    assert lines.sizes.tolist() == [2, 0, 1] and lines.weights.tolist() == [6, 8, 5]
    assert lines.features[0, :9] * 6 == pytest.approx([1, 1, 2, 1, 1, 0, 0, 0, 0])
    assert lines.features[2, :9] * 5 == pytest.approx([0, 0, 0, 0, 0, 1, 1, 1, 2])
    assert lines.features[1, 12] == pytest.approx(1 / 3)  # distinct words
    monkeypatch.setattr(Q, "SLICE", 3)  # counted in pieces
    assert np.array_equal(Q.line_features([b"Ab 12.\n\n \nab ab ab", None, "é|!#".encode()]).features, lines.features)


@pytest.fixture(scope="module")
def poor_and_good():
    rng = random.Random(1)
    good = ["\n".join(prose(rng, 30) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    poor = [prose(rng, 20) + "\n" + rng.choice(["word " * 40, "A! " * 30, "a | b | " * 12]) for _ in range(150)]
    return [(t, 1) for t in good] + [(t, 0) for t in poor]


def test_quality(spark, docs, poor_and_good):
    rows = [(i, t) for i, (t, _) in enumerate(poor_and_good)]
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, rows[0][1]), (1003, "good words here " * 100_000), (0, rows[0][1])]
    table = docs(rows + odd)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(poor_and_good)], "doc_id long, quality int")
    got = Q.quality(table, labels).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == poor_and_good[r.doc_id][1] for r in held]) > 0.95
    assert {r.score for r in got if r.doc_id in (1000, 1001, 1002)} == {0.0}
    kept = Q.without_poor(table, labels)
    assert kept.columns == table.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert Q.quality(table.limit(0), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in Q.quality(table, none).collect()} == {0.0} and Q.without_poor(table, none).count() == 306


@pytest.fixture(scope="module")
def toxic_and_clean():
    rng = random.Random(2)
    rude = ["blorgus", "snarfle", "grumphic"]
    rows = []
    for i in range(300):
        words = prose(rng, rng.randint(20, 200)).split()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_ngram_bags():
    rows, starts = T.ngram_bags(["ab", "c", "abcd"])
    # <ab>: 2+1; <c>: 1; <abcd>: 4+3+2
    assert np.diff(np.append(starts, len(rows))).tolist() == [3, 1, 9]
    again, _ = T.ngram_bags(["abcd"])
    assert again.tolist() == rows[starts[2] :].tolist()


def test_misspelt_words_share_ngrams(toxic_and_clean):
    model = T.train(toxic_and_clean[:240])
    rest = toxic_and_clean[240:]
    scores = model.scores([t for t, _ in rest], {})
    assert np.mean((scores >= 0.7) == [y for _, y in rest]) > 0.95
    rng = random.Random(3)
    clean, odd = prose(rng, 100), prose(rng, 50) + " blorguss snarrfle " + prose(rng, 50)
    a, b = model.scores([clean, odd], {})
    assert a < 0.5 < b
    assert model.scores([clean, odd], {}).tolist() == model.scores([clean, odd, None], {})[:2].tolist()


def test_toxicity(spark, docs, toxic_and_clean):
    rows = [(i, t) for i, (t, _) in enumerate(toxic_and_clean)]
    table = docs(rows + [(1000, None), (1001, ""), (None, "an er"), (0, rows[0][1]), (1002, "an er st " * 100_000)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(toxic_and_clean)], "doc_id long, toxic int")
    got = T.toxicity(table, labels).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == toxic_and_clean[r.doc_id][1] for r in held]) > 0.95
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    kept = T.without_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert T.toxicity(table.limit(0), labels).count() == 0
    assert {r.score for r in T.toxicity(table, labels.limit(0)).collect()} == {0.0}
