import math
import random

import pytest

from gavel.llm import mixing as M


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def corpus(seed, sources):
    rng = random.Random(seed)
    rows = []
    for source, n, longest in sources:
        rows += [(len(rows) + i, "w " * rng.randint(1, longest), source) for i in range(n)]
    return rows


SOURCES = [("b", 200, 60), ("a", 150, 30), ("ä", 3, 5), (None, 120, 40), ("z", 260, 50), ("y", 40, 20), ("c", 1, 4)]


def test_targets_and_taken_words(docs):
    rows = corpus(1, SOURCES)
    table = M.mix_table(docs(rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = water_fill(sizes)
    assert {r.source: r.source_size for r in table} == sizes
    taken = {}
    for r in table:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in want), (taken, want)
    assert sorted(map(tuple, table), key=repr) == sorted(map(tuple, M.mix_table(docs(rows[::-1])).collect()), key=repr)


def test_rates_are_exponential_tilts(spark):
    rng = random.Random(2)
    classes = [("s", k, rng.randint(1, 9)) for k in range(1, 60)] + [("t", k, rng.randint(1, 9)) for k in range(1, 60)]
    df = spark.createDataFrame(classes, "source string, size long, n long")
    goals = {r.source: r for r in M.tilts(df, M.targets(df)).collect()}
    for source in ("s", "t"):
        g = goals[source]
        took = sum(n * k * min(3, math.exp(g.lam * k / g.unit)) for s, k, n in classes if s == source)
        assert took == pytest.approx(g.target, rel=1e-6)


def test_large_classes_are_dealt_in_parts(docs, monkeypatch):
    monkeypatch.setattr(M, "PART", 16)
    rows = [(i, "w w w", "a") for i in range(700)] + [(i, "w w", "b") for i in range(300)]
    table = M.mix_table(docs(rows)).collect()
    for source in "ab":
        own = [r for r in table if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
        assert len({r.copies for r in own}) <= 2


def test_mix_repeats_documents(docs):
    rows = corpus(3, SOURCES)
    mixed, table = M.mix(docs(rows)).collect(), M.mix_table(docs(rows)).collect()
    copies = {r.doc_id: r.copies for r in table if r.copies}
    assert {i: [r.doc_id for r in mixed].count(i) for i in copies} == copies and len(mixed) == sum(copies.values())
    assert all(sorted(r.copy for r in mixed if r.doc_id == i) == list(range(1, n + 1)) for i, n in list(copies.items())[:20])


def test_odd_rows(docs):
    table = docs([(1, None, "a"), (2, "", "a"), (3, " \t ", None), (None, "x y", "b"), (4, "x y", "b"), (4, "x y", "b"), (5, "w " * 200_000, "c")])
    got = M.mix_table(table).collect()
    assert len(got) == 7 and {r.target for r in got if r.source in ("a", None)} == {0.0}
    assert all(r.taken <= 3 * r.size for r in got)
    assert M.mix_table(table.limit(0)).count() == 0 and M.mix(table.limit(0)).count() == 0
    blank = docs([(1, None, "a"), (2, "", None)])
    assert [r.taken for r in M.mix_table(blank).collect()] == [0, 0]
    assert M.mix(table.withColumn("copy", table.doc_id)).columns[-1] == "copy"


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 3])
def test_repeated_rows_are_dealt_by_count(docs, ids):
    """Rows that agree in id and text tie in the draw; the target is met all the same."""
    rows = [(ids(i), "w " * 10, "a") for i in range(100)] + [(1000 + i, "x " * 10, "b") for i in range(75)]
    table = docs(rows).repartition(5)
    got = M.mix_table(table).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and len({r.copies for r in own}) <= 2
    mixed = M.mix(table).collect()
    assert len(mixed) == sum(r.copies for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.mix_table(table).collect()), key=repr)
