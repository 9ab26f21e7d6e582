import random
from itertools import combinations

import numpy as np
import pytest

from gavel.llm import neardup as N
from gavel.llm import simhash as S
from gavel.llm.components import connected_components, grown


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_words_lie_within_three_flips_of_one_codeword():
    index = S.golay_index()
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096


def test_fuzzy_keys_lose_no_link():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows, keys = S.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])
        assert all((rows == r).sum() <= 33 for r in (0, 1))


def test_fingerprint_by_hand():
    import xxhash

    one = xxhash.xxh64_intdigest(b"a b c", 42)
    assert S.text_fingerprint("A  b\tC".encode()) == one  # fewer words than a shingle
    assert S.text_fingerprint(None) == S.text_fingerprint(b" \n ") == 0
    text = "É b c d e b c d e f"
    words = "É b c d e b c d e f".split()  # only A-Z change case
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(7)]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 7)
    assert S.text_fingerprint(text.encode()) == want
    assert S.text_fingerprint(b"w " * 300_000) == xxhash.xxh64_intdigest(b"w w w w", 42)


@pytest.mark.parametrize("block", [2000, 3])
def test_links_connect_as_all_links_do(spark, block):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        x = b
        for _ in range(12):  # chains whose ends are far apart
            for bit in rng.sample(range(64), 3):
                x ^= 1 << bit
            fps.add(x)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    groups = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = [(r.a, r.b) for r in S.links(groups, block=block).collect()]
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    every = [(a, b) for a, b in combinations(sorted(signed), 2) if far(a, b) <= 4]
    assert all(far(a, b) <= 4 for a, b in found)
    assert roots(signed, found) == roots(signed, every)


def test_components_of_simhash(docs, rows):
    long = "word " * 200_000
    table = docs([(5, "a b c d"), (3, "A b  c d"), (9, None), (7, ""), (None, "a b c d"), (8, long), (8, long), (1, "x y z w")])
    got = {(r[0], r[2]) for r in rows(S.simhash_components(table), "doc_id", "fingerprint", "component_id")}
    assert got == {(5, 3), (3, 3), (None, 3), (9, 7), (7, 7), (8, 8), (1, 1)}
    assert S.simhash_components(table).count() == 8
    assert S.simhash_components(table.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    more = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    edges = chain + star + more + chain[:5]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    # The same components in two steps: a few links first, the rest from what these join.
    rng.shuffle(edges)
    for cut in (0, len(edges) // 2, len(edges)):
        some, rest = (spark.createDataFrame(part, "a long, b long") for part in (edges[:cut], edges[cut:]))
        got = {r.node: r.root for r in grown(connected_components(some), rest).collect()}
        assert {n: got.get(n, n) for n in nodes} == want


def near_texts(rng, copies):
    words = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    texts = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for at in rng.sample(range(150), 2):
            own[at] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    return texts


def test_near_duplicates_against_brute_force(docs):
    rng = random.Random(4)
    texts = [t for _ in range(12) for t in near_texts(rng, rng.randint(0, 5))] + ["short one", "short one", "short two"]
    table = docs(list(enumerate(texts)))
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if N.similarity(texts[a], texts[b]) >= 0.8]
    assert len(pairs) > 10
    want = set(roots(range(len(texts)), pairs).values())
    kept = N.without_near_duplicates(table)
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    assert kept.columns == table.columns


def test_near_duplicates_of_odd_rows(docs, rows):
    table = docs([(1, None), (2, None), (None, None), (4, ""), (5, "a b"), (5, "a b"), (None, "a b"), (None, "q r s"), (None, "q r s")])
    assert rows(N.without_near_duplicates(table), "doc_id", "text") == sorted(
        [(1, None), (4, ""), (5, "a b"), (None, "q r s")], key=repr
    )
    assert N.without_near_duplicates(table.limit(0)).count() == 0


def kept_by_brute_force(texts):
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if N.similarity(texts[a], texts[b]) >= 0.8]
    return pairs, sorted(set(roots(range(len(texts)), pairs).values()))


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_among_texts_of_the_same_words(docs, block, monkeypatch):
    """All fingerprints are equal, so no candidate tells the orders apart."""
    monkeypatch.setattr(N.possible_pairs, "__defaults__", (0.8, block))
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(8):
        texts.append(" ".join(words))
        texts.append(" ".join(words[20:] + words[:20]))  # a block moved
        rng.shuffle(words)
        texts.append(" ".join(words))
        rng.shuffle(words)
    pairs, want = kept_by_brute_force(texts)
    assert len(pairs) == 8
    assert sorted(r.doc_id for r in N.without_near_duplicates(docs(list(enumerate(texts)))).collect()) == want


def test_near_duplicates_with_appended_truncated_and_moved_text(docs):
    rng = random.Random(7)
    texts = []
    for size in (20, 30, 60, 120, 400, 1500, 5000):
        for _ in range(4):
            words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(size)]  # most of them repeat
            fresh = [f"x{rng.randrange(10**9)}" for _ in range(size // 6)]
            cut, at = size // 6, rng.randrange(size // 2)
            texts.append(" ".join(words))
            texts.append(rng.choice([
                " ".join(words + fresh), " ".join(fresh + words), " ".join(words[:-cut]), " ".join(words[cut:]),
                " ".join(words[:at] + words[at + cut :] + words[at : at + cut]),
            ]))
    pairs, want = kept_by_brute_force(texts)
    assert len(pairs) >= 15
    assert sorted(r.doc_id for r in N.without_near_duplicates(docs(list(enumerate(texts)))).collect()) == want


def test_prefixes_of_near_duplicates_meet():
    rng = np.random.default_rng(8)
    for size in [*range(1, 40), 333]:
        both = np.unique(rng.integers(0, 2**63, 2 * size, dtype=np.uint64))
        common = both[: -(-8 * size // 10)]
        other = np.sort(rng.permutation(both)[: size // 3])
        for own in (both[:size], common):
            ranks = rng.integers(1, 9, len(other))
            assert np.intersect1d(N.prefix(both[:size], other, ranks), N.prefix(own, other, ranks)).size


def test_proposals_are_few_and_connect(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    pairs = N.propose(np.arange(3000), fps)
    assert len(pairs) < 3 * 3000
    assert len(set(roots(range(3000), [p[:2] for p in pairs]).values())) == 1


def test_bitmaps_never_hide_a_near_duplicate():
    """Bitmaps differ in no more places than texts in shingles, and pairs at the threshold always pass."""
    rng = random.Random(9)
    for case in range(200):
        words = [f"w{rng.randrange(60 if case % 2 else 5000)}" for _ in range(rng.randrange(1, 400))]
        other = list(words)
        for _ in range(rng.randrange(0, 12)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10)}"
        a, b = " ".join(words), " ".join(other)
        first, second = (N.shingle_hashes(t) for t in (a, b))
        marks = np.stack([np.frombuffer(N.bitmap(h), np.uint64) for h in (first, second)])
        apart = int(np.bitwise_count(marks[0] ^ marks[1]).sum())
        assert apart <= len(np.setxor1d(first, second))
        both = {
            "rid": np.array([1, 2]), "root": np.array([1, 2]), "size": np.array([len(first), len(second)], np.int32),
            "place": np.zeros(2, np.int32), "low": np.array([5, 5]), "own": np.zeros(2, np.int64), "marks": marks,
        }
        if N.similarity(a, b) >= 0.8:
            assert N.possible(both, True, True).tolist() == [[1, 2]]


def test_pairs_of_a_large_group_grow_with_its_members(spark):
    """Blocks of a key share a few members; they are not all held against each other."""
    import numpy as np

    from gavel.llm import neardup

    def count(n):
        rng = np.random.default_rng(n)
        prints = [[int(x ^ (1 << int(b))) for x, b in zip((5, 6, 7, 8), rng.integers(0, 62, 4))] for _ in range(n)]
        texts = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "rid long, f0 long, f1 long, f2 long, f3 long")
        pairs = neardup.candidates(texts, block=50)
        return pairs.count(), pairs.select("a").union(pairs.select("b")).distinct().count()

    (few, some), (many, every) = count(200), count(800)
    print("pairs", few, many)
    assert many < 5 * few and (some, every) == (200, 800)


def test_pairs_of_a_text_do_not_grow_with_its_group(spark):
    """A text meets its group under many keys; it keeps a few partners, not others under each of them."""
    from gavel.llm import neardup

    def count(n):
        rng = np.random.default_rng(n)
        prints = [[sum(1 << int(b) for b in rng.choice(24, rng.integers(3, 8), replace=False)) for _ in range(4)] for _ in range(n)]
        texts = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "rid long, f0 long, f1 long, f2 long, f3 long")
        return neardup.candidates(texts).count()

    few, many = count(150), count(600)
    print("pairs", few, many)
    assert few <= 8 * 150 and many <= 8 * 600
