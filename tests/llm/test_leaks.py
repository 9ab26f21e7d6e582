import pytest

from gavel.llm import decontaminate as D

ITEM = "If Anna walks 12 km to the old market and then Anna rides 30 km back home with Bob how far did she go"
PLAIN = "the quick brown animal jumps over some lazy creature near that quiet river bank while nobody looks"


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, PLAIN), (3, "too short to tell"), (4, None), (5, ""), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")


CASES = {
    1: (f"Before it. {ITEM}. After it", {(1, False)}),
    2: ("Now If Carl walks 7 km to the old market and then Carl rides 9 km back home with Dora how far did she go", {(1, True)}),
    # Anna became two different people: the slots do not agree.
    3: ("so If Carl walks 7 km to the old market and then Emil rides 9 km back home with Dora how far did she go", set()),
    4: (ITEM.lower(), {(1, False)}),
    5: (PLAIN.upper() + "!!", {(2, False)}),
    6: ("words " * 50 + PLAIN.replace(" ", "\n") + " words" * 50, {(2, False)}),
    7: (PLAIN[: len(PLAIN) // 2], set()),
    8: ("12 13 14 15 16 17 18 19 20 21 22 23", set()),
    9: (None, set()),
    10: ("", set()),
    11: ("filler " * 200_000 + PLAIN, {(2, False)}),
    12: ("too short to tell " * 5, set()),
}


def test_leaks(docs, benchmark):
    table = docs([(i, text) for i, (text, _) in CASES.items()] + [(None, PLAIN), (5, CASES[5][0])])
    got = {(r.doc_id, r.item_id, r.reworded) for r in D.leaks(table, benchmark).collect()}
    want = {(i, item, reworded) for i, (_, items) in CASES.items() for item, reworded in items}
    assert got == want | {(None, 2, False)}
    kept = D.without_leaks(table, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, items) in CASES.items() if not items]
    assert kept.columns == table.columns


def test_partial_leak(docs, benchmark):
    words = PLAIN.split()
    near = docs([(1, " ".join(words[2:15])), (2, " ".join(words[2:14]))])  # 6 and 5 windows
    assert [r.doc_id for r in D.leaks(near, benchmark).collect()] == [1]


COPIES = (
    "Add 12 13 14 15 16 17 18 19 20 21 22 23 24",
    "The Old Man And The Sea By Ernest Hemingway Was First Published In Havana",
    "We met Anna, Bob, Carl, Dora, Emil, Fritz, Gerda, Hans, Ida, Jakob and Karl",
    "Der Hund der Nachbarin jagt die Katze durch Garten, Hof, Keller, Haus, Wald und Feld",
)


def test_copies_where_templates_say_little(spark, docs):
    benchmark = spark.createDataFrame(list(enumerate(COPIES)), "item_id long, text string")
    table = docs([(i, f"Before it all. {text}. And after it") for i, text in enumerate(COPIES)] + [(9, "Add 12 13 14 15 16 17 1 2 3 4 5 6")])
    got = {(r.doc_id, r.item_id, r.reworded) for r in D.leaks(table, benchmark).collect()}
    assert got == {(i, i, False) for i in range(len(COPIES))}


def test_empty_tables(docs, benchmark):
    table = docs([(1, PLAIN)])
    assert D.leaks(table.limit(0), benchmark).count() == 0
    assert D.leaks(table, benchmark.limit(0)).count() == 0
    assert D.without_leaks(table, benchmark.limit(0)).count() == 1


def test_shuffle_join_beyond_the_broadcast_bound(docs, benchmark, monkeypatch):
    small = benchmark.select("item_id")
    assert D.checked_broadcast(small, 5) is small and D.checked_broadcast(small, 6) is not small


def test_only_documents_that_meet_an_item_get_slots(spark, monkeypatch):
    from gavel.llm import decontaminate as D

    item = "the red fox ran over 12 hills and then it slept under a very old tree"
    docs = spark.createDataFrame(
        [(1, f"before that {item} indeed"), (2, "nothing of the kind is said in this longer text about other things"), (None, item)], "doc_id long, text string"
    )
    seen, windows = [], D._windows
    monkeypatch.setattr(D, "_windows", lambda rows, keys, **more: (seen.append(rows.count()) if "text_hash" in keys else None) or windows(rows, keys, **more))
    found = D.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert seen == [2] and sorted((r.doc_id or 0, r.item_id, r.reworded) for r in found) == [(0, 7, False), (1, 7, False)]
