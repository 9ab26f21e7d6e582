import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavel.llm import infill


def brute(text, doc_id):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[at : at + 8], 16) for at in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", i, j - i, f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(st.sampled_from("a<>PSM é日🙂́\r\n"), max_size=40), st.integers(-5, 400))
def test_texts_survive(text, doc_id):
    made = infill.transform(text.encode(), doc_id)
    want = brute(text, doc_id)
    assert (*made[:4], made[4].decode()) == want
    assert infill.restore(made[4], made[1]) == (text.encode(), *want[2:4])


@given(st.text(max_size=60))
def test_index_converts_both_ways(text):
    data = text.encode()
    index = infill.Exceptions(data)
    assert index.length == len(text) and len(index.bytes) == sum(ord(c) > 127 for c in text)
    for point in range(len(text) + 1):
        byte = len(text[:point].encode())
        assert index.to_byte(point) == byte and index.to_point(byte) == point


def test_documents(spark, docs, rows):
    texts = ["", None, "plain ascii " * 9, "ünïcödé 日本語 🙂 " * 30, "with a <S> mark", "<", "<S", "é", "x" * 300_000 + "日" * 300_000]
    table = [(i, texts[i % len(texts)]) for i in range(90)] + [(None, "no id"), (3, texts[3]), (3, texts[3])]
    got = infill.restored(infill.fill_in_middle(docs(table))).withColumn("output", F.sha2("output", 256)).withColumn("restored", F.sha2("restored", 256))

    def sha(text):
        return hashlib.sha256((text or "").encode()).hexdigest()

    want = [(i, *(w := brute(t, i))[:4], sha(w[4]), sha(t), *w[2:4]) for i, t in table]
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored", "restored_prefix", "restored_middle")
    assert rows(got, *names) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.restored(infill.fill_in_middle(docs(table).limit(0))).count() == 0
