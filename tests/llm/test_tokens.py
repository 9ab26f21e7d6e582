import numpy as np
import pytest

from gavel.llm import tokens as K


def test_allocation_rules():
    ends = np.array([3, 5, 9, 10])  # tokens [0,3) [3,5) [5,9) [9,10)
    sections = np.array([4, 6, 10])
    assert K.allocate(ends, sections).tolist() == [2, 1, 1]
    assert K.allocate(ends, sections, "most").tolist() == [2, 0, 2]
    assert K.allocate(np.array([], np.int64), np.array([0])).tolist() == [0]
    with pytest.raises(ValueError):
        K.allocate(ends, sections, "last")


def test_counts_against_the_other_library(spark, docs):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = {1: "Hello world\n\nSecond line <|endoftext|> é日本\nlast", 2: "no newline", 3: "ends\n", 4: "a " * 100_000 + "\nb", 5: "日本語\n\nテスト🙂 x"}
    table = docs([*texts.items(), (6, None), (7, ""), (2, texts[2]), (None, "x")])
    for rule in K.RULES:
        got = K.section_counts(table, rule=rule).collect()
        for i, text in texts.items():
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.section, r.start))[:: 2 if i == 2 else 1]
            encoded = other.encode(text, add_special_tokens=False)
            assert {r.doc_tokens for r in own} == {len(encoded.ids)} and sum(r.tokens for r in own) == len(encoded.ids)
            assert [text[r.start : r.end] for r in own] == text.splitlines(keepends=True)
            if rule == "first":
                starts = [s for s, _ in encoded.offsets]
                assert [r.tokens for r in own] == [sum(r.start <= s < r.end for s in starts) for r in own]
        empty = [r for r in got if r.doc_id in (6, 7)]
        assert [(r.section, r.start, r.end, r.tokens, r.doc_tokens) for r in empty] == [(0, 0, 0, 0, 0)] * 2
    assert K.section_counts(table.limit(0)).count() == 0
