"""Token counts of sections by offset mapping.

A document is encoded once, as a whole, so tokens are those that a model would
see. Every token covers a span of characters; sections cover spans as well, and
tokens go to sections by an interval join. A token across a boundary is allocated
by an explicit rule: `first`, to the section of its first character, or `most`, to
the section with most of its bytes, the earlier one in a tie. Either way each
token counts once, and the sections' counts add up to the document's.

Spans are kept in UTF-8 bytes inside a task, as a token may end inside a
character, and reported in characters.

Defined cases: a null or empty text is one empty section without tokens; repeated
rows are counted each; an empty table gives an empty result; strings that look
like special tokens are ordinary text; extra columns are left out. The
vocabulary's path is a parameter, readable on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this public vocabulary's merges were made behind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most")
SCHEMA = "doc_id long, section int, start long, end long, tokens long, doc_tokens long"


@cache
def encoder(path: str, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file and the size in bytes of each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_ends(data: bytes) -> np.ndarray:
    """Ends, in bytes, of the lines of a text, each with its newline; one for an empty text."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section; both lists of ends ascend and cover the text without gaps."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    if rule == "most":
        last = np.searchsorted(section_ends, token_ends - 1, "right")
        for i in np.flatnonzero(last > first):
            cuts = np.clip(section_ends[first[i] : last[i] + 1], starts[i], token_ends[i])
            first[i] += int(np.diff(cuts, prepend=starts[i]).argmax())
    return np.bincount(first, minlength=len(section_ends))


def section_counts(docs: DataFrame, path: str = VOCABULARY, rule: str = "first", ends: Callable[[bytes], np.ndarray] = line_ends) -> DataFrame:
    """doc_id, section (from 0), start and end in characters, tokens, and the document's tokens."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(path)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece, columns = part.slice(at, 256), []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    data = (text or "").encode()
                    token_ends = np.cumsum(sizes[encoding.encode_ordinary(text or "")])
                    places = ends(data)
                    counts = allocate(token_ends, places, rule)
                    letters = places
                    if len(data) != len(text or ""):  # places in characters: bytes that begin one
                        letters = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))[places]
                    columns.append((doc_id, letters, counts, len(token_ends)))
                n = [len(c[1]) for c in columns]
                letters = [c[1] for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c[0] for c, k in zip(columns, n) for _ in range(k)], pa.int64()),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])),
                        pa.array(np.concatenate([np.append(0, x[:-1]) for x in letters]).astype(np.int64)),
                        pa.array(np.concatenate(letters).astype(np.int64)),
                        pa.array(np.concatenate([c[2] for c in columns]).astype(np.int64)),
                        pa.array(np.repeat([c[3] for c in columns], n).astype(np.int64)),
                    ],
                    ["doc_id", "section", "start", "end", "tokens", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, SCHEMA)
