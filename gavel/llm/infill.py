"""Fill-in-the-middle transformation over UTF-8 bytes.

A text is cut into prefix, middle and suffix at code points that a hash of its id
picks, and written in the order prefix-suffix-middle (psm) or suffix-prefix-middle
(spm) behind marks, or left plain. Texts stay UTF-8 bytes from end to end. Cuts
convert between code points and bytes through a sparse index of exceptions: the
places of the characters of more than one byte and the bytes that they have in
excess. A cut's byte is its code point plus the excess of the exceptions before
it, found by binary search; spans of ASCII between exceptions are plain arithmetic
and cost nothing, so an ASCII text has an empty index.

`restore` goes the other way: it finds the marks in the bytes, converts the byte
cuts back to code points by the index of the text, and rebuilds the exact text.
Marks cannot arise at a joint, as a mark starts with its only `<`; a text that has
a mark of its own stays plain.

Defined cases: a null text is empty; an empty text is plain; a null id hashes as
empty; repeated rows are transformed alike, each; an empty table gives an empty
result; long texts are taken whole, a few rows at a time; extra columns are left
out. Tasks need no other rows, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMED, SPM = 90, 20  # of 100 texts, those that are cut, and of 100 of these, those in spm order
ROWS = 256


class Exceptions:
    """The characters of more than one byte of a UTF-8 text: where they are and what they have in excess."""

    def __init__(self, data: bytes):
        units = np.frombuffer(data, np.uint8)
        self.bytes = np.flatnonzero(units >= 0xC0)
        lead = units[self.bytes]
        # excess[i]: bytes in excess of one of the first i exceptions
        self.excess = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=self.excess[1:])
        self.points = self.bytes - self.excess[:-1]
        self.length = len(data) - int(self.excess[-1])

    def to_byte(self, point: int) -> int:
        """The byte at which a code point begins."""
        return point + int(self.excess[np.searchsorted(self.points, point, "left")])

    def to_point(self, byte: int) -> int:
        """The number of code points before a byte that begins one."""
        return byte - int(self.excess[np.searchsorted(self.bytes, byte, "left")])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4]) for at in range(0, 16, 4)]


def transform(data: bytes, doc_id: int | None, seed: int = 1, formed: int = FORMED, spm: int = SPM) -> tuple:
    """n, form, code points of prefix and middle (None if plain) and the output of a text."""
    index = Exceptions(data)
    n = index.length
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= formed or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    start, end = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = index.to_byte(start), index.to_byte(end)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if h4 % 100 < spm:
        return n, "spm", start, end - start, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", start, end - start, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> tuple:
    """Text, code points of prefix and middle (None if plain) of an output."""
    if form == "plain":
        return output, None, None
    opens, closes = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    turn = output.index(closes, len(opens))
    last = output.index(MIDDLE, turn + len(closes))
    head, tail, middle = output[len(opens) : turn], output[turn + len(closes) : last], output[last + len(MIDDLE) :]
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    text = b"".join((prefix, middle, suffix))
    index = Exceptions(text)
    start, end = index.to_point(len(prefix)), index.to_point(len(prefix) + len(middle))
    return text, start, end - start


def _mapped(rows: DataFrame, keep: list[str], inputs: tuple[str, ...], fn: Callable, schema: str) -> DataFrame:
    """The columns `keep` of each row and, from `fn` of `inputs`, those of `schema`, a few rows at a time."""
    added = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def column(values: list, kind: str) -> pa.Array:
        if kind == "string":
            return pa.array([v.encode() if isinstance(v, str) else v for v in values], pa.binary()).cast(pa.string())
        return pa.array(values, kinds[kind])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                piece = part.slice(at, ROWS)
                taken = [piece.column(c) for c in inputs]
                taken = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in taken]
                values = [fn(*row) for row in zip(*(c.to_pylist() for c in taken))]
                columns = [column(list(c), kind) for c, (_, kind) in zip(zip(*values), added)]
                kept = [piece.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *(n for n, _ in added)])

    own = ", ".join(f"{name} {kind}" for name, kind in rows.select(*keep).dtypes)
    return rows.mapInArrow(batches, f"{own}, {schema}")


def fill_in_middle(docs: DataFrame, seed: int = 1, formed: int = FORMED, spm: int = SPM) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _mapped(
        rows, ["doc_id"], ("text", "doc_id"), lambda data, doc_id: transform(data, doc_id, seed, formed, spm),
        "n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(outputs: DataFrame) -> DataFrame:
    """`outputs`, which has output and form, with restored (the text) and the cuts read back from the output."""
    return _mapped(
        outputs, outputs.columns, ("output", "form"), lambda output, form: restore(output, form.decode()),
        "restored string, restored_prefix long, restored_middle long",
    )
