"""SimHash near-duplicates by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each seen
as a 23-bit word. The binary Golay code is perfect: every 23-bit word lies within
three flips of exactly one codeword, whose index is its key. Two fingerprints at
four or fewer differing bits agree, up to two bits in all, on two of their three
segments (the segment with most differences is left out). A word halfway between
the two pairs of segments is then at most one flip from either, so the keys of
all single flips of a pair of segments meet: at most eleven keys of 24 bits for
each of the three pairs, and no link is lost. Fingerprints that share a key are
verified by their exact distance.

Equal fingerprints are one row from the start, so exact copies never meet each
other. Every key row is shuffled once to its bucket, so the work grows with the
fingerprints, not with chance meetings; large keys are dealt in blocks of bounded
size, each pair of blocks a bucket. A bucket returns a spanning forest of its
links, never all pairs.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a text with fewer words than `width` is one shingle; a null id takes part
in links but never names a component (a component without any id is null);
repeated rows stay repeated; an empty table gives an empty result; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.components import connected_components
from gavel.session import materialize

SEED = 42
GENERATOR = 0b110001110101  # of the (23, 12) binary Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, width)
MAX_BITS = 4  # the distance that the keys above cover without loss
BLOCK = 2000  # fingerprints of one key that are compared in one go


def text_fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the lower-cased word shingles of a UTF-8 text, 0 without words."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())),
        np.uint64, len(starts),
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            found = np.fromiter((text_fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, fp long")


@cache
def golay_index() -> np.ndarray:
    """For every 23-bit word the index of the one codeword within three flips."""
    data = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(data >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = {0}
    for _ in range(3):
        errors |= {e ^ int(b) for e in errors for b in one}
    index = np.empty(1 << 23, np.uint16)
    for error in errors:
        index[words ^ np.uint32(error)] = data
    return index


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: fingerprints within MAX_BITS of each other share a key."""
    index, near, exact = golay_index(), [], []
    for first, width in SEGMENTS:
        word = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.uint32)
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        near.append(index[word[:, None] ^ flips].astype(np.int64))
        exact.append(near[-1][:, :1])
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = np.concatenate([near[a] << 12 | exact[b], exact[a] << 12 | near[b]], axis=1)
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(both[new] | pair << 24)
    return np.concatenate(rows), np.concatenate(keys)


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, edges = members, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            close = np.bitwise_count(left ^ at) <= max_bits
            if close.any():
                found, left = left[close], left[~close]
                edges += [(at, x) for x in found]
                todo += list(found)
    return edges


def _keys(groups: DataFrame) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                fps = part.column("fp").to_numpy(zero_copy_only=False)[at : at + 4096]
                rows, keys = fuzzy_keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys)], ["fp", "key"])

    return groups.select("fp").mapInArrow(batches, "fp long, key long")


def links(groups: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) edges that connect distinct fingerprints exactly as all links would."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys cover distances up to {MAX_BITS}")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            members = part.column("members")
            ends, flat = members.offsets.to_numpy(), members.values.to_numpy(zero_copy_only=False).view(np.uint64)
            edges = [e for i, j in zip(ends[:-1], ends[1:]) for e in forest(np.unique(flat[i:j]), max_bits)]
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    keys = _keys(groups)
    large = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    dealt = (
        keys.join(large.select("key", F.ceil(F.col("n") / F.lit(block)).alias("blocks")), "key", "left")
        .withColumn("own", F.expr("if(blocks is null, 0L, pmod(xxhash64(fp), blocks))"))
        .withColumn("other", F.explode(F.expr("if(blocks is null, array(0L), sequence(0L, blocks - 1))")))
        # One key of its own for each pair of blocks, so that they spread over the tasks.
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
        .groupBy("bucket").agg(F.collect_list("fp").alias("members"))  # two blocks at most
    )
    apart = F.bit_count(F.expr("members[0] ^ members[1]")) > max_bits
    found = dealt.where((F.size("members") > 1) & ~((F.size("members") == 2) & apart)).select("members")
    return found.mapInArrow(batches, "a long, b long").distinct()


def fuzzy_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp and component_id, the smallest doc_id of the fingerprints reachable by links."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-groups")
    stars = connected_components(links(groups, max_bits))
    members = groups.join(stars, groups.fp == stars.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = members.groupBy("root").agg(F.min("first").alias("component_id"))
    return members.join(names, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    return prints.join(fuzzy_components(prints, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
