"""Near-duplicate texts by SimHash candidates and exact similarity.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard
similarity of THRESHOLD or more. Fingerprints of such shingles drift too far for
the Golay keys (see `simhash`): one changed word changes five of them. So the
candidates come from four independent 64-bit SimHashes over the set of words, by the
same Golay keys; every candidate is then held against the shingles themselves. They
differ in a few bits only where edits change few of the distinct words, which added,
dropped or often repeated words need not do.

Equal texts are one from the start. A key's members are shuffled to one bucket,
those of large keys to blocks of bounded size that share a few members, so that the
work grows no faster than the members; a bucket proposes, for every member, the
centre of its cluster and a member that is nearer than that, never all pairs. Of what
all its buckets propose, a text keeps its nearest partner and the centre of its largest
cluster for each of the four SimHashes, so that its pairs do not grow with its group.
In a few rounds each text's most promising pairs that still lead from one component
to another are verified; the others need not be, as the join below finds what they
could add.

Those candidates are a first pass only, as texts with the same words may be no
near-duplicates and near-duplicates may repeat some words more than others. An exact
join takes the rest: a text's shingles are ordered, the frequent ones last, and two
texts at THRESHOLD share one of the first n - ceil(THRESHOLD * n) + 1. Pairs of
different components that share such a shingle, and whose sizes and places allow the
similarity, and whose bitmaps differ in no more places than their shingles may, are
held against each other, neighbours first, then all that still lead from one component
to another. Links make components, and of each component the row
with the smallest id stays (a null id counts as the largest).

Defined cases: null texts are equal to each other and to no other text; texts of
fewer than five words are one shingle; rows that repeat id and text count as
copies, one stays; an empty table gives an empty result; all columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.components import connected_components, grown
from gavel.llm.decontaminate import checked_broadcast
from gavel.llm.rows import packed, text_of, unpacked
from gavel.llm.simhash import fuzzy_keys
from gavel.session import materialize, release

WIDTH, THRESHOLD = 5, 0.8
TABLES = 4  # independent fingerprints
NEAR_BITS = 10  # of 64: more than most near-duplicates differ in, fewer than strangers do
BLOCK = 1000
PIVOTS = 32  # members of a large key, about, that are in each of its blocks
BROADCAST_ROWS = 300_000  # of about 100 bytes
KEY_ROWS = 1_000_000  # of 16 bytes
MARKS = b".,;:!?\"'()"
SAMPLE, FREQUENT = 16, 200_000  # one text of so many is sampled for frequent shingles, of which so many are told apart
FIRST_ROUNDS = 2  # of verifying candidates; what they leave is found by the join all the same
LEAST = 3  # sampled texts with a frequent shingle; these numbers set the order of shingles only, not what is found
BITMAP = 512  # bits of a text's parity bitmap
SLACK = 1e-6  # for rounding in bounds, always towards more pairs


def word_prints(text: bytes | None) -> np.ndarray:
    """TABLES SimHashes of the set of words, without marks and ASCII case."""
    found = set((text or b"").lower().translate(None, MARKS).split())
    if not found:
        return np.zeros(TABLES, np.uint64)
    digest = xxhash.xxh3_128_digest
    bits = b"".join([digest(w, seed) for seed in range(TABLES // 2) for w in found])
    per_word = np.frombuffer(bits, np.uint8).reshape(TABLES // 2, len(found), 16)
    ones = np.unpackbits(per_word, axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(found), axis=1).reshape(-1).view(np.uint64)


def shingles(text: str) -> set[str]:
    words = text.encode().lower().split()
    if len(words) < WIDTH:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


def similarity(a: str, b: str) -> float:
    first, second = shingles(a), shingles(b)
    return len(first & second) / len(first | second)


def _digest() -> Column:
    """Identity of a text; a null text has one that no text has."""
    return F.unhex(F.coalesce(F.md5(F.col("text").cast("string")), F.lit("00")))


def _prints(docs: DataFrame) -> DataFrame:
    names = [f"f{t}" for t in range(TABLES)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            found = np.array([word_prints(t.as_py()) for t in texts], np.uint64).reshape(-1, TABLES).view(np.int64)
            columns = [part.column("digest"), part.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", *names])

    rows = docs.select(_digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return rows.mapInArrow(batches, "digest binary, doc_id long, " + ", ".join(f"{n} long" for n in names))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """rid, digest, the id that stays (`doc_id`), `same` (its rows with that id) and the fingerprints of each text."""
    first = [F.first(f"f{t}").alias(f"f{t}") for t in range(TABLES)]
    rows = _prints(docs).groupBy("digest", "doc_id").agg(F.count("*").alias("same"), *first)
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("keep")
    texts = rows.groupBy("digest").agg(keep, *first)
    return materialize(
        texts.select(F.monotonically_increasing_id().alias("rid"), "digest", "keep.none", "keep.doc_id", "keep.same", *[f"f{t}" for t in range(TABLES)]),
        "neardup-texts",
    )


def propose(rids: np.ndarray, fps: np.ndarray, near: int = NEAR_BITS) -> list[tuple[int, int, int, int]]:
    """(a, b, bits apart, size of the cluster around its centre or 0) of one bucket: fewer than three for each member."""
    pairs, left, reach = {}, np.arange(len(fps)), np.full(len(fps), 65)

    def add(one: int, other: int, bits: int, size: int) -> None:
        key = (min(rids[one], rids[other]), max(rids[one], rids[other]))
        pairs[key] = (bits, max(size, pairs.get(key, (0, 0))[1]))

    while len(left) > 1:
        bits = np.unpackbits(fps[left].view(np.uint8).reshape(-1, 8), axis=1)
        centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)[0]
        start = left[np.bitwise_count(fps[left] ^ centre).argmin()]
        todo, left = [start], left[left != start]
        while todo and len(left):
            at = todo.pop()
            apart = np.bitwise_count(fps[left] ^ fps[at])
            close = apart <= near
            found, bits, left = left[close], apart[close], left[~close]
            reach[found] = bits
            for x, n in zip(found.tolist(), bits.tolist()):
                add(int(at), x, n, len(found))
            todo += found.tolist()
    for at in range(0, len(fps), 256):
        apart = np.bitwise_count(fps[at : at + 256, None] ^ fps).astype(np.int64)
        own = np.arange(len(apart))
        apart[own, at + own] = 65
        best = apart.argmin(axis=1)
        bits = apart[own, best]
        for x in np.flatnonzero((bits <= near) & (bits < reach[at + own])).tolist():
            add(at + x, int(best[x]), int(bits[x]), 0)
    return [(*pair, *found) for pair, found in pairs.items()]


def candidates(texts: DataFrame, near: int = NEAR_BITS, block: int = BLOCK) -> DataFrame:
    """Pairs of rids (a, b) that share a key and differ in few `bits`, with the `size` of the cluster that b or a is centre of.

    At most two for every text and fingerprint, its most promising ones.
    """

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids = part.column("rid").to_numpy(zero_copy_only=False)
            for table in range(TABLES):
                fps = part.column(f"f{table}").to_numpy(zero_copy_only=False)
                for at in range(0, len(fps), 4096):
                    rows, keys = fuzzy_keys(fps[at : at + 4096].view(np.uint64))
                    rows += at
                    columns = [pa.array(keys | table << 26), pa.array(rids[rows]), pa.array(fps[rows])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "rid", "fp"])

    def proposed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            members = part.column("members")
            ends, flat = members.offsets.to_numpy(), members.values
            rids = flat.field("rid").to_numpy(zero_copy_only=False)
            fps = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            tables = part.column("table").to_pylist()
            pairs = [(t, *p) for t, i, j in zip(tables, ends[:-1], ends[1:]) for p in propose(rids[i:j], fps[i:j], near)]
            pairs = np.array(pairs, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in range(5)], ["table", "a", "b", "bits", "size"])

    prints = texts.select("rid", *[f"f{t}" for t in range(TABLES)])
    keys = prints.mapInArrow(keyed, "key long, rid long, fp long")
    large = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    # Powers of two, and hashes of the row alone, deal the same rows of several keys in the same way.
    large = large.select("key", "n", F.expr(f"shiftleft(1L, int(ceil(log2(n / {block}))))").alias("blocks"))
    buckets = (
        keys.join(large, "key", "left")
        .withColumn("pivot", F.expr(f"pmod(xxhash64(rid, 1), 1048576) * n < {PIVOTS} * 1048576D"))
        .withColumn("own", F.expr(
            "case when blocks is null then array(0L) when pivot then sequence(0L, blocks - 1) else array(pmod(xxhash64(rid), blocks)) end"
        ))
        .withColumn("own", F.explode("own"))
        .select(F.shiftright("key", 26).alias("table"), F.xxhash64("key", "own").alias("bucket"), F.struct("rid", "fp").alias("member"))
        .groupBy("table", "bucket").agg(F.sort_array(F.collect_list("member")).alias("members"))
        .where(F.size("members") > 1).select("table", "members")
    )
    apart = F.bit_count(F.expr("members[0].fp ^ members[1].fp"))
    buckets = buckets.where((F.size("members") > 2) | (apart <= near)).distinct()
    buckets = materialize(buckets, "neardup-buckets")
    first, second = F.expr("members[0].rid"), F.expr("members[1].rid")
    two = buckets.where(F.size("members") == 2).select(
        "table", first.alias("a"), second.alias("b"), apart.cast("long").alias("bits"), F.lit(1).cast("long").alias("size")
    )
    more = buckets.where(F.size("members") > 2).mapInArrow(proposed, "table long, a long, b long, bits long, size long")
    every = two.union(more).where("a < b").groupBy("table", "a", "b").agg(F.min("bits").alias("bits"), F.max("size").alias("size"))
    every = materialize(every, "neardup-proposed")
    pairs = materialize(_promising(every, "table"), "neardup-pairs")
    release(texts.sparkSession, buckets, every)
    return pairs


def _same_text() -> Column:
    return (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("doc_id"))


def _own() -> tuple[Column, Column]:
    return _digest().alias("own_digest"), F.col("doc_id").cast("long").alias("own_id")


def _promising(pairs: DataFrame, *by: str) -> DataFrame:
    """For every text (and value of `by`) its nearest partner and the centre of its largest cluster."""
    both = pairs.union(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "bits", "size"))
    best = both.groupBy("a", *by).agg(
        F.min(F.struct("bits", "b", "size")).alias("near"),
        F.max(F.struct("size", (-F.col("b")).alias("b"), (-F.col("bits")).alias("bits"))).alias("centre"),
    )
    centres = best.select("a", -F.col("centre.b"), -F.col("centre.bits"), "centre.size")
    chosen = best.select("a", "near.b", "near.bits", "near.size").union(centres)
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return chosen.groupBy(*ends).agg(F.min("bits").alias("bits"), F.max("size").alias("size"))


def _across(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs that lead from one component to another."""
    part = lambda end: stars.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    rooted = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    return rooted.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))


def shingle_hashes(text: str) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s) for s in shingles(text)], np.uint64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The first shingles of a text by rank and hash, one of which every text at `threshold` shares."""
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, ranks[at], 0)
    size = len(hashes)
    return hashes[np.lexsort((hashes, rank))[: size - math.ceil(threshold * size - SLACK) + 1]]


def bitmap(hashes: np.ndarray) -> bytes:
    """For each of BITMAP places whether an odd number of shingles falls there.

    A shingle that only one of two texts has changes one place, so two bitmaps
    differ in no more places than the texts in shingles.
    """
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefixes(whole: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, rid, size (shingles), place (of the key) and low (smallest hash) of the first shingles of every text, with its bitmap at the first."""

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py()).view(np.int64))], ["key"])

    some = whole.where(F.expr(f"pmod(xxhash64(rid), {SAMPLE}) = 0")).select("text").mapInArrow(sampled, "key long")
    often = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(FREQUENT)
    table = often.toArrow()  # two numbers a shingle, FREQUENT of them at most
    frequent, ranks = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = frequent.argsort()
    frequent, ranks = frequent[order], ranks[order]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rid, text in zip(part.column("rid").to_pylist(), part.column("text")):
                hashes = shingle_hashes(text.as_py())
                keys = prefix(hashes, frequent, ranks, threshold)
                n = len(keys)
                columns = [
                    keys.view(np.int64), np.full(n, rid), np.full(n, len(hashes), np.int32), np.arange(n, dtype=np.int32),
                    np.full(n, hashes[:1].view(np.int64)[0]),
                ]
                marks = pa.array([bitmap(hashes), *[None] * (n - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), marks], ["key", "rid", "size", "place", "low", "marks"])

    return whole.select("rid", "text").mapInArrow(rows, "key long, rid long, size int, place int, low long, marks binary")


def possible(members: dict[str, np.ndarray], every: bool, same_block: bool, threshold: float = THRESHOLD) -> np.ndarray:
    """Rows (a, b) of a bucket's members whose components differ and whose sizes and places allow `threshold`.

    Members share a shingle. If it is the first that two share, they share at most
    what follows it in either; if it is not, they meet in the bucket of the first.
    At `threshold` two texts differ in few shingles, and their bitmaps in no more places.
    Without `every`, only members that follow each other by `low` are paired.
    """
    order = np.lexsort((members["rid"], members["low"]))
    rid, root, size, place, own = (members[name][order] for name in ("rid", "root", "size", "place", "own"))
    marks = members["marks"][order]
    size = size.astype(np.int64)
    behind = size - place
    found = []
    for at in range(len(rid) - 1):
        to = slice(at + 1, None if every else at + 2)
        both = size[at] + size[to]
        fits = (root[to] != root[at]) & (np.minimum(size[to], size[at]) >= threshold * np.maximum(size[to], size[at]) - SLACK)
        fits &= (1 + threshold) * np.minimum(behind[to], behind[at]) >= threshold * both - SLACK
        if not same_block and every:
            fits &= own[to] != own[at]
        if fits.any():
            differ = np.bitwise_count(marks[to][fits] ^ marks[at]).sum(axis=1, dtype=np.int64)
            fits[fits] = (1 + threshold) * differ <= (1 - threshold) * both[fits] + SLACK
        others = rid[to][fits]
        found.append(np.stack([np.minimum(others, rid[at]), np.maximum(others, rid[at])], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def shared(keys: DataFrame, stars: DataFrame) -> DataFrame:
    """`keys` with their `root` and the `n` of the key, of keys that lie in more than one component."""
    rows = keys.join(checked_broadcast(stars.withColumnRenamed("node", "rid"), BROADCAST_ROWS), "rid", "left")
    rows = rows.withColumn("root", F.coalesce("root", "rid"))
    across = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return rows.join(checked_broadcast(across.where("lo < hi").select("key", "n"), KEY_ROWS), "key")


def possible_pairs(rows: DataFrame, every: bool, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) that `possible` finds under any key; large keys meet in blocks."""
    names = ["rid", "root", "size", "place", "low", "own", "marks"]

    def paired(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            members = part.column("members")
            ends, flat = members.offsets.to_numpy(), members.values
            columns = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in names[:-1]}
            marks = b"".join(flat.field("marks").to_pylist())
            columns["marks"] = np.frombuffer(marks, np.uint64).reshape(-1, BITMAP // 64)
            for i, j, same in zip(ends[:-1], ends[1:], part.column("same").to_pylist()):
                pairs = possible({name: c[i:j] for name, c in columns.items()}, every, same, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in range(2)], ["a", "b"])

    buckets = (
        rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
        .withColumn("own", F.expr("pmod(xxhash64(rid), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)") if every else F.array("own")))
        .groupBy("key", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"))
        .agg(F.collect_list(F.struct(*names)).alias("members"))
        .where(F.size("members") > 1).select("members", (F.col("lower") == F.col("upper")).alias("same"))
    )
    return buckets.mapInArrow(paired, "a long, b long").distinct()


def near_components(docs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of texts that are joined by pairs at least `threshold` alike; roots are not listed.

    First rounds hold the most promising candidates of every text against each
    other. Two rounds of the exact join follow, of neighbours and then of all pairs
    that still lead from one component to another; they miss nothing. Every round's
    links join the components found so far.
    """

    def alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pairs = part.column("texts")
            same = [len(p) == 2 and similarity(p[0].as_py(), p[1].as_py()) >= threshold for p in pairs]
            yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    def whole_of(some: DataFrame) -> DataFrame:
        rids = some.select("a").union(some.select("b")).distinct().withColumnRenamed("a", "rid")
        used = materialize(texts.join(rids, "rid").select("rid", "digest", "doc_id"), "neardup-used")
        found = read.join(checked_broadcast(used, BROADCAST_ROWS), _same_text()).select("rid", "text")
        found = materialize(found, "neardup-whole")
        release(spark, used)
        return found

    def verified(some: DataFrame, whole: DataFrame) -> DataFrame:
        ends = some.select("a", "b", F.explode(F.array("a", "b")).alias("rid"))
        both = ends.join(whole, "rid").groupBy("a", "b").agg(F.collect_set("text").alias("texts"))
        found = materialize(both.mapInArrow(alike, "a long, b long"), "neardup-links")
        release(spark)  # the shuffles of texts
        return found

    spark = docs.sparkSession
    read = docs.where("text is not null").select(*_own(), text_of())
    repeats = not texts.where("same > 1").isEmpty()
    pairs = candidates(texts)
    whole = whole_of(pairs)
    stars, rest, used = None, pairs, [pairs, whole]
    for at in range(FIRST_ROUNDS):
        if at:
            rest = _across(rest.join(chosen, ["a", "b"], "left_anti"), stars)
            rest = materialize(rest.select(*pairs.columns), "neardup-rest")
            used.append(rest)
        chosen = materialize(_promising(rest), "neardup-chosen")
        found = verified(chosen, whole)
        last, stars = stars, connected_components(found) if stars is None else grown(stars, found)
        used += [chosen, found, *([] if last is None else [last])]
    release(spark, *used)

    every_text = checked_broadcast(texts.where("digest <> unhex('00')").select("rid", "digest", "doc_id"), BROADCAST_ROWS)
    found = read.join(every_text, _same_text()).select("rid", "text")
    keys = prefixes(found, threshold)
    keys = materialize(keys.distinct() if repeats else keys, "neardup-prefixes")
    marks = materialize(keys.where("place = 0").select("rid", "marks"), "neardup-marks")
    columns = [c for c in keys.columns if c != "marks"]
    for every in (False, True):
        across = materialize(shared(keys.select(*columns), stars).select(*columns, "root", "n"), "neardup-keys")
        release(spark, keys)
        marked = across.join(checked_broadcast(marks, BROADCAST_ROWS), "rid")
        more = materialize(possible_pairs(marked, every, threshold), "neardup-possible")
        whole = whole_of(more)
        found = verified(more, whole)
        last, stars = stars, grown(stars, found)
        release(spark, more, whole, found, last)
        keys = across.drop("root", "n")
        keys._scratch_path = across._scratch_path
    release(spark, keys, marks)
    return stars


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of every component of near-duplicates, with all columns."""
    texts = distinct_texts(docs)
    stars = near_components(docs, texts, threshold)
    named = texts.join(stars, texts.rid == stars.node, "left").select(F.coalesce("root", "rid").alias("root"), "none", "doc_id", "digest", "same")
    stays = named.groupBy("root").agg(F.min(F.struct("none", "doc_id", "digest", "same")).alias("keep"))
    stays = materialize(stays.select("keep.digest", "keep.doc_id", "keep.same"), "neardup-stays")
    release(docs.sparkSession, texts)
    kept = packed(docs, *_own()).join(checked_broadcast(stays, BROADCAST_ROWS), _same_text())
    once = unpacked(kept.where("same = 1"))
    if stays.where("same > 1").isEmpty():
        return once
    return once.union(unpacked(kept.where("same > 1").dropDuplicates(["own_digest", "own_id"])))
