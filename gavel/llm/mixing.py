"""Mix sources to target weights by entropy balancing.

Every document starts with rate one; its size is its number of words. Among all
rates that give each source its target of words, those closest to one in relative
entropy are exponential tilts min(cap, exp(lam * size / mean size of the source)),
one `lam` per source: the dual is convex and its gradient is the words taken less
the target. Safeguarded Newton steps find every `lam` at once, each step one
aggregation over the table of (source, size, documents). Rates then become whole
copies: per size class the total is rounded, the remaining words per source are
settled by single copies from the largest that fits downwards, and the copies of
a class are dealt over its documents by hash.

Targets: the sources, by code point and null last, weigh `weights` in turn and
share all words; a target stops at `cap` times its source's words, and the excess
goes to the others by weight.

Documents are counted into size classes before anything else meets them, so a
source with a third of all rows is some thousand rows; classes are dealt to
documents in parts of about PART documents. All state is tables in the shared folder,
and one number a step reaches the driver.

Defined cases: a null, empty or blank text has size zero, takes zero words and
never bounds a source; a null source is a source of its own; a source without
words has target zero; null ids are dealt like any other; rows that repeat an id
are documents of their own, and of rows that repeat id and text as many get a copy
more as the target asks for; an empty table gives an empty result; extra columns
are kept by `mix` and left out by `mix_table`. Reruns agree: only sizes, ids and
seeded hashes decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.decontaminate import checked_broadcast
from gavel.llm.rows import packed, unpacked
from gavel.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (1, 2, 3), 3
STEPS = 80  # Newton steps, with bisection as the guard; about ten are used
SETTLED = 1e-7  # relative distance to the target at which a source is done
ROUNDS = 6  # of settling the words left by rounding
PART = 4096  # documents of a class that are ranked together


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pick() -> Column:
    """A document's place in the draw: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and pick, the narrow table that everything else works on."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), _pick().alias("pick"))


def targets(classes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, unit (mean size) and target from the classes (source, size, n).

    In the order of their words per weight, the level (words left over weights
    left) rises as long as sources are at their cap; the first that is not sets
    the level of all that follow. One window over one row a source.
    """
    sums = classes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")
    )
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    upto = by_room.rowsBetween(Window.unboundedPreceding, 0)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    top, weight = F.col("top"), F.col("weight")
    left = F.sum("top").over(Window.partitionBy()) / cap - F.sum(top).over(upto) + top
    weighed = (
        sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
        .withColumn("top", F.col("source_size") * float(cap))
        .withColumn("room", top / weight)
        .withColumn("level", left / (F.sum(weight).over(Window.partitionBy()) - F.sum(weight).over(upto) + weight))
        .withColumn("open", F.max(F.col("room") > F.col("level")).over(upto))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("room", "source", "level"))).over(Window.partitionBy())["level"])
    )
    return weighed.select(
        "source", "source_size", (F.col("source_size") / F.col("docs")).alias("unit"),
        F.when(F.col("open"), F.col("level") * weight).otherwise(top).alias("target"),
    )


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on a source that may be null; the right one's column goes."""
    return left.join(right, left.source.eqNullSafe(right.source)).drop(right.source)


def tilts(classes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """`goals` with `lam`, the tilt that meets each target; null where none is needed or finite."""
    none = F.lit(None).cast("double")
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(cap))
    state = goals.select("*", F.when(open_, 0.0).alias("lam"), none.alias("lo"), none.alias("hi"), (~open_).alias("done"))
    state = materialize(state, "mix-state")
    worded = classes.where("size > 0")
    for _ in range(STEPS):
        todo = state.where("not done")
        if todo.isEmpty():
            return state.drop("lo", "hi", "done")
        x = F.col("size") / F.col("unit")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(99.0)))
        words = F.col("n") * F.col("size")
        sums = _on_source(worded, todo.select("source", "unit", "lam")).groupBy("source").agg(
            F.sum(words * F.least(rate, F.lit(float(cap)))).alias("taken"),
            F.sum(F.when(rate < cap, words * rate * x).otherwise(0.0)).alias("slope"),
        )
        gap, lam, lo, hi = F.col("taken") - F.col("target"), F.col("lam"), F.col("lo"), F.col("hi")
        step = lam - gap / F.nullif("slope", F.lit(0.0))
        inside = (step > F.coalesce(lo, F.lit(float("-inf")))) & (step < F.coalesce(hi, F.lit(float("inf"))))
        guard = F.coalesce((lo + hi) / 2, F.when(lo.isNull(), F.least(2 * hi, F.lit(-1.0))), F.greatest(2 * lo, F.lit(1.0)))
        moved = (
            _on_source(todo, sums)
            .withColumn("lo", F.when(gap < 0, lam).otherwise(lo))
            .withColumn("hi", F.when(gap > 0, lam).otherwise(hi))
            .withColumn("done", (F.abs(gap) <= SETTLED * F.col("target")) | F.coalesce(hi - lo < 1e-12, F.lit(False)))
            .withColumn("lam", F.when(F.col("done"), lam).when(inside, step).otherwise(guard))
        )
        state = materialize(state.where("done").unionByName(moved.select(*state.columns)), "mix-state")
    raise RuntimeError(f"no tilt after {STEPS} steps")


def _copies(classes: DataFrame, tilted: DataFrame, cap: int) -> DataFrame:
    """The classes with `copies`, whole numbers that together meet the targets."""
    mine = Window.partitionBy("source")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("source_size") * float(cap), float(cap)).otherwise(
        F.least(F.exp(F.least(F.coalesce("lam", F.lit(0.0)) * F.col("size") / F.col("unit"), F.lit(99.0))), F.lit(float(cap)))
    )
    most = F.col("n") * cap
    rows = _on_source(classes, tilted).withColumn("copies", F.least(F.round(F.col("n") * rate).cast("long"), most))
    for _ in range(ROUNDS):
        left = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(mine)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left")) & (
            F.when(F.col("left") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        )
        filled = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(mine.orderBy(F.col("size").desc()))
        rows = rows.withColumn("left", left).withColumn("fits", fits).withColumn("filled", filled)
        change = F.when(F.col("fits") & (F.col("filled") <= F.abs("left")), F.signum("left").cast("long")).otherwise(0)
        rows = rows.withColumn("copies", F.col("copies") + change).drop("left", "fits", "filled")
    return rows.select("source", "size", "n", "source_size", "target", "copies")


def _on_class(rows: DataFrame, classes: DataFrame, how: str = "inner") -> DataFrame:
    same = rows.source.eqNullSafe(classes.source) & (rows["size"] == classes["size"])
    return rows.join(classes, same, how).drop(classes.source, classes["size"])


def deals(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, size, source_size, target, base and cut: a document gets base copies, and one more up to the cut.

    The cut is the pick of the last document that gets one more: counts of equal
    ranges of picks find its range, and only that range is ranked.
    """
    classes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    goals = materialize(targets(classes, weights, cap), "mix-targets")
    whole = _copies(classes, tilts(classes, goals, cap), cap)
    base = F.floor(F.col("copies") / F.col("n"))
    whole = whole.withColumn("base", base).withColumn("more", F.col("copies") - F.col("base") * F.col("n"))
    whole = materialize(whole.withColumn("parts", F.ceil(F.col("n") / F.lit(PART))).drop("copies", "n"), "mix-copies")
    part = F.expr("(shiftright(pick, 32) * parts) div 2147483648L")
    drawn = _on_class(rows, whole.where("more > 0").select("source", "size", "more", "parts")).withColumn("part", part)
    upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = drawn.groupBy("source", "size", "part", "more").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    hit = counts.where("more <= upto and more > upto - n").select("source", "size", "part", (F.col("more") - F.col("upto") + F.col("n")).alias("rank"))
    near = drawn.drop("more", "parts").alias("d").join(
        hit.alias("h"), F.expr("d.source <=> h.source and d.size = h.size and d.part = h.part")
    ).select("d.source", "d.size", "d.pick", "rank")
    # Equal picks count as one, so that very many equal rows are one row here.
    equal = near.groupBy("source", "size", "pick", "rank").agg(F.count("*").alias("tied"))
    below = F.sum("tied").over(Window.partitionBy("source", "size").orderBy("pick")) - F.col("tied")
    placed = equal.withColumn("extra", F.col("rank") - below).where("extra between 1 and tied")
    cuts = placed.select("source", "size", F.col("pick").alias("cut"), "extra", "tied")
    return materialize(_on_class(whole.drop("more", "parts"), cuts, "left"), "mix-deals")


def _dealt(rows: DataFrame, deal: DataFrame) -> DataFrame:
    """`rows`, which have own_source, own_size and pick, with the columns of their class and `copies`.

    Of rows that tie at the cut the first `extra` get one copy more, in the order
    of the parts that they are read in: they agree in id and text, so it does not
    matter which. Each part counts its own.
    """
    same = F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    joined = rows.join(checked_broadcast(deal), same)
    up_to_cut = F.coalesce(F.col("pick") <= F.col("cut"), F.lit(False))
    copies = F.col("base") + F.col("more").cast("long")
    if deal.where("extra < tied").isEmpty():
        return joined.withColumn("more", up_to_cut).withColumn("copies", copies)
    split = F.coalesce((F.col("pick") == F.col("cut")) & (F.col("extra") < F.col("tied")), F.lit(False))
    ties = joined.where(split).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ties = materialize(ties, "mix-ties")
    parts = ties.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n")
    parts = materialize(parts.withColumn("before", before), "mix-parts").alias("p")
    found = ties.alias("t").join(checked_broadcast(parts), F.expr("t.source <=> p.source and t.size = p.size and t.part = p.part"))
    number = F.row_number().over(Window.partitionBy("t.source", "t.size", "t.part").orderBy("t.at")) + F.col("before")
    found = found.withColumn("more", number <= F.col("extra")).select(*[f"t.{c}" for c in joined.columns], "more")
    return joined.where(~split).withColumn("more", up_to_cut).unionByName(found).withColumn("copies", copies)


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    rows = materialize(sizes(docs), "mix-sizes")
    own = rows.select("doc_id", F.col("source").alias("own_source"), F.col("size").alias("own_size"), "pick")
    return _dealt(own, deals(rows, weights, cap)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with `copy` from 1 behind its columns.

    A column `copy` of the input gives way.
    """
    docs = docs.drop("copy")
    rows = materialize(sizes(docs), "mix-sizes")
    own = packed(docs, F.col("source").cast("string").alias("own_source"), word_count("text").alias("own_size"), _pick().alias("pick"))
    found = _dealt(own, deals(rows, weights, cap)).where("copies > 0")
    return unpacked(found, F.explode(F.expr("sequence(1, int(copies))")).alias("copy"))
