"""Benchmark decontamination by templates.

Both sides become words without punctuation, in lower case. A word that starts
with a digit is the placeholder of a number, a unit behind a number that of a
unit, a capitalised word inside a sentence that of a name. Windows of WIDTH such
words are hashed; the documents' windows meet the benchmark's in a hash join. The
windows of one document that meet an item at the same distance are one sighting
of it. The values that the placeholders stand for, the slots, must agree there:
one value of the item always became the same value in the document, so a question
with other numbers or names is still found and a chance likeness of templates is
not. A sighting of MATCHES windows (or of all, in a shorter item) is a leak.

Benchmark windows also come with their names as plain words, so that a text in
lower case is found; windows with fewer than REAL plain words say too little as
templates and are left out. Besides, every window of both sides comes word for word,
without placeholders and whatever its words are, so that a copy is found where
templates say little (titles, lists of names or numbers) or where names are marked
otherwise. A sighting that the templates do not make a leak is one if MATCHES of
its windows (or all of the item's) meet either way. Everything is DataFrame work. The benchmark's distinct hashes are
broadcast only up to BROADCAST_ROWS of them, eight bytes each, and else joined by
a shuffle.

Defined cases: null and empty texts have no windows; an item with fewer than
WIDTH words matches nothing; documents that share id and text are judged as one
(a null id is an id of its own); repeated items count once per item_id; empty
tables give no leaks; extra columns stay (`without_leaks`) or are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.rows import packed, text_of, unpacked
from gavel.session import materialize

WIDTH, REAL, MATCHES = 8, 5, 6
BROADCAST_ROWS = 2_000_000
SPACE = r"\x20\x09-\x0D"
NAME = "¤"  # stands before a name until the words are replaced
UNITS = (
    "km m cm mm miles mile feet foot inches inch kg g mg pounds pound lbs tons ton liters liter litres litre ml "
    "gallons gallon hours hour minutes minute seconds second days day weeks week months month years year "
    "dollars dollar cents cent euros euro percent degrees degree kmh mph"
).split()


def words(text: Column | str) -> Column:
    """The words of a text, names marked."""
    marked = F.col(text).cast("string") if isinstance(text, str) else text
    for _ in range(2):  # names that follow each other share a letter
        marked = F.regexp_replace(marked, rf"([\p{{Ll}}\p{{N}},;:][{SPACE}]+)(\p{{Lu}}\p{{Ll}}+)", f"$1{NAME}$2")
    plain = F.lower(F.regexp_replace(marked, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{SPACE}]+", ""))
    return F.filter(F.split(plain, f"[{SPACE}]+"), lambda w: w != "")


def template(raw: str, names: bool = True) -> Column:
    """The words of column `raw` with placeholders; without `names`, names become plain words."""
    number = lambda w: w < ":"  # noqa: E731  digits stand before it, letters behind

    def placeholder(w: Column, i: Column) -> Column:
        name = F.lit("#p") if names else F.substring(w, 2, 1_000_000)
        unit = (i > 0) & w.isin(*UNITS) & number(F.element_at(raw, F.greatest(i, F.lit(1))))
        return F.when(number(w), F.lit("#n")).when(w.startswith(NAME), name).when(unit, F.lit("#u")).otherwise(w)

    return F.transform(raw, placeholder)


def literal(raw: str) -> Column:
    """The words of column `raw` as they are."""
    return F.transform(raw, lambda w: F.when(w.startswith(NAME), F.substring(w, 2, 1_000_000)).otherwise(w))


def _windows(rows: DataFrame, keys: list[str], names: bool = True) -> DataFrame:
    """keys, pos, hash, slots and exact of every window of column `text`; windows with placeholders also come word for word (`exact`)."""
    # Each explode of one element keeps the array from being computed again for every window.
    split = rows.select(*keys, F.explode(F.array(words("text"))).alias("raw")).where(F.size("raw") >= WIDTH)
    formed = split.select(*keys, "raw", F.explode(F.array(template("raw", names))).alias("form"))
    slots = F.zip_with("form", "raw", lambda f, r: F.when(f.startswith("#"), r).otherwise(""))
    some = F.exists("form", lambda f: f.startswith("#"))
    own = F.when(some, literal("raw")).alias("own")
    filled = formed.select(*keys, "form", F.explode(F.array(F.struct(F.when(some, slots).alias("values"), own))).alias("as"))
    filled = filled.select(*keys, "form", "as.values", "as.own")

    def window(i: Column) -> Column:
        parts, plain = ([F.get(words, i + k) for k in range(WIDTH)] for words in ("form", "own"))
        return F.struct(
            F.xxhash64(*parts).alias("hash"), F.array_join(F.slice("values", i + 1, WIDTH), " ").alias("slots"),
            F.when(F.col("own").isNotNull(), F.xxhash64(*plain)).alias("plain"),
        )

    every = F.transform(F.sequence(F.lit(0), F.size("form") - WIDTH), window)
    found = filled.select(*keys, F.posexplode(every).alias("pos", "window")).select(*keys, "pos", "window.*")
    form = F.struct("hash", "slots", F.lit(False).alias("exact"))
    word_for_word = F.struct(F.col("plain").alias("hash"), F.lit(None).cast("string").alias("slots"), F.lit(True).alias("exact"))
    both = F.when(F.col("plain") != F.col("hash"), F.array(form, word_for_word)).otherwise(F.array(form))
    return found.select(*keys, "pos", F.explode(both).alias("window")).select(*keys, "pos", "window.*")


def _meeting(rows: DataFrame, keys: list[str], hashes: DataFrame) -> DataFrame:
    """The keys of the texts that have a window among `hashes`; the windows are hashed, nothing else is made of them."""
    split = rows.select(*keys, F.explode(F.array(words("text"))).alias("raw")).where(F.size("raw") >= WIDTH)
    formed = split.select(*keys, "raw", F.explode(F.array(template("raw"))).alias("form"))
    some = F.exists("form", lambda f: f.startswith("#"))
    filled = formed.select(*keys, "form", F.explode(F.array(F.when(some, literal("raw")))).alias("own"))
    placed = filled.select(*keys, "form", "own", F.explode(F.sequence(F.lit(0), F.size("form") - WIDTH)).alias("pos"))
    form, plain = (F.xxhash64(*[F.get(of, F.col("pos") + k) for k in range(WIDTH)]) for of in ("form", "own"))
    both = F.when(F.col("own").isNull(), F.array(form)).otherwise(F.array(form, plain))
    return placed.select(*keys, F.explode(both).alias("hash")).join(checked_broadcast(hashes), "hash", "left_semi").select(*keys).distinct()


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, pos, hash, slots and exact of all telling windows, names both ways, and of all word for word.

    `windows` and `places` count the item's windows that tell something as templates and all of them.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    both = _windows(items, ["item_id"]).union(_windows(items, ["item_id"], names=False)).distinct()
    # A slot of a number, unit or name is a value, any other is empty.
    filled = F.size(F.filter(F.split("slots", " "), lambda v: v != ""))
    telling = F.coalesce(F.lit(WIDTH) - F.when(F.col("slots").isNotNull(), filled), F.lit(WIDTH)) >= REAL
    kept = both.where(F.col("exact") | telling)
    sizes = kept.groupBy("item_id").agg(
        F.count_distinct(F.when(~F.col("exact"), F.col("pos"))).alias("windows"), F.count_distinct("pos").alias("places")
    )
    return kept.join(sizes, kept.item_id.eqNullSafe(sizes.item_id)).drop(sizes.item_id)


def checked_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` to be broadcast if it has at most so many rows; else as it is, for a shuffle join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def sightings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, matched (windows) and reworded (a slot differs) of every leak."""
    known = materialize(benchmark_windows(benchmark), "leak-windows")
    hashes = materialize(known.select("hash").distinct(), "leak-hashes")
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of())
    # Few documents share a window with an item; only theirs get their slots and places.
    near = materialize(_meeting(rows, ["doc_id", "text_hash"], hashes).withColumnsRenamed({"doc_id": "near_id", "text_hash": "near_hash"}), "leak-near")
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & F.col("text_hash").eqNullSafe(F.col("near_hash"))
    rows = rows.join(checked_broadcast(near), same, "left_semi")
    met = _windows(rows, ["doc_id", "text_hash"]).join(checked_broadcast(hashes), "hash")
    item = known.select("hash", "item_id", "windows", "places", F.col("pos").alias("place"), F.col("slots").alias("wanted"), F.col("exact").alias("copied"))
    paired = met.join(item, "hash").withColumn("apart", F.col("pos") - F.col("place"))
    slots = F.arrays_zip(F.split("wanted", " ").alias("was"), F.split("slots", " ").alias("now"))
    pairs = F.coalesce(F.filter(slots, lambda s: s["was"] != ""), F.array().cast("array<struct<was:string,now:string>>"))
    one = paired.groupBy("doc_id", "text_hash", "item_id", "apart").agg(
        F.collect_set("place").alias("met"), F.collect_set(F.when(~(F.col("exact") | F.col("copied")), F.col("place"))).alias("formed"),
        F.first("windows").alias("windows"), F.first("places").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),  # as many as the item has slots, at most
    )
    steady = F.size(F.array_distinct(F.transform("pairs", lambda s: s["was"]))) == F.size("pairs")
    formed, met = F.size("formed"), F.size("met")
    by_form = (formed > 0) & (formed >= F.least(F.lit(MATCHES), "windows"))
    matched = F.when(by_form, formed).when(met >= F.least(F.lit(MATCHES), "places"), met).cast("long")
    found = one.withColumn("matched", matched).where(steady & F.col("matched").isNotNull())
    return found.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("matched").alias("matched"), F.max(F.exists("pairs", lambda s: s["was"] != s["now"])).alias("reworded")
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched and reworded: the benchmark items each document gives away."""
    return sightings(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("reworded").alias("reworded")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that give away no item, with all their columns."""
    found = materialize(sightings(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    rows = packed(docs, F.col("doc_id").alias("own_id"), F.xxhash64(text_of()).alias("own_hash"))
    same = F.col("own_hash").eqNullSafe(F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    return unpacked(rows.join(checked_broadcast(found), same, "left_anti"))
