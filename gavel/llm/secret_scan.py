"""Secrets in texts: rules, and a battery of randomness tests for what no rule names.

Base spans come from rules: assignments of a password, token or key, access key
ids, and long hexadecimal runs. Beside them every run of MIN_CHARS or more
characters of base64's alphabets that holds a letter is a candidate. Its encoding
is the narrowest of ENCODINGS that has all its characters. Three tests ask whether
a random string of that encoding and length would look like it:

* alphabet uniformity: chi-squared of the characters' counts, with its exact mean
  A - 1 and variance 2 (A - 1)(1 - 1/L) for L characters of A kinds;
* runs: the number of runs of the alphabet's lower and upper half;
* serial correlation: of each character's place in the alphabet with the next one's.

The squares of the three standardised values add up to one distance from
randomness. It must be below CONSISTENT, which a random string exceeds once in a
thousand. A short string can pass by chance, so the second condition controls
false discoveries by length: every candidate comes with a decoy of its own length,
taken from the ordinary letters around it, that goes through the same tests. In
each stratum of lengths the limit is the largest distance up to which there are at
most RATE decoys for each candidate, so that of what is reported no more than
that share is expected to be ordinary text. A candidate that meets a base span is
that span's and is not added.

Everything is DataFrame work. Places come from the lengths of the pieces between
matches, added up by doubling steps, so a text with very many matches takes
n log n. Texts are read once and never shuffled; strata are combined as counts, and
at most 64 limits reach the driver.

Defined cases: a null or empty text has no spans; places are code points, ends
exclusive; a null id keeps its row; repeated rows are scanned alike, each; a text
without ordinary letters has no decoys; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.session import materialize

# The rules' patterns and least sizes.
ASSIGN = r"""(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

MIN_CHARS = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# From narrow to wide.
ENCODINGS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
    UPPER + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
    UPPER + LOWER + DIGITS + "+/-_",
)
KINDS = ("assign", "access", "hex", "random")
CONSISTENT = 16.27  # exceeded by chi-squared of three degrees of freedom once in a thousand
RATE = 0.01
BINS = 64  # of the distances below CONSISTENT


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value `combine` of it and all before it, in doubling steps."""

    def step(done: Column, power: Column) -> Column:
        shift = F.pow(F.lit(2.0), power).cast("int")
        further = F.transform(done, lambda x, i: F.when(i >= shift, combine(x, F.get(done, i - shift))).otherwise(x))
        return F.when(F.size(done) <= shift, done).otherwise(further)

    return F.aggregate(F.expr("sequence(0, 30)"), values, step)


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: structs of start, end (code points), word, and the gaps before and after it."""

    def placed(words: Column, gaps: Column) -> Column:
        # A match ends where all gaps and matches up to it end.
        sizes = F.transform(words, lambda w, i: F.length(F.get(gaps, i)) + F.length(w))
        return let(running(sizes, lambda x, y: x + y), lambda ends: F.transform(words, lambda w, i: F.struct(
            (F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"), w.alias("word"),
            F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"),
        )))

    none = F.array().cast("array<struct<start:int,end:int,word:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda words: F.when(F.size(words) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: placed(words, gaps))
    ))


def base_spans(text: Column) -> Column:
    """Structs of start, kind (its place in KINDS) and end of what the rules find."""

    def spans(kind: int, pattern: str, long_enough: Callable[[Column], Column]) -> Column:
        kept = F.filter(matches(text, pattern), lambda m: long_enough(m["word"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.concat(
        spans(0, ASSIGN, lambda w: F.length(F.regexp_extract(w, ASSIGN, 1)) >= ASSIGN_CHARS),
        spans(1, ACCESS, lambda w: F.length(w) >= ACCESS_CHARS),
        # Runs are as long as they can be, so that asking for the size at once finds the same ones.
        spans(2, f"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}", lambda w: F.lit(True)),
    )


def alphabet_of(word: Column) -> Column:
    """The narrowest of ENCODINGS that has all characters of a word, else null."""
    found = F.lit(None).cast("string")
    for alphabet in reversed(ENCODINGS):
        left_over = F.call_function("translate", word, F.lit(alphabet), F.lit(""))
        found = F.when(left_over == "", F.lit(alphabet)).otherwise(found)
    return found


def distance(word: Column) -> Column:
    """Sum of the squares of the battery's standardised values; null without an encoding or below two characters."""

    def tests(alphabet: Column) -> Column:
        kinds, size = F.length(alphabet).cast("double"), F.length(word).cast("double")
        counts = F.transform(F.split(alphabet, ""), lambda c: F.length(word) - F.length(F.replace(word, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda total, n: total + n.cast("double") * n)
        uniform = (kinds / size * squares - size - (kinds - 1)) / F.sqrt(2 * (kinds - 1) * (1 - 1 / size))

        half = F.floor(kinds / 2).cast("int")
        marks = F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.length(alphabet) - half))
        halves = F.call_function("translate", word, alphabet, marks)
        changes = sum(F.length(word) - F.length(F.replace(halves, F.lit(turn), F.lit(""))) for turn in ("01", "10")) / 2
        both = half / kinds * (1 - half / kinds)
        spread = (size - 1) * 2 * both * (1 - 2 * both) + 2 * (size - 2) * both * (1 - 4 * both)
        runs = (changes - (size - 1) * 2 * both) / F.sqrt(spread)

        middle = (kinds - 1) / 2
        places = F.transform(F.split(word, ""), lambda c: F.call_function("instr", alphabet, c) - 1 - middle)
        pairs = F.zip_with(places, F.slice(places, F.lit(2), F.length(word)), lambda x, y: x * F.coalesce(y, F.lit(0.0)))
        products = F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)
        serial = products / ((kinds * kinds - 1) / 12) / F.sqrt(size - 1)
        return F.pow(uniform, F.lit(2)) + F.pow(runs, F.lit(2)) + F.pow(serial, F.lit(2))

    return F.when(F.length(word) >= 2, let(alphabet_of(word), tests))


def stratum(size: Column) -> Column:
    """Half octaves of length."""
    return F.floor(2 * F.log2(size / F.lit(float(MIN_CHARS)))).cast("int")


def _bin(value: Column) -> Column:
    """Distances in steps; BINS for what is not consistent with randomness."""
    return F.least(F.floor(value / CONSISTENT * BINS), F.lit(BINS)).cast("int")


def _free(base: Column, candidates: Column) -> Column:
    """The candidates that meet no base span."""
    far = (1 << 31) - 1

    def apart(spans: Column) -> Column:
        ended = running(F.transform(spans, lambda s: F.when(s["at"] < 0, s["end"]).otherwise(-1)), F.greatest)
        starts = F.transform(spans, lambda s: F.when(s["at"] < 0, s["start"]).otherwise(far))
        coming = F.reverse(running(F.reverse(starts), F.least))
        return let(ended, lambda e: let(coming, lambda c: F.filter(
            spans, lambda s, i: (s["at"] >= 0) & (F.get(e, i) <= s["start"]) & (F.get(c, i) >= s["end"])
        )))

    def span(s: Column, at: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at"))

    every = F.concat(F.transform(base, lambda b: span(b, F.lit(-1))), F.transform(candidates, lambda c, i: span(c, i)))
    return let(F.array_sort(every), lambda spans: F.transform(apart(spans), lambda s: F.get(candidates, s["at"])))


def _judged(candidate: Column) -> Column:
    """Place, stratum and bin of a candidate, and the bin of its decoy (null without one)."""
    letters = F.concat(*[F.regexp_replace(candidate[side], "[^A-Za-z]+", "") for side in ("before", "after")])
    size = F.length(candidate["word"])
    decoy = let(letters, lambda s: F.when(F.length(s) >= size, F.substring(s, F.lit(1), size)))
    return F.struct(
        candidate["start"].alias("start"), candidate["end"].alias("end"), stratum(size).alias("stratum"),
        _bin(distance(candidate["word"])).alias("bin"),
        let(decoy, lambda d: F.when(d.isNotNull(), _bin(distance(d)))).alias("decoy"),
    )


def limits(judged: DataFrame, rate: float = RATE) -> DataFrame:
    """stratum and bound: the largest bin up to which decoys are at most `rate` of the candidates.

    Decoys are weighted to the number of candidates, as some have none.
    """
    seen = judged.select(F.explode("found").alias("c")).select("c.*")
    cells = seen.select("stratum", F.explode(F.array(
        F.struct(F.col("bin").alias("bin"), F.lit(1).alias("real"), F.lit(0).alias("fake")),
        F.struct(F.col("decoy").alias("bin"), F.lit(0).alias("real"), F.lit(1).alias("fake")),
    )).alias("c")).where("c.bin is not null").groupBy("stratum", "c.bin").agg(
        F.sum("c.real").alias("real"), F.sum("c.fake").alias("fake")
    )
    every = "over (partition by stratum)"
    up_to = "over (partition by stratum order by bin)"
    return cells.selectExpr(
        "stratum", "bin", f"sum(real) {up_to} AS real", f"sum(fake) {up_to} * sum(real) {every} / greatest(sum(fake) {every}, 1) AS fake"
    ).where((F.col("bin") < BINS) & (F.col("fake") <= F.lit(rate) * F.col("real"))).groupBy("stratum").agg(F.max("bin").alias("bound"))


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end; kind is a place in KINDS) of every document.

    `spans` are those of `base` and the added ones, by start and kind.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    candidates = F.filter(matches(text, CANDIDATE), lambda m: m["word"].rlike("[A-Za-z]"))
    scanned = rows.select("doc_id", let(base_spans(text), lambda base: let(candidates, lambda own: F.struct(
        base.alias("base"), F.transform(_free(base, own), _judged).alias("found")
    ))).alias("scan"))
    # Written as one struct: taken apart in the same plan, the scan would run once for each part.
    judged = materialize(scanned, "secret-spans").select("doc_id", "scan.*")
    bounds = {r.stratum: r.bound for r in limits(judged, rate).collect()}  # half octaves: 64 at most
    bound_of = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair]) if bounds else F.expr("cast(map() AS map<int,int>)")
    added = F.filter("found", lambda c: F.coalesce(c["bin"] <= F.try_element_at(bound_of, c["stratum"]), F.lit(False)))
    spans = F.concat("base", F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))))
    return judged.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def span_list(spans: Column | str) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
