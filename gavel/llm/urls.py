"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits the host and its subdomains,
and the longest fitting rule decides. Where none fits, a logistic regression does:
its features are the character n-grams of host and path, hashed into a sparse
vector, learnt from a small labelled URL table. All of it is DataFrame and Spark
ML work; rules and the labelled table are configuration of a few rows and become
part of the plan, pages are never shuffled.

Defined cases: a null URL or one without `://` has an empty host and path, fits
no rule and is judged by the model's intercept; only A-Z of the host are
lower-cased; equally long rules go by their text; repeated rows are judged alike;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import local_table

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
NGRAMS = (3, 4, 5)
FEATURES = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled URL table: names of unwanted and of ordinary sites, each under the same hosts and paths.
BLOCKED = (
    "casino-royal free-casino win-casino24 casino best-bets free-betting sports-bets bets24 poker-win slots-online lottery-win "
    "cheap-pills pills-online buy-viagra cheap-meds adult-video adult-x adult-dating xxx-cams sex-chat porn-free payday-loans "
    "fast-loans replica-watch spam-links spam-mail link-farm ads-click ad-tracker track-ads free-crack warez-farm get-rich-win"
).split()
ALLOWED = (
    "news daily-post weather library museum university school city-council hospital recipes gardening travel history science "
    "wiki docs forum music-review film-blog books sport-news health-advice theatre report shop another nothing gathering "
    "thinking weathering the-thread the-other-hand together brothers reading notion station motion able-hands thousand "
    "mother northern earth southern fathers withstand heathland threshold then-and-there enthusiast"
).split()
HOSTS = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example")
PATHS = ("/en/1042", "/fr/88.html", "/de/731/", "/es/5600")


def parse(url: Column | str) -> tuple[Column, Column]:
    """Host and path of a URL column; both empty without `://`."""
    url = F.col(url).cast("string") if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits columns `host` and `path`, else null."""
    fits = [
        F.when(
            ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits, none))


def _ngrams(rows: DataFrame) -> DataFrame:
    """`rows` with `grams`: the n-grams of host and path, each told apart."""

    def grams(text: Column, mark: str, n: int) -> Column:
        # Of an array of characters, as a place in a string is found by walking there.
        def of(chars: Column) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
            return F.transform(places, lambda i: F.concat_ws("", F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))

        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return F.get(F.transform(F.array(F.split(marked, "")), of), F.lit(0))

    every = [grams(F.col(part), part[0], n) for part in ("host", "path") for n in NGRAMS]
    return rows.withColumn("grams", F.concat(*every))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table: url and verdict."""
    rows = [
        (f"http://{host.format(name)}{path}", verdict)
        for verdict, names in (("block", BLOCKED), ("allow", ALLOWED)) for name in names for host, path in zip(HOSTS, PATHS)
    ]
    return local_table(spark, rows, "url string, verdict string")


def _vectors(rows: DataFrame, url: str = "url") -> DataFrame:
    host, path = parse(url)
    grams = _ngrams(rows.withColumn("host", host).withColumn("path", path))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams).drop("grams")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """The regression of verdict `block` on the n-grams of a small table of (url, verdict)."""
    rows = _vectors(labelled).select("features", (F.col("verdict") == "block").cast("double").alias("label")).coalesce(1)
    return LogisticRegression(regParam=0.001, maxIter=100, standardization=False).fit(rows)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of `block`)."""
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = _vectors(pages.select("page_id", F.col("url").cast("string").alias("url")))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("fit", rule_of("host", "path", rules)).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score"
    )
