"""Queries that build, filter and check items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.arrays import (
    DISTRACTOR_DELTAS,
    DISTRACTOR_FACTORS,
    DISTRACTOR_RANGE,
    DISTRACTOR_SCALE,
    DISTRACTOR_STEPS,
    POOL_SIZES,
)
from gavel.functions.text import answer_index, answer_number
from gavel.operators import filters as W
from gavel.operators import items as I
from gavel.operators import ranking as R
from gavel.plans import views as V
from gavel.plans.registry import query
from gavel.plans.sql_views import NL, byte, sql, strip
from gavel.schemas import MAX_OPTIONS, validate_items, validate_predictions

IDEOGRAPHIC_SPACE = "　"


def joined(options: str = "options") -> Column:
    return F.array_join(options, "|").alias("options")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_LETTER = "substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1)"
_LETTERED = f"""
SELECT '{{d}}' AS dataset, '{{d}}:' || p_partkey AS id, p_name AS question,
       p_brand || '|' || p_type || '|size ' || p_size || '|' || p_name AS options,
       CAST(p_partkey % 4 AS INT) AS gold_index, p_type AS subject
FROM part"""


@query(
    _LETTERED.format(d="mmmlu_ja") + " UNION ALL " + _LETTERED.format(d="jmmlu")
)
def lettered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lettered options; answers in either case, padded with Unicode spaces."""
    part = V.table(spark, sf_dir, "part")
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    spaced = F.concat(F.lit(IDEOGRAPHIC_SPACE + " "), F.col("p_name"), F.lit("\n"))
    options = [
        F.col("p_brand").alias("A"),
        F.concat(F.lit(" "), "p_type").alias("B"),
        F.concat(F.lit("size "), "p_size").alias("C"),
        F.concat("p_name", F.lit(IDEOGRAPHIC_SPACE)).alias("D"),
    ]
    id_ = F.col("p_partkey").alias("id")
    upper = part.select(
        id_, spaced.alias("Question"), *options, letter.alias("Answer"),
        F.col("p_type").alias("Subject"),
    )
    lower = part.select(
        id_, spaced.alias("question"), *options,
        F.concat(F.lit(" "), F.lower(letter), F.lit(IDEOGRAPHIC_SPACE)).alias("answer"),
        F.col("p_type").alias("subject"),
    )
    built = _union(
        [I.build_items(upper, "mmmlu_ja", {}), I.build_items(lower, "jmmlu", {})]
    )
    return built.select(
        "dataset", "id", "question", joined(), "gold_index", F.col("metadata.subject").alias("subject")
    )


@query(
    """
SELECT 'xwinograd_ja:' || o_orderkey AS id, 'order ' || o_orderkey AS question,
       o_orderpriority || '|' || o_orderstatus AS options,
       CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 0 END AS gold_index
FROM orders"""
)
def two_option_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two options, answered by a 1-based number or by the option's text."""
    orders = V.table(spark, sf_dir, "orders")
    answer = F.element_at(
        F.array(F.lit("1"), F.lit("2"), F.col("o_orderpriority")),
        (F.col("o_orderkey") % 3 + 1).cast("int"),
    )
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order "), "o_orderkey").alias("sentence"),
        F.col("o_orderpriority").alias("option1"),
        F.col("o_orderstatus").alias("option2"),
        answer.alias("answer"),
    )
    return I.build_items(rows, "xwinograd_ja", {}).select("id", "question", joined(), "gold_index")


@query(
    """
SELECT o_orderkey,
       CASE o_orderkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2
            WHEN 4 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 ELSE 4 END AS from_text,
       CAST(o_orderkey % 5 AS INT) AS from_int, CAST(o_orderkey % 2 = 0 AS INT) AS from_bool
FROM orders"""
)
def answer_index_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter, 1-based, 0-based, full-width digit and option-text answers; typed answers."""
    orders = V.table(spark, sf_dir, "orders")
    options = F.array(*[F.lit(p) for p in V.PRIORITIES])
    forms = F.array(
        F.lit(" c "), F.lit("2"), F.lit("0"), F.lit("３"), F.col("o_orderpriority"), F.lit("E")
    )
    text = F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return orders.select(
        "o_orderkey",
        answer_index(text, T.StringType(), options).alias("from_text"),
        answer_index(F.col("o_orderkey") % 5, T.LongType(), options).alias("from_int"),
        answer_index(F.col("o_orderkey") % 2 == 0, T.BooleanType(), options).alias("from_bool"),
    )


_NAMED = {
    "where_text": "lang = 'en'",
    "where_int": "toxic = 1",
    "where_none": "toxic IS NULL",
    "where_two": "lang = 'fr' AND quality = 0",
    "in_text": "lang IN ('en', 'de')",
    "in_int": "quality IN (0, 1)",
    "in_none": "toxic IS NULL OR toxic = 1",
    "not_int": "toxic IS NULL OR toxic <> 1",
    "not_none": "toxic IS NOT NULL",
    "not_text": "lang <> 'en'",
}


@query(
    "WITH rows AS (SELECT d.doc_id, d.lang, l.toxic, l.quality FROM documents d "
    "LEFT JOIN labels l USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS filter, count(*) AS n, CAST(coalesce(sum(doc_id), 0) AS BIGINT) AS ids "
        f"FROM rows WHERE {c}"
        for n, c in _NAMED.items()
    )
    + " UNION ALL SELECT 'float_text', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem "
    "WHERE l_quantity = 23 UNION ALL SELECT 'float_as_int', 0, 0"
)
def where_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, membership and exclusion as text, with NULL kept by exclusion."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang").join(
        V.table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    lines = V.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    kept = {
        "where_text": W.where(rows, {"lang": "en"}),
        "where_int": W.where(rows, {"toxic": "1"}),
        "where_none": W.where(rows, {"toxic": None}),
        "where_two": W.where(rows, {"lang": "fr", "quality": 0}),
        "in_text": W.where_in(rows, {"lang": ["en", "de"]}),
        "in_int": W.where_in(rows, {"quality": [0, "1"]}),
        "in_none": W.where_in(rows, {"toxic": [None, 1]}),
        "not_int": W.where_not(rows, {"toxic": 1}),
        "not_none": W.where_not(rows, {"toxic": None}),
        "not_text": W.where_not(rows, {"lang": "en"}),
        "float_text": W.where(lines, {"l_quantity": 23.0}),
        "float_as_int": W.where(lines, {"l_quantity": 23}),
    }
    return _union(
        [
            df.agg(
                F.lit(name).alias("filter"),
                F.count(F.lit(1)).alias("n"),
                F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids"),
            )
            for name, df in kept.items()
        ]
    )


_LIMITS = {"prio_F": 30, "prio_O": 80, "prio_P": None}


@query(
    """
SELECT 'limit' AS phase, dataset, o_orderkey FROM (
  SELECT 'prio_' || o_orderstatus AS dataset, o_orderkey,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn <= 100
UNION ALL
SELECT 'smoke', dataset, o_orderkey FROM (
  SELECT 'prio_' || o_orderstatus AS dataset, o_orderkey,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn <= CASE dataset WHEN 'prio_F' THEN 30 ELSE 50 END"""
)
def per_dataset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of every dataset in source order; a smoke run takes the smaller limit."""
    rows = V.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("prio_"), "o_orderstatus").alias("dataset"), "o_orderkey"
    )
    limited = R.limit_per_dataset(rows, 100, "o_orderkey")
    smoke = R.smoke_limit(rows, _LIMITS, 50, "o_orderkey")
    return limited.select(F.lit("limit").alias("phase"), "*").unionByName(
        smoke.select(F.lit("smoke").alias("phase"), "*")
    )


@query(
    f"""
SELECT 'half:' || p_partkey AS id, '段階を選んでください。' || {NL} || '状態: ' || p_name || ' (' || p_brand || ')'
         AS question,
       CAST(trunc((p_partkey % 9 - 4) / 2) AS INT) + 2 AS gold_index FROM part"""
)
def offset_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal gold from a number truncated toward zero plus an offset; templated question."""
    rows = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_name", "p_brand",
        ((F.col("p_partkey") % 9 - 4) / 2).alias("raw"),
    )
    source = {
        "adapter": "score",
        "gold_field": "raw",
        "gold_offset": 2,
        "criteria": ["a", "b", "c", "d", "e"],
        "prompt": "段階を選んでください。",
        "question_template": " {p_name} ({p_brand})\n",
    }
    return I.build_items(rows, "half", source).select("id", "question", "gold_index")


@query(
    f"""
SELECT 'long:' || doc_id AS id, sha256(substr({strip("'本文: ' || text")}, 1, 200)) AS question_hash,
       CAST(length(substr({strip("'本文: ' || text")}, 1, 200)) AS INT) AS chars,
       CAST(n_chars >= 1000 AS INT) AS gold_index
FROM documents"""
)
def truncated_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`max_chars` cuts code points after formatting (the cut is the feature); minimum-based gold."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    source = {
        "adapter": "noul",
        "gold_field": "n_chars",
        "positive_min": 1000,
        "question_template": "本文: {text}",
        "max_chars": 200,
        "item_id_field": "doc_id",
    }
    return I.build_items(rows, "long", source).select(
        "id", F.sha2("question", 256).alias("question_hash"), F.length("question").alias("chars"),
        "gold_index",
    )


_ANSWER_TEXT = """CASE l_linenumber % 4 WHEN 0 THEN '計算 #### ' || CAST(l_quantity AS BIGINT)
 WHEN 1 THEN 'sum 1,000 then ' || CAST(l_extendedprice AS VARCHAR)
 WHEN 2 THEN '最初は3、答えは' || CAST(l_quantity AS BIGINT) || ',000'
 ELSE '#### -' || CAST(l_quantity AS BIGINT) || '.50 of 9' END"""


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
   WHEN 1 THEN CASE WHEN l_extendedprice = floor(l_extendedprice)
                    THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
                    ELSE regexp_replace(printf('%.6f', l_extendedprice), '\\.?0+$', '') END
   WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) * 1000 AS VARCHAR)
   ELSE '-' || CAST(l_quantity AS BIGINT) || '.5' END AS answer,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS declared
FROM lineitem"""
)
def numeric_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final-answer mark, last number, thousands separators, declared numbers."""
    lines = V.wide_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice",
    )
    whole = F.col("l_quantity").cast("bigint").cast("string")
    forms = F.array(
        F.concat(F.lit("計算 #### "), whole),
        F.concat(F.lit("sum 1,000 then "), F.format_string("%.2f", "l_extendedprice")),
        F.concat(F.lit("最初は3、答えは"), whole, F.lit(",000")),
        F.concat(F.lit("#### -"), whole, F.lit(".50 of 9")),
    )
    text = F.element_at(forms, F.col("l_linenumber") % 4 + 1)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        answer_number(text).alias("answer"),
        answer_number(text, F.col("l_quantity")).alias("declared"),
    )


def _text_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) "
        f"ELSE regexp_replace(printf('%.6f', {value}), '\\.?0+$', '') END"
    )


def _options_sql(dataset: str, count: int) -> str:
    """The distractor rule in SQL: draws from four pools, distinct, then hash order."""
    draws = min(32, 3 * count)
    scale = f"greatest(1.0, abs(v) * {DISTRACTOR_SCALE})"
    size = POOL_SIZES
    picks = []
    for t in range(draws):
        b = byte("h", str(t))
        if t % 4 == 0:
            deltas = "([" + ", ".join(str(float(d)) for d in DISTRACTOR_DELTAS) + "]::DOUBLE[])"
            picks.append(f"v + {deltas}[{b} % {size[0]} + 1]")
        elif t % 4 == 1:
            factors = "([" + ", ".join(str(f) for f in DISTRACTOR_FACTORS) + "]::DOUBLE[])"
            picks.append(f"v * {factors}[{b} % {size[1]} + 1]")
        elif t % 4 == 2:
            picks.append(f"v + ({b} % {size[2]} - {DISTRACTOR_RANGE})")
        else:
            i = f"({b} % {size[3]})"
            step = f"CASE WHEN {i} < {DISTRACTOR_STEPS} THEN -({i} + 1) ELSE {i} - {DISTRACTOR_STEPS - 1} END"
            picks.append(f"v + {scale} * ({step})")
    numbered = " UNION ALL ".join(
        f"SELECT id, v, gold, {t} AS t, {_text_sql('x')} AS o FROM (SELECT id, v, gold, {p} AS x FROM seeds)"
        for t, p in enumerate(picks)
    )
    return f"""
WITH seeds AS (
  SELECT DISTINCT '{dataset}:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
         l_quantity AS v, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS gold FROM lineitem),
seeds2 AS (SELECT id, v, gold, sha256('42:' || id || ':' || gold) AS h FROM seeds),
draws AS ({numbered.replace("FROM seeds)", "FROM seeds2)")}),
firsts AS (SELECT id, gold, o, min(t) AS t FROM draws WHERE o <> gold GROUP BY id, gold, o),
chosen AS (SELECT id, gold, o, row_number() OVER (PARTITION BY id, gold ORDER BY t) AS rn FROM firsts),
options AS (SELECT id, gold, o FROM chosen WHERE rn < {count}
            UNION ALL SELECT id, gold, gold FROM seeds2),
ordered AS (SELECT id, gold, list(o ORDER BY sha256('42:' || id || ':' || o), o) AS options
            FROM options GROUP BY id, gold)
SELECT id, gold AS answer, array_to_string(options, '|') AS options,
       CAST(list_position(options, gold) - 1 AS INT) AS gold_index FROM ordered"""


def _numeric(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    lines = V.wide_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    whole = F.col("l_quantity").cast("bigint")
    rows = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("数量は? "), whole).alias("question"),
        F.concat(F.lit("計算 #### "), whole).alias("answer"),
    ).distinct()
    return I.build_items(rows, dataset, {}).select(
        "id", F.col("metadata.answer_number").alias("answer"), joined(), "gold_index"
    )


@query(_options_sql("gsm8k_ja_mc4", 4))
def numeric_options_mc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math answers with three generated distractors."""
    return _numeric(spark, sf_dir, "gsm8k_ja_mc4")


@query(_options_sql("gsm8k_ja_mc10", 10))
def numeric_options_mc10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math answers with nine generated distractors."""
    return _numeric(spark, sf_dir, "gsm8k_ja_mc10")


_PAIRS = """SELECT a.doc_id, a.text AS s1, b.text AS s2, CAST(a.doc_id % 3 AS INT) AS label
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""
_NLI_LEAD = f"'前提: ' || {strip('s1')} || {NL} || '仮説: ' || {strip('s2')} || {NL} || "
_VIEWS = {"entailment": "ent", "contradiction": "con", "neutral": "neu"}


@query(
    f"WITH pairs AS ({_PAIRS}) "
    f"SELECT 'jnli' AS dataset, 'jnli:' || doc_id AS id, "
    f"sha256({_NLI_LEAD} '{I.NLI_CHOICE_PROMPT}') AS question_hash, label AS gold_index FROM pairs"
    + "".join(
        f" UNION ALL SELECT '{_VIEWS[t]}', '{_VIEWS[t]}:' || doc_id, "
        f"sha256({_NLI_LEAD} '{prompt}'), CAST(label = {i} AS INT) FROM pairs"
        for i, (t, prompt) in enumerate(I.NLI_YES_NO_PROMPTS.items())
    )
)
def nli_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLI pairs as a three-way choice and as three yes/no views of one pass."""
    docs = V.table(spark, sf_dir, "documents")
    left = docs.select("doc_id", F.col("text").alias("sentence1"))
    right = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("sentence2"))
    pairs = left.join(right, "doc_id").select(
        F.col("doc_id").alias("sentence_pair_id"), "sentence1", "sentence2",
        (F.col("doc_id") % 3).cast("int").alias("label"),
    )
    named = pairs.withColumn(
        "label",
        F.element_at(F.array(*[F.lit(t) for t in _VIEWS]), F.col("label") + 1),
    )
    both = I.nli_items(pairs, "jnli").unionByName(I.nli_yes_no_items(named, _VIEWS))
    return both.select(
        "dataset", "id", F.sha2("question", 256).alias("question_hash"), "gold_index"
    )


_SHUFFLE = "['right', p_brand, p_type, 'size ' || p_size]"


@query(
    f"""
SELECT id, array_to_string(o, '|') AS options, CAST(list_position(o, 'right') - 1 AS INT) AS gold_index
FROM (SELECT id, list_transform(list_sort(list_transform(raw, lambda x: sha256('42:' || id || ':' || x) || x)),
                                lambda y: substr(y, 65)) AS o
      FROM (SELECT 'jgpqa_diamond:' || p_partkey AS id, {_SHUFFLE} AS raw FROM part))"""
)
def seeded_shuffle_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One right and three wrong answers in a seeded order per item."""
    rows = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("Question"),
        F.lit(" right ").alias("Correct Answer"),
        F.col("p_brand").alias("Incorrect Answer 1"),
        F.col("p_type").alias("Incorrect Answer 2"),
        F.concat(F.lit("size "), "p_size").alias("Incorrect Answer 3"),
    )
    return I.build_items(rows, "jgpqa_diamond", {}).select("id", joined(), "gold_index")


@query(
    """
SELECT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'question must not be empty'
            WHEN o_orderkey % 5 = 1 THEN 'at least two options are required'
            WHEN o_orderkey % 5 = 2 THEN 'gold_index is outside options'
            WHEN o_orderkey % 5 = 3 THEN 'too many options' END, 'valid') AS problem,
       count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY ALL"""
)
def item_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with one broken rule each, kept with the rule they break."""
    kind = F.col("o_orderkey") % 5
    many = F.transform(F.sequence(F.lit(1), F.lit(27)), lambda i: i.cast("string"))
    two = F.array(F.lit("x"), F.lit("y"))
    options = F.when(kind == 1, F.array(F.lit("x"))).when(kind == 3, many).otherwise(two)
    rows = V.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == 0, IDEOGRAPHIC_SPACE + "\n").otherwise(F.col("o_orderpriority")).alias("question"),
        options.alias("options"),
        F.when(kind == 2, -1).otherwise(0).alias("gold_index"),
    )
    checked = validate_items(rows, "quarantine", MAX_OPTIONS)
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key")
    )


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def strict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, every row checked although only the key is read."""
    rows = V.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("question"),
        F.array(F.lit("even"), F.lit("odd")).alias("options"),
        (F.col("o_orderkey") % 2).cast("int").alias("gold_index"),
    )
    checked = validate_items(rows, "strict", MAX_OPTIONS)
    return checked.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("bigint").alias("keys"))


@query(
    """
SELECT coalesce(CASE WHEN l_linenumber = 1 THEN 'scores must not be empty'
            WHEN l_linenumber = 2 THEN 'predicted_index is outside scores'
            WHEN l_linenumber = 3 THEN 'probabilities and scores must have equal length' END, 'valid')
         AS problem, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def prediction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with one broken rule each."""
    kind = F.col("l_linenumber")
    pair = F.array(F.col("l_discount"), F.col("l_tax"))
    empty = F.array().cast("array<double>")
    rows = V.table(spark, sf_dir, "lineitem").select(
        F.when(kind == 1, empty).otherwise(pair).alias("scores"),
        F.when(kind == 2, 2).otherwise(1).alias("predicted_index"),
        F.when(kind == 3, F.array("l_tax")).when(kind == 4, F.lit(None)).otherwise(pair).alias("probabilities"),
    )
    checked = validate_predictions(rows, "quarantine")
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    sql(
        f"SELECT dataset, id, sha256(question) AS question_hash, "
        f"array_to_string(options, '|') AS options, CAST(gold_index AS INT) AS gold_index FROM items"
    )
)
def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole item table: yes/no, ordinal and multiple-choice items."""
    return V.all_items(spark, sf_dir).select(
        "dataset", "id", F.sha2("question", 256).alias("question_hash"), joined(), "gold_index"
    )


