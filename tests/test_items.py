import pytest
from pyspark.sql import functions as F

from gavel.operators import items as I
from gavel.operators.filters import where, where_in, where_not
from gavel.schemas import validate_items, validate_predictions


def frame(spark, row, schema):
    return spark.createDataFrame([row], schema)


def build(spark, name, row, schema, source=None):
    return I.build_items(frame(spark, row, schema), name, source or {}).first()


def test_lettered(spark):
    row = ("q1", " Q ", "a", "b", "c", "d", "B", "law")
    schema = "id string, Question string, A string, B string, C string, D string, Answer string, Subject string"
    item = build(spark, "mmmlu_ja", row, schema)
    assert (item["id"], item["question"], item["gold_index"]) == ("mmmlu_ja:q1", "Q", 1)
    assert item["options"] == ["a", "b", "c", "d"] and item["metadata"]["subject"] == "law"


def test_five_choice_and_row_index_id(spark):
    row = ("", "q", "a", "b", "c", "d", "e", 3, 17)
    schema = ("q_id string, question string, choice0 string, choice1 string, choice2 string, choice3 string, "
              "choice4 string, label int, row_index bigint")
    item = build(spark, "jcommonsenseqa", row, schema)
    assert (item["id"], item["gold_index"]) == ("jcommonsenseqa:17", 3)


@pytest.mark.parametrize("answer,gold", [("1", 0), ("2", 1), ("left", 0), ("right", 1)])
def test_two_options(spark, answer, gold):
    schema = "id string, sentence string, option1 string, option2 string, answer string"
    assert build(spark, "xwinograd_ja", ("i", "s", "left", "right", answer), schema)["gold_index"] == gold


def test_shuffled_keeps_gold(spark):
    rows = [(str(i), "q", "right", "w1", "w2", "w3") for i in range(40)]
    names = ["id", "Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"]
    items = I.build_items(spark.createDataFrame(rows, names), "jgpqa_diamond", {}).collect()
    assert all(i["options"][i["gold_index"]] == "right" for i in items)
    assert len({i["gold_index"] for i in items}) == 4


@pytest.mark.parametrize("name,count", [("mgsm_ja", 4), ("gsm8k_ja_mc10", 10)])
def test_math(spark, name, count):
    item = build(spark, name, ("m", "q", "so #### 42"), "id string, question string, answer string")
    assert len(set(item["options"])) == count
    assert item["options"][item["gold_index"]] == "42" == item["metadata"]["answer_number"]


def test_math_declared_number_wins(spark):
    schema = "id string, question string, answer string, answer_number int"
    assert build(spark, "mgsm_ja", ("m", "q", "#### 1", 9), schema)["metadata"]["answer_number"] == "9"


@pytest.mark.parametrize("label,kind,gold", [(2, "int", 2), ("contradiction", "string", 1)])
def test_nli(spark, label, kind, gold):
    schema = f"sentence_pair_id string, sentence1 string, sentence2 string, label {kind}"
    item = build(spark, "jnli", ("p", " 前 ", "後", label), schema)
    assert item["gold_index"] == gold
    assert item["question"] == "前提: 前\n仮説: 後\n両者の関係を選んでください。"


def test_nli_yes_no(spark):
    schema = "sentence_pair_id string, sentence1 string, sentence2 string, label int"
    source = {"adapter": "jnli_noul", "target": "contradiction"}
    item = build(spark, "jnli_c", ("p", "a", "b", 1), schema, source)
    assert (item["id"], item["gold_index"], item["options"]) == ("jnli_c:p", 1, ["いいえ", "はい"])
    with pytest.raises(ValueError):
        build(spark, "x", ("p", "a", "b", 1), schema, {"adapter": "jnli_noul", "target": "maybe"})


def test_thresholds_and_offset(spark):
    base = {"adapter": "score", "criteria": list("abcde"), "gold_field": "v"}
    schema = "id string, state string, v double"
    item = build(spark, "s", ("i", "text", 0.65), schema, {**base, "gold_thresholds": [0.2, 0.4, 0.6, 0.8]})
    assert item["gold_index"] == 3
    assert item["question"] == "次の状態を基準に沿って評価してください。\n状態: text"
    assert build(spark, "s", ("i", "t", -2.0), schema, {**base, "gold_offset": 2})["gold_index"] == 0
    assert build(spark, "s", ("i", "t", -1.9), schema, {**base, "gold_offset": 2})["gold_index"] == 1
    with pytest.raises(Exception, match="gold_index is outside options"):
        build(spark, "s", ("i", "t", 9.0), schema, base)
    with pytest.raises(ValueError, match="at least two criteria"):
        build(spark, "s", ("i", "t", 0.0), schema, {**base, "criteria": ["a"]})


def test_criteria_from_the_row(spark):
    schema = "id string, state string, gold_score int, criteria array<string>"
    item = build(spark, "s", ("i", "t", 1, ["lo", "hi"]), schema, {"adapter": "score"})
    assert item["options"] == ["lo", "hi"] and item["gold_index"] == 1


def test_yes_no(spark):
    source = {"adapter": "noul", "gold_field": "y", "positive_values": [True], "max_chars": 3}
    item = build(spark, "n", ("i", " 日本語文 ", True), "id string, text string, y boolean", source)
    assert (item["question"], item["gold_index"], item["metadata"]["source_label"]) == ("日本語", 1, "True")
    minimum = {"adapter": "noul", "gold_field": "y", "positive_min": 0.5}
    assert build(spark, "n", ("i", "t", 0.5), "id string, text string, y double", minimum)["gold_index"] == 1
    with pytest.raises(ValueError):
        build(spark, "n", ("i", "t", 0.5), "id string, text string, y double", {"adapter": "noul", "gold_field": "y"})


def test_unknown_dataset(spark):
    with pytest.raises(KeyError):
        build(spark, "nope", ("i",), "id string")


def test_limit_follows_source_order(spark):
    rows = spark.range(100).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), (99 - F.col("id")).alias("row_index"),
        F.lit(1).alias("y"),
    )
    source = {"adapter": "noul", "gold_field": "y", "positive_values": [1], "where_not": {"id": "99"}}
    got = [r["id"] for r in I.build_items(rows, "n", source, limit=3).collect()]
    assert sorted(got) == ["n:96", "n:97", "n:98"]


def test_filters_compare_as_text(spark):
    rows = [("a", 1, True, 2.0, None), ("b", 2, False, 2.5, "x"), (None, None, None, None, "None")]
    df = spark.createDataFrame(rows, "s string, i int, b boolean, d double, `x y/z` string")

    def kept(result):
        return [r["s"] for r in result.collect()]

    assert kept(where(df, {"b": "True"})) == ["a"] == kept(where(df, {"b": True}))
    assert kept(where(df, {"b": "true"})) == []
    assert kept(where(df, {"i": 2, "d": 2.5})) == ["b"]
    assert kept(where(df, {"d": 2})) == [] and kept(where(df, {"d": "2.0"})) == ["a"]
    assert kept(where(df, {"x y/z": None})) == ["a", None]
    assert kept(where(df, {"absent": "None"})) == ["a", "b", None]
    assert kept(where_in(df, {"i": ["1", None]})) == ["a", None]
    assert kept(where_not(df, {"s": "a"})) == ["b", None]
    assert kept(where_not(df, {"i": None})) == ["a", "b"]
    assert kept(where(df, {"i": "99999999999999"})) == []


def test_typed_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("int").alias("i"), F.lit("a").alias("s")).write.parquet(path)
    df = where(spark.read.parquet(path), {"i": "3", "s": "a"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(i,3)" in plan and "EqualTo(s,a)" in plan


def test_constraints(spark):
    schema = "question string, options array<string>, gold_index int"
    rows = [("　", ["a", "b"], 0), ("q", ["a"], 0), ("q", ["a", "b"], 2), ("q", ["a", "b"], 1), ("q", ["a", "b"], None)]
    df = validate_items(spark.createDataFrame(rows, schema), "quarantine", max_chars=5)
    assert [r["problem"] for r in df.collect()] == [
        "question must not be empty", "at least two options are required", "gold_index is outside options", None,
        "gold_index is outside options",
    ]
    with pytest.raises(Exception, match="gold_index is outside options"):
        validate_items(spark.createDataFrame(rows[2:3], schema)).collect()
    schema = "scores array<double>, predicted_index int, probabilities array<double>"
    with pytest.raises(Exception, match="equal length"):
        validate_predictions(spark.createDataFrame([([1.0, 2.0], 0, [1.0])], schema)).collect()


def test_strict_checks_survive_pruning(spark):
    schema = "id string, question string, options array<string>, gold_index int"
    good, bad = ("a", "q", ["x", "y"], 1), ("b", "q", ["x", "y"], 2)
    checked = validate_items(spark.createDataFrame([good, bad], schema), "strict")
    for pruned in (checked.groupBy().count(), checked.select("id"), checked.selectExpr("1 AS one"), checked.select("id").distinct()):
        with pytest.raises(Exception, match="gold_index is outside options"):
            pruned.collect()
    kept = validate_items(spark.createDataFrame([good], schema), "strict")
    assert kept.count() == 1 and kept.collect() == [good]
    assert validate_items(spark.createDataFrame([], schema), "strict").count() == 0
    predictions = "id string, scores array<double>, predicted_index int, probabilities array<double>"
    broken = validate_predictions(spark.createDataFrame([("a", [1.0], 0, None), ("b", [], 0, None)], predictions), "strict")
    with pytest.raises(Exception, match="scores must not be empty"):
        broken.count()
