"""Model answers as JSON -> scores, probabilities and the predicted index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.arrays import argmax, binary_scores, let
from gavel.schemas import USAGE

ANSWER = (
    "STRUCT<noul: DOUBLE, probability_yes: DOUBLE, choice: STRING, selected_id: STRING, "
    "confidence: DOUBLE, probabilities: MAP<STRING,DOUBLE>>"
)
RESPONSE = f"STRUCT<answers: STRUCT<answer: {ANSWER}>, model: STRING, usage: {USAGE}>"

SCORED = "STRUCT<scores: ARRAY<DOUBLE>, probabilities: ARRAY<DOUBLE>, predicted_index: INT>"


def _scored(scores: Column, probabilities: Column, predicted: Column) -> Column:
    return F.struct(
        scores.alias("scores"),
        probabilities.alias("probabilities"),
        predicted.cast("int").alias("predicted_index"),
    ).cast(SCORED)


def _keyed_probabilities(answer: Column, count: Column, prefix: str) -> Column:
    """Probabilities in option order; a missing key is an error, never a zero."""

    def one(i: Column) -> Column:
        key = F.concat(F.lit(prefix), i.cast("string"))
        return F.coalesce(
            F.try_element_at(answer["probabilities"], key),
            F.raise_error(F.concat(F.lit("probability missing: "), key)).cast("double"),
        )

    return F.transform(F.sequence(F.lit(0), count - 1), one)


def parse_answer(task: Column, answer: Column, count: Column) -> Column:
    """Typed answer struct -> (scores, probabilities, predicted_index).

    Yes/no answers use the 0.5 threshold, ordinal answers the arg-max, choices
    the model's own pick. An answer without what its task needs is an error.
    """
    p_true = F.coalesce(answer["noul"], answer["probability_yes"])
    missing = F.raise_error(F.lit("answer without a probability")).cast("double")
    yes_no = _scored(*binary_scores(F.coalesce(p_true, missing)))
    levels = let(
        _keyed_probabilities(answer, count, ""), lambda p: _scored(p, p, argmax(p))
    )
    chosen = F.coalesce(answer["choice"], answer["selected_id"])
    number = F.regexp_extract(chosen, r"^option_(\d+)$", 1).try_cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown choice: "), F.coalesce(chosen, F.lit("none")))).cast("int")
    index = F.when((number >= 0) & (number < count), number).otherwise(unknown)
    choice = let(
        _keyed_probabilities(answer, count, "option_"), lambda p: _scored(p, p, index)
    )
    return F.when(task == "noul", yes_no).when(task == "score", levels).otherwise(choice)


def parse_answer_json(task: Column, text: Column, count: Column) -> Column:
    return let(F.from_json(text, ANSWER), lambda a: parse_answer(task, a, count))


def parse_distribution(task: Column, probabilities: Column) -> Column:
    """One distribution over the options; index 1 of a yes/no answer is yes."""
    missing = F.raise_error(F.lit("distribution without a second value")).cast("double")
    yes_no = _scored(*binary_scores(F.coalesce(F.get(probabilities, F.lit(1)), missing)))
    other = _scored(probabilities, probabilities, argmax(probabilities))
    return F.when(task == "noul", yes_no).otherwise(other)


def parse_response(text: Column, count: Column) -> Column:
    """Whole service response: scored answer, confidence, model name and token usage."""

    def fields(body: Column) -> Column:
        answer = body["answers"]["answer"]
        return F.struct(
            parse_answer(F.lit("choice"), answer, count).alias("scored"),
            answer["confidence"].alias("confidence"),
            body["model"].alias("response_model"),
            body["usage"].alias("usage"),
        )

    return let(F.from_json(text, RESPONSE), fields)
