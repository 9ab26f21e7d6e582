"""Training corpora -> items and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import py_str, strip
from gavel.operators.items import ROW_INDEX, YES_NO
from gavel.operators.ranking import top_per_group
from gavel.schemas import CRITERIA, ITEM_COLUMNS, TASKS, require, validate_items


def filter_corpus(
    rows: DataFrame, task: str, lang: str | None = "Japanese"
) -> DataFrame:
    """Rows of one question type and, when given, one language."""
    kept = rows.filter(F.col("question_type") == task)
    return kept.filter(F.col("lang") == lang) if lang is not None else kept


def rubric_items(rows: DataFrame, task: str, dataset: str) -> DataFrame:
    """Rubric rows -> items; yes/no questions carry their rubric in the question text."""
    if task not in TASKS:
        raise ValueError(f"unsupported task: {task}")
    options = F.col("options")
    labels = F.transform(options, lambda o: o["label"])
    described = F.transform(
        options, lambda o: F.coalesce(F.nullif(o["description"], F.lit("")), o["label"])
    )
    position = F.array_position(labels, F.col("expected"))
    message = F.concat(F.lit("expected label is not among the options: "), F.col("expected"))
    rows = require(rows, position > 0, message)
    state = strip(F.coalesce("state", F.lit("")))
    instructions = strip(F.coalesce("instructions", F.lit("")))
    asked = F.when(state == "", instructions).otherwise(
        F.concat(state, F.lit("\n\n"), instructions)
    )
    if task == "noul":
        # The last description of a repeated label counts, like a keyed lookup.
        by_label = F.map_from_entries(
            F.transform(F.array_distinct(labels), lambda name: F.struct(
                name,
                F.element_at(
                    F.filter(F.arrays_zip(labels.alias("l"), described.alias("d")),
                             lambda z: z["l"] == name),
                    -1,
                )["d"],
            ))
        )

        def lines(label: str, text: str) -> Column:
            hits = F.filter(labels, lambda name: name == label)
            return F.transform(
                hits, lambda _: F.concat(F.lit(f"{text}: "), F.element_at(by_label, F.lit(label)))
            )

        rubric = F.concat(lines("yes", YES_NO[1]), lines("no", YES_NO[0]))
        question = F.array_join(F.concat(F.array(asked), rubric), "\n")
        texts = F.array(*[F.lit(t) for t in YES_NO])
        gold = (F.col("expected") == "yes").cast("int")
    else:
        question, texts, gold = asked, described, position - 1
    extra = ("family", "topic", "source", "difficulty", "lang")
    pairs = [F.lit("dataset"), F.lit(dataset)]
    for name in extra:
        if name in rows.columns:
            pairs += [F.lit(name), F.col(name).cast("string")]
    id_ = F.col("id") if "id" in rows.columns else F.col(ROW_INDEX)
    items = rows.select(
        F.lit(dataset).alias("dataset"),
        F.lit(task).alias("task"),
        py_str(id_, rows.schema["id" if "id" in rows.columns else ROW_INDEX].dataType).alias("id"),
        question.alias("question"),
        texts.alias("options"),
        gold.cast("int").alias("gold_index"),
        F.create_map(*pairs).alias("metadata"),
        *([F.col(ROW_INDEX)] if ROW_INDEX in rows.columns else []),
    )
    return validate_items(items)


def load_corpus(
    rows: DataFrame,
    task: str,
    dataset: str,
    lang: str | None = "Japanese",
    limit: int | None = None,
) -> DataFrame:
    """Filter, keep the first `limit` rows in source order, convert."""
    kept = filter_corpus(rows, task, lang)
    if limit is not None:
        order = [F.col(c) for c in ("file_order", ROW_INDEX) if c in kept.columns]
        kept = top_per_group(kept, ["question_type"], order, limit, F.col(ROW_INDEX))
    return rubric_items(kept, task, dataset).select(*ITEM_COLUMNS)


def sorted_criteria(criteria: Column) -> Column:
    """Criteria in index order."""
    entries = F.transform(
        criteria, lambda c: F.struct(c["index"].alias("index"), c["label"].alias("label"), c["id"].alias("id"))
    )
    return F.array_sort(entries)


def sorted_labels(criteria: Column) -> Column:
    return F.transform(sorted_criteria(criteria), lambda c: c["label"])


def programmatic_examples(rows: DataFrame, prefix: str) -> DataFrame:
    """Solver-verified rows -> training examples; booleans match a criterion by id."""
    wanted = F.when(F.coalesce("answer_bool", F.lit(False)), "true").otherwise("false")
    hit = F.get(F.filter("criteria", lambda c: c["id"] == wanted), F.lit(0))["index"]
    gold = F.when(F.col("primitive") == "choice", F.col("answer_index")).when(
        F.col("primitive") == "bool", hit
    )
    rows = require(
        rows,
        F.col("primitive").isin("choice", "bool"),
        F.concat(F.lit("unexpected primitive: "), F.col("primitive")),
    )
    return _examples(rows, F.col("state_text"), sorted_labels(F.col("criteria")), gold, prefix)


def document_examples(rows: DataFrame, prefix: str) -> DataFrame:
    """Document-grounded rows (criteria as JSON) -> training examples."""
    context = F.concat("document_title", F.lit("\n\n"), "document_text")
    criteria = F.from_json("criteria_json", CRITERIA)
    return _examples(rows, context, sorted_labels(criteria), F.col("target_index"), prefix)


def _examples(
    rows: DataFrame, context: Column, options: Column, gold: Column, prefix: str
) -> DataFrame:
    kept = [F.col("id")] if "id" in rows.columns else []
    return rows.select(
        *kept,
        F.concat(F.lit(prefix), F.col("primitive")).alias("task"),
        context.alias("context"),
        F.col("instructions").alias("instructions"),
        options.alias("options"),
        gold.cast("int").alias("gold_index"),
    )


def trainer_rows(items: DataFrame) -> DataFrame:
    """`{context, options, label}` rows of a trainer file."""
    return items.select(
        F.col("question").alias("context"), "options", F.col("gold_index").alias("label")
    )
