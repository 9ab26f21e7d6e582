"""Raw rows -> evaluation items."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.arrays import numeric_options, seeded_shuffle
from gavel.functions.text import (
    NLI_LABELS,
    answer_index,
    answer_number,
    col,
    field_text,
    fill_template,
    nli_label,
    py_str,
    strip,
    truncate,
)
from gavel.operators.filters import where, where_in, where_not
from gavel.operators.ranking import limit_per_dataset
from gavel.schemas import ITEM_COLUMNS, validate_items

ROW_INDEX = "row_index"

# Option texts and prompts of the benchmark views.
YES_NO = ("いいえ", "はい")
NLI_OPTIONS = ("含意", "矛盾", "中立")
NLI_QUESTION = "前提: {premise}\n仮説: {hypothesis}\n{prompt}"
NLI_CHOICE_PROMPT = "両者の関係を選んでください。"
NLI_YES_NO_PROMPTS = {
    "entailment": "仮説は前提から支持されますか？",
    "contradiction": "仮説は前提と矛盾しますか？",
    "neutral": "前提だけでは仮説を判断する情報が不足していますか？",
}
SCORE_PROMPT = "次の状態を基準に沿って評価してください。"
SCORE_STATE = "\n状態: "
ID_FIELDS = ("id", "q_id", "sentence_pair_id", "question_id")


def item_id(df: DataFrame, dataset: str) -> Column:
    """`dataset:<first non-empty id field, else the raw row index>`."""
    known = [F.nullif(col(c).cast("string"), F.lit("")) for c in ID_FIELDS if c in df.columns]
    if ROW_INDEX in df.columns:
        known.append(col(ROW_INDEX).cast("string"))
    if not known:
        raise ValueError(f"{dataset}: rows need an id field or a {ROW_INDEX} column")
    return F.concat(F.lit(f"{dataset}:"), F.coalesce(*known))


def _named_id(df: DataFrame, dataset: str, name: str) -> Column:
    """`dataset:<the named field, else the raw row index>`, row by row."""
    if name not in df.columns:
        return F.concat(F.lit(f"{dataset}:"), field_text(df, ROW_INDEX))
    own = field_text(df, name)
    if ROW_INDEX in df.columns:
        own = F.when(col(name).isNull(), col(ROW_INDEX).cast("string")).otherwise(own)
    return F.concat(F.lit(f"{dataset}:"), own)


def _metadata(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _texts(names: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _item(
    df: DataFrame,
    dataset: str,
    task: str,
    id_: Column,
    question: Column,
    options: Column,
    gold: Column,
    metadata: Column,
) -> DataFrame:
    built = df.select(
        F.lit(dataset).alias("dataset"),
        F.lit(task).alias("task"),
        id_.alias("id"),
        question.alias("question"),
        options.alias("options"),
        gold.cast("int").alias("gold_index"),
        metadata.alias("metadata"),
        *([col(ROW_INDEX)] if ROW_INDEX in df.columns else []),
    )
    return validate_items(built)


def _clean(df: DataFrame, name: str) -> Column:
    return strip(field_text(df, name))


def lettered_items(
    df: DataFrame,
    dataset: str,
    question: str,
    answer: str,
    subject: str | None = None,
    options: tuple[str, ...] = ("A", "B", "C", "D"),
) -> DataFrame:
    """Options in lettered columns, answer by letter, number or text."""
    choices = F.array(*[_clean(df, c) for c in options])
    meta = {"dataset": F.lit(dataset)}
    if subject and subject in df.columns:
        meta["subject"] = col(subject)
    return _item(
        df,
        dataset,
        "choice",
        item_id(df, dataset),
        _clean(df, question),
        choices,
        answer_index(col(answer), df.schema[answer].dataType, choices),
        _metadata(**meta),
    )


def shuffled_items(
    df: DataFrame,
    dataset: str,
    question: str = "Question",
    correct: str = "Correct Answer",
    incorrect: tuple[str, ...] = tuple(f"Incorrect Answer {i}" for i in (1, 2, 3)),
    seed: int = 42,
) -> DataFrame:
    """One correct and several wrong answers in a seeded order per item."""
    right = _clean(df, correct)
    id_ = item_id(df, dataset)
    raw = F.array(right, *[_clean(df, c) for c in incorrect])
    shuffled = df.withColumn("__options", seeded_shuffle(raw, seed, id_))
    return _item(
        shuffled,
        dataset,
        "choice",
        id_,
        _clean(df, question),
        col("__options"),
        F.array_position(col("__options"), right) - 1,
        _metadata(dataset=F.lit(dataset)),
    )


def indexed_items(
    df: DataFrame, dataset: str, options: tuple[str, ...], label: str = "label"
) -> DataFrame:
    """Numbered option columns with an integer label."""
    return _item(
        df,
        dataset,
        "choice",
        item_id(df, dataset),
        _clean(df, "question"),
        F.array(*[_clean(df, c) for c in options]),
        col(label).cast("int"),
        _metadata(dataset=F.lit(dataset)),
    )


def numeric_items(df: DataFrame, dataset: str, count: int, seed: int = 42) -> DataFrame:
    """Math word problem -> multiple choice with generated numeric distractors."""
    id_ = item_id(df, dataset)
    declared = col("answer_number") if "answer_number" in df.columns else None
    answer = field_text(df, "answer") if "answer" in df.columns else F.lit("")
    # Two projections: the answer is extracted once, then reused by the options.
    staged = df.withColumn("__answer", answer_number(answer, declared))
    staged = staged.withColumn("__options", numeric_options(col("__answer"), count, seed, id_))
    return _item(
        staged,
        dataset,
        "choice",
        id_,
        _clean(df, "question"),
        col("__options"),
        F.array_position(col("__options"), col("__answer")) - 1,
        _metadata(dataset=F.lit(dataset), answer_number=col("__answer")),
    )


def _nli_question(df: DataFrame, prompt: Column) -> Column:
    from gavel.functions.prompts import fill

    return fill(
        NLI_QUESTION,
        premise=_clean(df, "sentence1"),
        hypothesis=_clean(df, "sentence2"),
        prompt=prompt,
    )


def nli_items(df: DataFrame, dataset: str) -> DataFrame:
    """Premise and hypothesis as a three-way choice."""
    label = nli_label(col("label"), df.schema["label"].dataType)
    return _item(
        df,
        dataset,
        "choice",
        item_id(df, dataset),
        _nli_question(df, F.lit(NLI_CHOICE_PROMPT)),
        _texts(NLI_OPTIONS),
        F.array_position(_texts(NLI_LABELS), label) - 1,
        _metadata(dataset=F.lit(dataset)),
    )


def nli_yes_no_items(df: DataFrame, datasets: Mapping[str, str]) -> DataFrame:
    """One-vs-rest yes/no views of NLI rows; `datasets` maps target -> dataset name.

    All views come from one pass over the source.
    """
    unknown = set(datasets) - set(NLI_YES_NO_PROMPTS)
    if unknown:
        raise ValueError(f"unsupported NLI target: {', '.join(sorted(unknown))}")
    views = F.array(
        *[
            F.struct(
                F.lit(target).alias("target"),
                F.lit(name).alias("dataset"),
                F.lit(NLI_YES_NO_PROMPTS[target]).alias("prompt"),
            )
            for target, name in datasets.items()
        ]
    )
    label = nli_label(col("label"), df.schema["label"].dataType)
    wide = df.withColumn("__view", F.explode(views))
    view = col("__view")
    source = "sentence_pair_id" if "sentence_pair_id" in df.columns else ROW_INDEX
    built = wide.select(
        view["dataset"].alias("dataset"),
        F.lit("noul").alias("task"),
        F.concat(view["dataset"], F.lit(":"), field_text(df, source)).alias("id"),
        _nli_question(df, view["prompt"]).alias("question"),
        _texts(YES_NO).alias("options"),
        (label == view["target"]).cast("int").alias("gold_index"),
        _metadata(
            dataset=view["dataset"], source_dataset=F.lit("jnli"), noul_target=view["target"]
        ).alias("metadata"),
        *([col(ROW_INDEX)] if ROW_INDEX in df.columns else []),
    )
    return validate_items(built)


def _question_text(df: DataFrame, template: str | None, field: str, max_chars: int) -> Column:
    text = strip(fill_template(df, template)) if template else _clean(df, field)
    return truncate(text, max_chars)


def threshold_gold(value: Column, thresholds: list[float]) -> Column:
    """Ordinal level: how many thresholds the value reaches."""
    return sum(((value >= float(t)).cast("int") for t in thresholds), F.lit(0))


def offset_gold(value: Column, offset: int) -> Column:
    """Ordinal level from an integer-like value, truncated toward zero, plus an offset."""
    return value.cast("double").cast("int") + offset


def score_items(df: DataFrame, dataset: str, source: Mapping[str, Any]) -> DataFrame:
    """Generic ordinal item."""
    criteria_field = str(source.get("criteria_field", "criteria"))
    if criteria_field in df.columns:
        criteria = col(criteria_field).cast("array<string>")
    else:
        if len(source.get("criteria") or []) < 2:
            raise ValueError("score adapter requires at least two criteria")
        criteria = _texts([str(c) for c in source["criteria"]])
    raw = col(str(source.get("gold_field", "gold_score"))).cast("double")
    thresholds = source.get("gold_thresholds")
    if thresholds is not None:
        gold = threshold_gold(raw, thresholds)
    else:
        gold = offset_gold(raw, int(source.get("gold_offset", 0)))
    text = _question_text(
        df,
        source.get("question_template"),
        str(source.get("question_field", "state")),
        int(source.get("max_chars", 0)),
    )
    prompt = str(source.get("prompt", SCORE_PROMPT))
    return _item(
        df,
        dataset,
        "score",
        _named_id(df, dataset, "id"),
        F.concat(F.lit(prompt + SCORE_STATE), text),
        criteria,
        gold,
        _metadata(dataset=F.lit(dataset), gold_score=gold, criteria=F.to_json(criteria)),
    )


def yes_no_items(df: DataFrame, dataset: str, source: Mapping[str, Any]) -> DataFrame:
    """Generic yes/no item: yes by listed values (as text) or by a minimum."""
    field = str(source["gold_field"])
    raw, dtype = col(field), df.schema[field].dataType
    if "positive_values" in source:
        gold = py_str(raw, dtype).isin([str(v) for v in source["positive_values"]])
    elif "positive_min" in source:
        gold = raw.cast("double") >= float(source["positive_min"])
    else:
        raise ValueError("noul adapter requires positive_values or positive_min")
    return _item(
        df,
        dataset,
        "noul",
        _named_id(df, dataset, str(source.get("item_id_field", "id"))),
        _question_text(
            df, str(source.get("question_template", "{text}")), "text",
            int(source.get("max_chars", 0)),
        ),
        _texts(YES_NO),
        gold.cast("int"),
        _metadata(dataset=F.lit(dataset), source_label=py_str(raw, dtype)),
    )


Adapter = Callable[[DataFrame, str, int], DataFrame]

# Public benchmarks by name; each maps its own field names onto a shape above.
BENCHMARKS: dict[str, Adapter] = {
    "mmmlu_ja": lambda df, n, s: lettered_items(df, n, "Question", "Answer", "Subject"),
    "jmmlu": lambda df, n, s: lettered_items(df, n, "question", "answer", "subject"),
    "jgpqa_diamond": lambda df, n, s: shuffled_items(df, n, seed=s),
    "jcommonsenseqa": lambda df, n, s: indexed_items(
        df, n, tuple(f"choice{i}" for i in range(5))
    ),
    "xwinograd_ja": lambda df, n, s: lettered_items(
        df, n, "sentence", "answer", options=("option1", "option2")
    ),
    "mgsm_ja": lambda df, n, s: numeric_items(df, n, 4, s),
    "gsm8k_ja_mc4": lambda df, n, s: numeric_items(df, n, 4, s),
    "gsm8k_ja_mc10": lambda df, n, s: numeric_items(df, n, 10, s),
    "jnli": lambda df, n, s: nli_items(df, n),
}


def convert(df: DataFrame, dataset: str, source: Mapping[str, Any], seed: int = 42) -> DataFrame:
    """Adapter dispatch: the source's adapter, else the benchmark of that name."""
    adapter = source.get("adapter")
    if adapter == "jnli_noul":
        return nli_yes_no_items(df, {str(source["target"]): dataset})
    if adapter == "score":
        return score_items(df, dataset, source)
    if adapter == "noul":
        return yes_no_items(df, dataset, source)
    if dataset not in BENCHMARKS:
        raise KeyError(f"unknown dataset: {dataset}")
    return BENCHMARKS[dataset](df, dataset, seed)


def build_items(
    df: DataFrame,
    dataset: str,
    source: Mapping[str, Any],
    seed: int = 42,
    limit: int | None = None,
) -> DataFrame:
    """Filter raw rows, convert them and keep the first `limit` in source order."""
    rows = where(df, source.get("where", {}))
    rows = where_in(rows, source.get("where_in", {}))
    rows = where_not(rows, source.get("where_not", {}))
    if limit is not None:
        # Adapters are one-to-one, so the limit may cut before the conversion.
        rows = limit_per_dataset(rows.withColumn("__d", F.lit(dataset)), limit, ROW_INDEX, "__d")
        rows = rows.drop("__d")
    return convert(rows, dataset, source, seed).select(*ITEM_COLUMNS)
