"""Model inputs as text and JSON columns.

JSON objects are spelled with `", "` and `": "` between parts, since some of
them are shown to a model as prompt text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.text import json_text, strip
from gavel.schemas import LABELS

# Instructions and templates the scored models expect.
CHOOSE_ONE = "正しい答えを一つ選んでください。"
LETTER_PROMPT = "問題:\n{question}\n\n選択肢:\n{choices}\n\n答え:"
HYPOTHESIS = {"ja": "正しい答えは「{option}」である。", "en": "The correct answer is: {option}"}
DOCUMENT_POLICY = (
    "Decide the case using only what the document states. Exactly one option is correct."
)
EVIDENCE_CRITERION = "Select the correct option."
EVIDENCE_SYSTEM = (
    "Apply the supplied criterion to the supplied evidence. Choose exactly one listed option. "
    "Respond with only its uppercase letter, with no explanation or reasoning."
)
FEW_SHOT_HEADER = "以下は同じ形式の判定の解答例です。"
FEW_SHOT_EXAMPLE = "[例{number}]"
FEW_SHOT_OPTIONS = "選択肢: "
FEW_SHOT_ANSWER = "正解: "
FEW_SHOT_TARGET = "[判定対象]\n"
FEW_SHOT_NO_STATE = "以下の質問に、上と同じ基準で答えてください。"


def letter(index: Column) -> Column:
    """The label of an option; there are as many options as letters at most."""
    none = F.raise_error(F.lit("more options than letters"))
    return F.when(index < len(LABELS), F.substring(F.lit(LABELS), index + 1, F.lit(1))).otherwise(none.cast("string"))


def choice_block(options: Column) -> Column:
    """`A. first` / `B. second` lines."""
    lines = F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o))
    return F.array_join(lines, "\n")


def fill(template: str, **values: Column) -> Column:
    """Fixed template with `{name}` slots filled by columns."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def letter_prompt(
    question: Column, options: Column, template: str = LETTER_PROMPT, **extra: Column
) -> Column:
    """Question, lettered options and the answer slot of a letter-logit model."""
    return fill(template, question=question, choices=choice_block(options), **extra)


def candidate_prompt(
    question: Column, options: Column, prefix: str = "", whole_option: bool = False
) -> tuple[Column, Column]:
    """Candidate prompt and each candidate's character span.

    The span covers the letter, or the whole `A. option` line when asked.
    """
    lead = F.concat(F.lit(prefix), question, F.lit("\n"))
    text = F.concat(lead, choice_block(options), F.lit("\n"))

    def span(index: Column) -> Column:
        before = F.slice(options, F.lit(1), index)
        start = F.aggregate(before, F.length(lead), lambda n, o: n + F.length(o) + 4)
        width = F.length(F.get(options, index)) + 3 if whole_option else F.lit(1)
        return F.struct(start.alias("start"), (start + width).alias("end"))

    spans = F.transform(F.sequence(F.lit(0), F.size(options) - 1), span)
    return text, spans


def hypotheses(options: Column, language: str = "ja") -> Column:
    """One entailment hypothesis per option."""
    return F.transform(options, lambda o: fill(HYPOTHESIS[language], option=o))


def state_and_candidates(task: Column, question: Column, options: Column) -> tuple[Column, Column]:
    """(state text, candidate texts) for contrastive scoring."""
    state = strip(question)
    yes_no = F.array(
        F.concat(F.lit("false: No. This is false: "), state),
        F.concat(F.lit("true: Yes. This is true: "), state),
    )
    return state, F.when(task == "noul", yes_no).otherwise(options)


def _object(*pairs: tuple[str, Column]) -> Column:
    parts: list[Column] = [F.lit("{")]
    for i, (key, value) in enumerate(pairs):
        parts += [F.lit(f'{", " if i else ""}"{key}": '), value]
    return F.concat(*parts, F.lit("}"))


def _array(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def _keyed(options: Column) -> Column:
    pairs = F.transform(
        options,
        lambda o, i: F.concat(
            F.lit('"option_'), i.cast("string"), F.lit('": '), json_text(o)
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def typed_question(task: Column, question: Column, options: Column) -> tuple[Column, Column]:
    """(state, question JSON): yes/no questions travel as the instruction itself."""
    state = F.when(task == "noul", "").otherwise(question)
    instruction = F.lit(f'"{CHOOSE_ONE}"')
    body = (
        F.when(task == "noul", _object(("type", F.lit('"noul"')), ("instructions", json_text(question))))
        .when(
            task == "score",
            _object(
                ("type", F.lit('"score"')),
                ("instructions", instruction),
                ("criteria", _array(F.transform(options, json_text))),
            ),
        )
        .when(
            task == "choice",
            _object(
                ("type", F.lit('"choice"')),
                ("instructions", instruction),
                ("criteria", _keyed(options)),
            ),
        )
        .otherwise(F.raise_error(F.concat(F.lit("unsupported task: "), task)).cast("string"))
    )
    return state, body


def typed_request(task: Column, question: Column, options: Column, model: str | None = None) -> Column:
    """Whole request body: state, optional model name, one question named `answer`."""
    state, body = typed_question(task, question, options)
    fields = [("state", json_text(state))]
    if model is not None:
        fields.append(("model", json_text(F.lit(model))))
    return _object(*fields, ("questions", _object(("answer", body))))


def decision_request(task: Column, question: Column, options: Column) -> tuple[Column, Column]:
    """(state, decision JSON) with described criteria; ordinal levels carry their value."""
    state = F.when(task == "noul", "").otherwise(question)

    def criterion(key: Column, description: Column, value: Column) -> Column:
        return _object(
            ("id", json_text(key)),
            ("description_json", json_text(json_text(description))),
            ("value", value),
        )

    null = F.lit("null")
    yes_no = F.array(
        criterion(F.lit("false"), F.lit("No."), null), criterion(F.lit("true"), F.lit("Yes."), null)
    )
    levels = F.transform(
        options, lambda o, i: criterion(i.cast("string"), o, i.cast("string"))
    )
    choices = F.transform(
        options, lambda o, i: criterion(F.concat(F.lit("option_"), i.cast("string")), o, null)
    )
    criteria = F.when(task == "noul", yes_no).when(task == "score", levels).otherwise(choices)
    instructions = F.when(task == "noul", question).otherwise(CHOOSE_ONE)
    body = _object(
        ("id", F.lit('"answer"')),
        ("kind", F.lit('"judgment"')),
        ("type", json_text(task)),
        ("instructions_json", json_text(json_text(instructions))),
        ("system_prompt", F.lit('""')),
        ("criteria", _array(criteria)),
        ("documents", F.lit("[]")),
        ("scoring", null),
    )
    return state, body


def _lettered(options: Column) -> Column:
    return _array(
        F.transform(
            options,
            lambda o, i: _object(("letter", json_text(letter(i))), ("description", json_text(o))),
        )
    )


def evidence_request(question: Column, options: Column) -> Column:
    """Evidence / criterion / lettered options JSON."""
    return _object(
        ("evidence", json_text(question)),
        ("criterion", F.lit(f'"{EVIDENCE_CRITERION}"')),
        ("options", _lettered(options)),
    )


def document_request(task: Column, question: Column, options: Column) -> tuple[Column, Column]:
    """(user-turn JSON, option texts shown) under a document policy."""
    yes_no = task == "noul"
    policy = F.when(yes_no, f"{DOCUMENT_POLICY}\ntrue: yes\nfalse: no").otherwise(DOCUMENT_POLICY)
    instructions = F.when(yes_no, question).otherwise(CHOOSE_ONE)
    shown = (
        F.when(yes_no, F.array(F.lit("true"), F.lit("false")))
        .when(
            task == "score",
            F.transform(options, lambda o, i: F.concat(i.cast("string"), F.lit(": "), o)),
        )
        .otherwise(options)
    )
    body = _object(
        ("evidence", json_text(F.when(question == "", instructions).otherwise(question))),
        ("criterion", json_text(F.concat(policy, F.lit("\n\n"), instructions))),
        ("options", _lettered(shown)),
    )
    return body, shown


def few_shot_block(task: Column, examples: Column, state: Column) -> Column:
    """Worked examples in front of the case; `examples` holds question, options, gold_index."""

    def example(e: Column, i: Column) -> Column:
        listed = F.transform(
            e["options"], lambda o, j: F.concat(j.cast("string"), F.lit(": "), o)
        )
        lines = F.array(
            fill(FEW_SHOT_EXAMPLE, number=(i + 1).cast("string")),
            e["question"],
            F.when(task != "noul", F.concat(F.lit(FEW_SHOT_OPTIONS), F.array_join(listed, " / "))),
            F.concat(F.lit(FEW_SHOT_ANSWER), F.get(e["options"], e["gold_index"])),
        )
        return F.array_join(F.array_compact(lines), "\n")

    target = F.when(state == "", FEW_SHOT_NO_STATE).otherwise(state)
    blocks = F.concat(
        F.array(F.lit(FEW_SHOT_HEADER)),
        F.transform(examples, example),
        F.array(F.concat(F.lit(FEW_SHOT_TARGET), target)),
    )
    return F.array_join(blocks, "\n\n")


def few_shot_messages(examples: Column, question: Column, options: Column) -> Column:
    """Chat turns: system, one user/assistant pair per example, then the case."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    shots = F.flatten(
        F.transform(
            examples,
            lambda e: F.array(
                turn("user", evidence_request(e["question"], e["options"])),
                turn("assistant", letter(e["gold_index"])),
            ),
        )
    )
    return F.concat(
        F.array(turn("system", F.lit(EVIDENCE_SYSTEM))),
        shots,
        F.array(turn("user", evidence_request(question, options))),
    )


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)
