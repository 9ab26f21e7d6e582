import json

import pytest
from pyspark.sql import functions as F

from gavel.functions import answers as N
from gavel.functions import prompts as P

QUESTION = 'He said "no\\yes"\n\tto é 日本 / end'
OPTIONS = ['a "quoted"', "二番目\n行", "c\\d"]


def args(task):
    return F.lit(task), F.lit(QUESTION), F.array(*[F.lit(o) for o in OPTIONS])


def dumps(value):
    return json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("task", ["noul", "choice", "score"])
def test_typed_request(one, task):
    got = one(P.typed_request(*args(task), "latest"))[0]
    answer = {"type": task, "instructions": QUESTION if task == "noul" else P.CHOOSE_ONE}
    if task == "choice":
        answer["criteria"] = {f"option_{i}": o for i, o in enumerate(OPTIONS)}
    if task == "score":
        answer["criteria"] = OPTIONS
    state = "" if task == "noul" else QUESTION
    assert got == dumps({"state": state, "model": "latest", "questions": {"answer": answer}})


def test_typed_request_unknown_task(one):
    with pytest.raises(Exception, match="unsupported task"):
        one(P.typed_request(*args("other")))


@pytest.mark.parametrize("task", ["noul", "choice", "score"])
def test_decision_request(one, task):
    got = json.loads(one(P.decision_request(*args(task))[1])[0])
    assert json.loads(got["instructions_json"]) == (QUESTION if task == "noul" else P.CHOOSE_ONE)
    ids = {"noul": ["false", "true"], "choice": ["option_0", "option_1", "option_2"], "score": ["0", "1", "2"]}
    assert [c["id"] for c in got["criteria"]] == ids[task]
    assert [c["value"] for c in got["criteria"]] == ([0, 1, 2] if task == "score" else [None] * len(ids[task]))
    shown = ["No.", "Yes."] if task == "noul" else OPTIONS
    assert [json.loads(c["description_json"]) for c in got["criteria"]] == shown


def test_evidence_and_document_requests(one):
    _, question, options = args("score")
    listed = [{"letter": "ABC"[i], "description": o} for i, o in enumerate(OPTIONS)]
    assert one(P.evidence_request(question, options))[0] == dumps(
        {"evidence": QUESTION, "criterion": P.EVIDENCE_CRITERION, "options": listed}
    )
    body, shown = one(*P.document_request(*args("score")))
    assert shown == [f"{i}: {o}" for i, o in enumerate(OPTIONS)]
    assert json.loads(body)["criterion"] == f"{P.DOCUMENT_POLICY}\n\n{P.CHOOSE_ONE}"
    body, shown = one(*P.document_request(*args("noul")))
    assert shown == ["true", "false"]
    assert json.loads(body)["criterion"].endswith(f"true: yes\nfalse: no\n\n{QUESTION}")


@pytest.mark.parametrize("whole", [False, True])
def test_candidate_spans(one, whole):
    _, question, options = args("choice")
    text, spans = one(*P.candidate_prompt(question, options, "検索: ", whole))
    cut = [text[s["start"]:s["end"]] for s in spans]
    assert cut == ([f"{'ABC'[i]}. {o}" for i, o in enumerate(OPTIONS)] if whole else ["A", "B", "C"])


def test_few_shot_block(one):
    shots = F.array(
        F.struct(F.lit("q1").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.lit(1).alias("gold_index"))
    )
    got = one(P.few_shot_block(F.lit("choice"), shots, F.lit("case")))[0]
    assert got == "以下は同じ形式の判定の解答例です。\n\n[例1]\nq1\n選択肢: 0: x / 1: y\n正解: y\n\n[判定対象]\ncase"
    got = one(P.few_shot_block(F.lit("noul"), shots, F.lit("")))[0]
    assert got.endswith("[例1]\nq1\n正解: y\n\n[判定対象]\n以下の質問に、上と同じ基準で答えてください。")


def test_parse_answers(one):
    three = F.lit(3)
    yes = one(N.parse_answer_json(F.lit("noul"), F.lit('{"noul": 0.5}'), F.lit(2)))[0]
    assert list(yes) == [[0.0, 0.5], [0.5, 0.5], 1]
    level = one(N.parse_answer_json(F.lit("score"), F.lit('{"probabilities": {"0": 0.2, "1": 0.4, "2": 0.4}}'), three))[0]
    assert level["predicted_index"] == 1
    text = '{"selected_id": "option_2", "probabilities": {"option_0": 0.5, "option_1": 0.3, "option_2": 0.2}}'
    assert one(N.parse_answer_json(F.lit("choice"), F.lit(text), three))[0]["predicted_index"] == 2
    with pytest.raises(Exception, match="probability missing"):
        one(N.parse_answer_json(F.lit("score"), F.lit('{"probabilities": {"0": 1.0}}'), three))


def test_parse_response(one):
    text = json.dumps(
        {"answers": {"answer": {"choice": "option_1", "confidence": 0.7,
                                "probabilities": {"option_0": 0.3, "option_1": 0.7}}},
         "model": "svc-1", "usage": {"input_tokens": 12, "output_tokens": 2}}
    )
    got = one(N.parse_response(F.lit(text), F.lit(2)))[0]
    assert got["scored"]["predicted_index"] == 1 and got["confidence"] == 0.7
    assert got["response_model"] == "svc-1" and got["usage"]["input_tokens"] == 12
