"""Queries over prompts, answers, scorers, training and the whole workflow."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import answers as A
from gavel.functions import prompts as P
from gavel.functions.arrays import (
    argmax,
    digest_bytes,
    l2_norm,
    layer_norm,
    mean_pool,
    rescale,
    softmax,
)
from gavel.operators import ranking as O
from gavel.operators import scoring as S
from gavel.operators import training as T
from gavel.plans import views as V
from gavel.plans.evaluation import evaluate
from gavel.plans.registry import query
from gavel.plans.sql_views import NL, byte, r9, sql, strip
from gavel.session import scratch_dir
from gavel.streaming.incremental import current_metrics, ingest

LABEL_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mapped(body: str, options: str = "options") -> str:
    """Options mapped with value `o` and 1-based index `i`."""
    return f"list_transform({options}, lambda o, i: {body})"


def _letter(index: str) -> str:
    return f"substr('{LABEL_TEXT}', {index}, 1)"


_BLOCK = f"array_to_string({_mapped(_letter('i') + chr(32) + '|| ' + chr(39) + '. ' + chr(39) + ' || o')}, {NL})"
_LETTER_PROMPT = f"'問題:' || {NL} || question || {NL} || {NL} || '選択肢:' || {NL} || {_BLOCK} || {NL} || {NL} || '答え:'"


@query(
    sql(
        f"""
SELECT id, sha256({_LETTER_PROMPT}) AS prompt_hash,
  sha256(question || {NL} || {_BLOCK} || {NL}) AS candidate_hash,
  array_to_string({_mapped(f"(length(question) + 1 + coalesce(list_sum(list_transform(options[1:i - 1], lambda x: length(x) + 4)), 0))::BIGINT")}, ',') AS starts,
  array_to_string({_mapped(f"(length(question) + 1 + coalesce(list_sum(list_transform(options[1:i - 1], lambda x: length(x) + 4)), 0) + length(o) + 3)::BIGINT")}, ',') AS ends
FROM items"""
    )
)
def choice_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter prompt, its hash, and the candidate prompt with its character spans."""
    items = V.all_items(spark, sf_dir)
    prompt = P.letter_prompt(F.col("question"), F.col("options"))
    text, spans = P.candidate_prompt(F.col("question"), F.col("options"), whole_option=True)
    return items.select(
        "id",
        P.prompt_hash(prompt).alias("prompt_hash"),
        F.sha2(text, 256).alias("candidate_hash"),
        F.array_join(F.transform(spans, lambda s: s["start"].cast("string")), ",").alias("starts"),
        F.array_join(F.transform(spans, lambda s: s["end"].cast("string")), ",").alias("ends"),
    )


_FEW = """
SELECT dataset, id, question, options, gold_index, CAST(split_part(id, ':', 2) AS BIGINT) AS k
FROM items_choice"""
_SHOT = "row_number() OVER (PARTITION BY dataset ORDER BY k)"


@query(
    sql(
        f"""
SELECT f.id, sha256('{P.FEW_SHOT_HEADER}' || {NL} || {NL} || e.block || {NL} || {NL} || '[判定対象]' || {NL} || f.question) AS prompt_hash,
  sha256(e.chat || {NL} || 'user:' || '{{"evidence": ' || to_json(f.question)::VARCHAR || ', "criterion": "Select the correct option.", "options": ['
     || array_to_string({_mapped("'{\"letter\": \"' || " + _letter('i') + " || '\", \"description\": ' || to_json(o)::VARCHAR || '}'", "f.options")}, ', ') || ']}}') AS chat_hash
FROM few f JOIN (
  SELECT dataset,
    string_agg('[例' || rn || ']' || {NL} || question || {NL} || '選択肢: '
      || array_to_string({_mapped("(i - 1) || ': ' || o")}, ' / ') || {NL} || '正解: ' || options[gold_index + 1], {NL} || {NL} ORDER BY rn) AS block,
    'system:{P.EVIDENCE_SYSTEM}' || {NL} || string_agg('user:' || '{{"evidence": ' || to_json(question)::VARCHAR || ', "criterion": "Select the correct option.", "options": ['
     || array_to_string({_mapped("'{\"letter\": \"' || " + _letter('i') + " || '\", \"description\": ' || to_json(o)::VARCHAR || '}'")}, ', ') || ']}}' || {NL} || 'assistant:' || {_letter("gold_index + 1")}, {NL} ORDER BY rn) AS chat
  FROM (SELECT *, {_SHOT} AS rn FROM few) WHERE rn <= 3 GROUP BY dataset) e USING (dataset)""",
        few=_FEW,
    )
)
def few_shot_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three examples of a dataset in front of each of its items, as text and chat turns."""
    items = V.items_choice(spark, sf_dir).withColumn(
        "k", F.substring_index("id", ":", -1).cast("bigint")
    )
    pack = S.few_shot_pack(items, 3, "k", "dataset")
    packed = S.with_few_shot(items, pack, "dataset")
    text = P.few_shot_block(F.col("task"), F.col("examples"), F.col("question"))
    chat = P.few_shot_messages(F.col("examples"), F.col("question"), F.col("options"))
    turns = F.transform(chat, lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return packed.select(
        "id",
        F.sha2(text, 256).alias("prompt_hash"),
        F.sha2(F.array_join(turns, "\n"), 256).alias("chat_hash"),
    )


def _js(text: str) -> str:
    return f"to_json({text})::VARCHAR"


_Q = _js("question")
_ONE = f"'\"{P.CHOOSE_ONE}\"'"
_TYPED = f"""
CASE task WHEN 'noul' THEN '{{"type": "noul", "instructions": ' || {_Q} || '}}'
 WHEN 'score' THEN '{{"type": "score", "instructions": ' || {_ONE} || ', "criteria": [' || array_to_string({_mapped(_js("o"))}, ', ') || ']}}'
 ELSE '{{"type": "choice", "instructions": ' || {_ONE} || ', "criteria": {{' || array_to_string({_mapped("'\"option_' || (i - 1) || '\": ' || " + _js("o"))}, ', ') || '}}}}' END"""
_STATE = "CASE WHEN task = 'noul' THEN '' ELSE question END"


def _criterion(key: str, text: str, value: str) -> str:
    return (
        f"'{{\"id\": ' || {_js(key)} || ', \"description_json\": ' || {_js(_js(text))} "
        f"|| ', \"value\": ' || {value} || '}}'"
    )


_CRITERIA = f"""CASE task
 WHEN 'noul' THEN {_criterion("'false'", "'No.'", "'null'")} || ', ' || {_criterion("'true'", "'Yes.'", "'null'")}
 WHEN 'score' THEN array_to_string({_mapped(_criterion("CAST(i - 1 AS VARCHAR)", "o", "(i - 1)"))}, ', ')
 ELSE array_to_string({_mapped(_criterion("'option_' || (i - 1)", "o", "'null'"))}, ', ') END"""
_INSTR = f"CASE WHEN task = 'noul' THEN question ELSE '{P.CHOOSE_ONE}' END"
_SHOWN = "CASE task WHEN 'noul' THEN ['true', 'false'] WHEN 'score' THEN list_transform(options, lambda o, i: (i - 1) || ': ' || o) ELSE options END"
_LETTERED = "'{\"letter\": \"' || " + _letter("i") + " || '\", \"description\": ' || " + _js("o") + " || '}'"
_POLICY = f"'{P.DOCUMENT_POLICY}' || CASE WHEN task = 'noul' THEN {NL} || 'true: yes' || {NL} || 'false: no' ELSE '' END"


@query(
    sql(
        f"""
SELECT id,
  sha256('{{"state": ' || {_js(_STATE)} || ', "model": "latest", "questions": {{"answer": ' || {_TYPED} || '}}}}') AS typed_hash,
  sha256('{{"id": "answer", "kind": "judgment", "type": "' || task || '", "instructions_json": ' || {_js(_js(_INSTR))}
    || ', "system_prompt": "", "criteria": [' || {_CRITERIA} || '], "documents": [], "scoring": null}}') AS decision_hash,
  sha256('{{"evidence": ' || {_Q} || ', "criterion": "Select the correct option.", "options": ['
    || array_to_string({_mapped(_LETTERED)}, ', ') || ']}}') AS evidence_hash,
  sha256('{{"evidence": ' || {_Q} || ', "criterion": ' || {_js(_POLICY + " || " + NL + " || " + NL + " || " + _INSTR)}
    || ', "options": [' || array_to_string({_mapped(_LETTERED, "(" + _SHOWN + ")")}, ', ') || ']}}') AS document_hash
FROM items"""
    )
)
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed request, decision, evidence and document requests of every item."""
    task, question, options = F.col("task"), F.col("question"), F.col("options")
    return V.all_items(spark, sf_dir).select(
        "id",
        F.sha2(P.typed_request(task, question, options, "latest"), 256).alias("typed_hash"),
        F.sha2(P.decision_request(task, question, options)[1], 256).alias("decision_hash"),
        F.sha2(P.evidence_request(question, options), 256).alias("evidence_hash"),
        F.sha2(P.document_request(task, question, options)[0], 256).alias("document_hash"),
    )


def _answer_json(task: Column, p: Column, predicted: Column) -> Column:
    """The answer a typed service would give for known probabilities."""

    def keyed(prefix: str) -> Column:
        entries = F.transform(
            p, lambda v, i: F.struct(F.concat(F.lit(prefix), i.cast("string")), v)
        )
        return F.map_from_entries(entries)

    nothing = F.lit(None).cast("map<string,double>")
    answer = F.struct(
        F.when(task == "noul", F.get(p, F.lit(1))).alias("noul"),
        F.when(task == "choice", F.concat(F.lit("option_"), predicted)).alias("choice"),
        F.lit(0.5).alias("confidence"),
        F.when(task == "score", keyed("")).when(task == "choice", keyed("option_"))
        .otherwise(nothing).alias("probabilities"),
    )
    return F.to_json(answer)


@query(
    sql(
        f"""
SELECT model, id, CASE WHEN task = 'noul' THEN (probabilities[2] >= 0.5)::INT ELSE predicted_index::INT END AS predicted_index,
  {r9("last_score", "probabilities[-1]")},
  {r9("first_probability", "CASE WHEN task = 'noul' THEN 1 - probabilities[2] ELSE probabilities[1] END")},
  CASE WHEN task = 'noul' THEN (probabilities[2] >= 0.5)::INT ELSE predicted_index::INT END AS from_distribution
FROM preds"""
    )
)
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed answers and plain distributions parsed back to scores and the predicted index."""
    predictions = V.preds(spark, sf_dir)
    task, p = F.col("task"), F.col("probabilities")
    text = _answer_json(task, p, F.col("predicted_index"))
    parsed = predictions.withColumn("answer", text).withColumn(
        "parsed", A.parse_answer_json(task, F.col("answer"), F.size("scores"))
    )
    out = parsed.select(
        "model",
        "id",
        F.col("parsed.predicted_index").alias("predicted_index"),
        F.element_at("parsed.scores", -1).alias("last_score"),
        F.element_at("parsed.probabilities", 1).alias("first_probability"),
        A.parse_distribution(task, p)["predicted_index"].alias("from_distribution"),
    )
    return V.rounded(out, "last_score", "first_probability")


@query(
    sql(
        f"""
SELECT model, dataset, count(*) AS n, sum(predicted_index)::BIGINT AS predicted_sum,
  sum(length(question))::BIGINT AS input_tokens, {r9("first_probability", "avg(probabilities[1])")}
FROM preds WHERE task = 'choice' GROUP BY ALL"""
    )
)
def api_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole service responses parsed with usage, confidence and model name."""
    predictions = V.predict(V.items_choice(spark, sf_dir))
    body = F.concat(
        F.lit('{"answers": {"answer": '),
        _answer_json(F.col("task"), F.col("probabilities"), F.col("predicted_index")),
        F.lit('}, "model": "'), F.col("model"), F.lit('", "usage": '),
        F.to_json("score_metadata.usage"), F.lit("}"),
    )
    parsed = predictions.select(
        "dataset", A.parse_response(body, F.size("scores")).alias("r")
    ).select("dataset", "r.*")
    out = parsed.groupBy(F.col("response_model").alias("model"), "dataset").agg(
        F.count("confidence").alias("n"),
        F.sum("scored.predicted_index").alias("predicted_sum"),
        F.sum("usage.input_tokens").alias("input_tokens"),
        F.avg(F.element_at("scored.probabilities", 1)).alias("first_probability"),
    )
    return V.rounded(out, "first_probability")


class HashPairScorer:
    """Deterministic stand-in for an entailment model."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [hashlib.sha256(f"{p}|{h}".encode()).digest()[0] / 255 for p, h in pairs]


_HYP = "'正しい答えは「' || o || '」である。'"


@query(
    sql(
        f"""
SELECT id, hypotheses, list_position(s, list_max(s))::INT - 1 AS predicted_index, {r9("best", "list_max(s)")},
  CAST(NULL AS DOUBLE) AS probability
FROM (SELECT id, array_to_string({_mapped(_HYP)}, '|') AS hypotheses,
        {_mapped(byte("sha256(question || '|' || " + _HYP + ")", "0") + " / 255")} AS s
      FROM items_choice)"""
    )
)
def hypothesis_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis per option, scored independently; no probabilities come out."""
    items = V.items_choice(spark, sf_dir)
    scored = S.entailment(items, HashPairScorer)
    out = scored.select(
        "id",
        F.array_join(P.hypotheses(F.col("options")), "|").alias("hypotheses"),
        "predicted_index",
        F.array_max("scores").alias("best"),
        F.array_max("probabilities").alias("probability"),
    )
    return V.rounded(out, "best", "probability")


_TEMPERATURES = {"choice": 0.8, "noul": 0.75, "score": 1.25}  # any values above zero


def _softmax_sql(values: str) -> str:
    return (
        f"list_transform({values}, lambda v: exp(v - list_max({values})) "
        f"/ list_sum(list_transform({values}, lambda w: exp(w - list_max({values})))))"
    )


@query(
    sql(
        f"""
SELECT model, id, {r9("rescaled_first", "r[1]")}, {r9("rescaled_max", "list_max(r)")},
  list_position(r, list_max(r))::INT - 1 AS predicted_index, {r9("soft_last", "s[-1]")}
FROM (SELECT model, id, {_softmax_sql("l")} AS r, {_softmax_sql("z")} AS s FROM (
  SELECT model, id, list_transform(scores, lambda v: v / 64) AS z,
    list_transform(probabilities, lambda p: ln(greatest(p, 1e-12)) / CASE task
      WHEN 'choice' THEN {_TEMPERATURES["choice"]}::DOUBLE WHEN 'noul' THEN {_TEMPERATURES["noul"]}::DOUBLE
      ELSE {_TEMPERATURES["score"]}::DOUBLE END) AS l FROM preds))"""
    )
)
def softmax_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature rescaling per task and plain softmax; the arg-max never moves."""
    temperature = F.coalesce(
        *[F.when(F.col("task") == t, F.lit(v)) for t, v in _TEMPERATURES.items()]
    )
    scaled = V.preds(spark, sf_dir).select(
        "model",
        "id",
        rescale(F.col("probabilities"), temperature).alias("r"),
        softmax(F.transform("scores", lambda v: v / 64)).alias("s"),
    )
    out = scaled.select(
        "model",
        "id",
        F.element_at("r", 1).alias("rescaled_first"),
        F.array_max("r").alias("rescaled_max"),
        argmax(F.col("r")).alias("predicted_index"),
        F.element_at("s", -1).alias("soft_last"),
    )
    return V.rounded(out, "rescaled_first", "rescaled_max", "soft_last")


WEIGHTS = [((j * 37) % 64 - 32) / 32 for j in range(64)]
CANDIDATE_WEIGHTS = WEIGHTS[:16]
_VECTOR = "list_transform(embedding, lambda x: x::DOUBLE)"


def _dot(vector: str, weights: list[float]) -> str:
    return f"list_dot_product({vector}, {weights}::DOUBLE[])"


@query(
    f"""
SELECT vec_id, {r9("logit", _dot(_VECTOR, WEIGHTS) + " + 0.25")},
  {r9("p_true", "1 / (1 + exp(-(" + _dot(_VECTOR, WEIGHTS) + " + 0.25)))")},
  ({_dot(_VECTOR, WEIGHTS)} + 0.25 >= 0)::INT AS predicted_index
FROM embeddings"""
)
def embed_linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no from a linear head over a state vector."""
    scored = S.linear_yes_no(V.table(spark, sf_dir, "embeddings"), WEIGHTS, 0.25)
    out = scored.select(
        "vec_id",
        F.element_at("scores", 2).alias("logit"),
        F.element_at("probabilities", 2).alias("p_true"),
        "predicted_index",
    )
    return V.rounded(out, "logit", "p_true")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidate vectors per row, cut from the embedding."""
    vectors = V.table(spark, sf_dir, "embeddings")
    parts = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    return vectors.select(
        F.col("vec_id").cast("string").alias("id"), "vec_id", parts.alias("candidates"),
        (F.col("label") % 4).cast("int").alias("gold_index"), F.lit("choice").alias("task"),
        "embedding", "label",
    )


_CAND = f"[{', '.join(_dot(f'({_VECTOR})[{16 * i + 1}:{16 * i + 16}]', CANDIDATE_WEIGHTS) for i in range(4))}]"


@query(
    f"""
SELECT vec_id, list_position(l, list_max(l))::INT - 1 AS predicted_index,
  {r9("top", "list_max(" + _softmax_sql("l") + ")")}
FROM (SELECT vec_id, {_CAND} AS l FROM embeddings)"""
)
def linear_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice from one linear head over a row's candidate vectors."""
    scored = S.linear_candidates(_candidates(spark, sf_dir), CANDIDATE_WEIGHTS)
    out = scored.select("vec_id", "predicted_index", F.array_max("probabilities").alias("top"))
    return V.rounded(out, "top")


def hash_encoder(table: DataFrame) -> DataFrame:
    """Deterministic text encoder: 32 digest bytes on a -1..1 scale."""
    scaled = F.transform(
        digest_bytes(F.col("text"), 32), lambda b: b.cast("double") / 127.5 - 1.0
    )
    return table.select("text", scaled.alias("vector"))


def _hash_vector(text: str) -> str:
    return f"list_transform(range(32), lambda i: {byte(f'sha256({text})', 'i')} / 127.5::DOUBLE - 1)"


_CONTRASTIVE = {
    "uses": f"""
SELECT id, task, {strip("question")} AS state,
  CASE WHEN task = 'noul' THEN ['false: No. This is false: ' || {strip("question")},
                                'true: Yes. This is true: ' || {strip("question")}] ELSE options END AS c
FROM (SELECT * FROM items_choice UNION ALL SELECT * FROM items_noul)""",
    "logits": f"""
SELECT id, task, list_transform(c, lambda o:
  list_cosine_similarity({_hash_vector("state")}, {_hash_vector("o")}) * 20) AS l FROM uses""",
    "soft": f"SELECT id, task, {_softmax_sql('l')} AS p FROM logits",
}


@query(
    sql(
        f"""
SELECT id, CASE WHEN task = 'noul' THEN (p[2] >= 0.5)::INT
                ELSE list_position(p, list_max(p))::INT - 1 END AS predicted_index,
  {r9("last_probability", "p[-1]")} FROM soft""",
        **_CONTRASTIVE,
    )
)
def contrastive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text encoded once; scaled cosine of state and candidates, softmax."""
    items = V.items_choice(spark, sf_dir).unionByName(V.items_noul(spark, sf_dir))
    vectors = S.encode_once(items, hash_encoder)
    out = S.contrastive(vectors, 20.0, unit_length=True).select(
        "id", "predicted_index", F.element_at("probabilities", -1).alias("last_probability")
    )
    return V.rounded(out, "last_probability")


_MEAN = f"list_avg({_VECTOR})"


@query(
    f"""
SELECT vec_id, {r9("norm_first", f"(v[1] - m) / sqrt(var + 1e-5)")}, {r9("norm_last", f"(v[64] - m) / sqrt(var + 1e-5)")},
  {r9("pooled_first", "(v[1] + v[17] + v[33] + v[49]) / 4")}, {r9("length", "sqrt(list_dot_product(v, v))")}
FROM (SELECT vec_id, v, m, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) AS var
      FROM (SELECT vec_id, {_VECTOR} AS v, {_MEAN} AS m FROM embeddings))"""
)
def vector_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter-free layer norm, mean pooling of token states, vector length."""
    rows = _candidates(spark, sf_dir).select(
        "vec_id",
        layer_norm(F.col("embedding")).alias("n"),
        mean_pool(F.col("candidates")).alias("m"),
        l2_norm(F.col("embedding")).alias("length"),
    )
    out = rows.select(
        "vec_id",
        F.element_at("n", 1).alias("norm_first"),
        F.element_at("n", -1).alias("norm_last"),
        F.element_at("m", 1).alias("pooled_first"),
        "length",
    )
    return V.rounded(out, "norm_first", "norm_last", "pooled_first", "length")


_CV = """
SELECT task, model, fold, metric, value FROM (
  SELECT task, model, fold, avg((predicted_index = gold_index)::INT) AS acc,
    count(*) FILTER (WHERE predicted_index = 1 AND gold_index = 1) AS tp,
    count(*) FILTER (WHERE predicted_index = 1 AND gold_index = 0) AS fp,
    count(*) FILTER (WHERE predicted_index = 0 AND gold_index = 1) AS fn
  FROM preds JOIN (SELECT dataset, id, ntile(3) OVER (PARTITION BY dataset ORDER BY sha256('42:' || id), id) - 1 AS fold
                   FROM items WHERE task <> 'score') USING (dataset, id) GROUP BY ALL),
LATERAL (SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
  unnest([acc, coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
          coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)]) AS value)
WHERE task = 'noul' OR metric = 'accuracy'"""


@query(
    sql(
        f"""
SELECT task, model, metric, {r9("mean", "avg(value)")}, {r9("std", "stddev_pop(value)")},
  string_agg(printf('%.12f', value), ',' ORDER BY fold) AS values FROM cv GROUP BY ALL""",
        cv=_CV,
    )
)
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold metrics of three folds with mean, population std and the fold values."""
    parts = [V.items_noul(spark, sf_dir), V.items_noul(spark, sf_dir, "quality"), V.items_choice(spark, sf_dir)]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    predictions = V.predict(items)
    folds = O.kfold(items.select("dataset", "id"), 3, ["dataset"])
    tagged = predictions.join(folds, ["dataset", "id"])
    metrics = T.fold_metrics(tagged, ["task", "model", "fold"])
    out = T.cv_summary(metrics, ["task", "model"])
    values = F.transform("values", lambda v: F.format_string("%.12f", v))
    return V.rounded(
        out.select("task", "model", "metric", "mean", "std", F.array_join(values, ",").alias("values")),
        "mean", "std",
    )


@query()
def head_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no head fitted on vectors; loss per iteration and validation accuracy."""
    rows = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding",
        (F.col("label") >= 5).cast("int").alias("gold_index"), F.lit("noul").alias("task"),
    )
    split = O.holdout(rows, 0.1)
    model = T.get_trainer("yes_no_head", epochs=10).fit(
        split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")
    )
    return T.history_frame(spark, model)


def _held_out(key: str, fraction: float) -> str:
    """Whether a row of `embeddings` is in the seeded hold-out."""
    order = f"row_number() OVER (ORDER BY sha256('42:' || {key}), {key}::VARCHAR)"
    return f"{order} <= greatest(1, floor(count(*) OVER () * {fraction}))"


def _candidate_steps(rows: str, epochs: int, lr: float = 0.05) -> dict[str, str]:
    """CTEs of the candidate head's epochs, unrolled: w<e> the weights after epoch e, l<e> its loss, a<e> the accuracies after it.

    `rows` gives run, g, c (candidate vectors) and held (validation row of the run).
    """
    views = {
        "steps0": rows,
        "w0": "SELECT DISTINCT run, list_transform(range(16), lambda i: 0.0::DOUBLE) AS w FROM steps0",
        "m0": "SELECT run, j, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM w0, (SELECT unnest(range(1, 17)) AS j)",
    }
    for e in range(1, epochs + 2):
        views[f"z{e}"] = f"SELECT run, held, g, c, list_transform(c, lambda v: list_dot_product(v, w)) AS z FROM steps0 JOIN w{e - 1} USING (run)"
        if e > 1:
            right = "avg((list_position(z, list_max(z)) = g + 1)::INT)"
            views[f"a{e - 1}"] = f"SELECT run, {right} FILTER (NOT held) AS fit, {right} FILTER (held) AS val FROM z{e} GROUP BY run"
        if e > epochs:
            break
        views[f"p{e}"] = (
            "SELECT run, g, c, list_transform(x, lambda y: y / list_sum(x)) AS p FROM (SELECT run, g, c, "
            f"list_transform(z, lambda y: exp(y - list_max(z))) AS x FROM z{e} WHERE NOT held)"
        )
        views[f"l{e}"] = f"SELECT run, avg(-ln(greatest(p[g + 1], 1e-12))) AS loss FROM p{e} GROUP BY run"
        views[f"g{e}"] = (
            "SELECT run, j, avg(list_sum(list_transform(p, lambda x, k: (x - (k = g + 1)::INT) * c[k][j]))) AS s "
            f"FROM p{e}, (SELECT unnest(range(1, 17)) AS j) GROUP BY run, j"
        )
        views[f"m{e}"] = f"SELECT run, j, 0.9 * m + 0.1 * s AS m, 0.999 * v + 0.001 * s * s AS v FROM g{e} JOIN m{e - 1} USING (run, j)"
        step = f"(m / (1 - pow(0.9, {e}))) / (sqrt(v / (1 - pow(0.999, {e}))) + 1e-8)"
        views[f"w{e}"] = f"SELECT run, list(w[j] - {lr} * {step} ORDER BY j) AS w FROM m{e} JOIN w{e - 1} USING (run) GROUP BY run"
    return views


_CANDIDATE_ROWS = "label % 4 AS g, list_transform(range(4), lambda i: embedding[16 * i + 1:16 * i + 16]::DOUBLE[]) AS c"


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT {e} AS epoch, {r9('mean_loss', 'loss')}, {r9('train_accuracy', 'fit')}, {r9('val_accuracy', 'val')} "
            f"FROM l{e} JOIN a{e} USING (run)"
            for e in (1, 2, 3)
        ),
        **_candidate_steps(f"SELECT 0 AS run, {_CANDIDATE_ROWS}, {_held_out('vec_id', 0.1)} AS held FROM embeddings", 3),
    )
)
def candidate_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared-weight candidate head: loss and accuracies per epoch."""
    split = O.holdout(_candidates(spark, sf_dir), 0.1)
    model = T.get_trainer("candidate_head", epochs=3).fit(
        split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")
    )
    return V.rounded(T.history_frame(spark, model), "mean_loss", "train_accuracy", "val_accuracy")


_ONE_FEATURE = (
    "SELECT embedding[1]::DOUBLE AS x, (label >= 5)::INT AS y, " + _held_out("vec_id", 0.1) + " AS held FROM embeddings"
)


def _yes_no_steps(epochs: int, reg: float) -> dict[str, str]:
    """CTEs of Newton's steps for one feature and a bias, unrolled: s<e> the sums before step e, t<e> the weights after it."""
    views = {"one": _ONE_FEATURE, "t0": "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b"}
    for e in range(1, epochs + 1):
        views[f"s{e}"] = f"""
SELECT any_value(a) AS a, any_value(b) AS b, avg(ln(1 + exp(z)) - y * z) + {reg} / 2 * any_value(a * a) AS loss,
  avg((p - y) * x) + {reg} * any_value(a) AS ga, avg(p - y) AS gb, avg(p * (1 - p) * x * x) + {reg} AS haa,
  avg(p * (1 - p) * x) AS hab, avg(p * (1 - p)) AS hbb
FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM (SELECT *, a * x + b AS z FROM one, t{e - 1} WHERE NOT held))"""
        views[f"t{e}"] = (
            "SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, "
            f"b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{e}"
        )
        views[f"h{e}"] = (
            "SELECT avg(((a * x + b >= 0) = (y = 1))::INT) FILTER (NOT held) AS fit, "
            f"avg(((a * x + b >= 0) = (y = 1))::INT) FILTER (held) AS val FROM one, t{e}"
        )
    return views


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT {e} AS epoch, {r9('mean_loss', 'loss')}, {r9('train_accuracy', 'fit')}, {r9('val_accuracy', 'val')} FROM s{e}, h{e}"
            for e in (1, 2, 3)
        ),
        **_yes_no_steps(3, 0.01),
    )
)
def yes_no_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no head on the first component: loss and both accuracies of every Newton step."""
    rows = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.slice("embedding", 1, 1).alias("embedding"),
        (F.col("label") >= 5).cast("int").alias("gold_index"),
    )
    split = O.holdout(rows, 0.1)
    model = T.get_trainer("yes_no_head", epochs=3, reg=0.01, tolerance=0.0).fit(
        split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")
    )
    return V.rounded(T.history_frame(spark, model), "mean_loss", "train_accuracy", "val_accuracy")


_FOLDS = "ntile(3) OVER (ORDER BY sha256('42:' || vec_id), vec_id::VARCHAR) - 1"


@query(
    sql(
        f"SELECT 'choice' AS task, 'accuracy' AS metric, {r9('mean', 'avg(val)')}, {r9('std', 'stddev_pop(val)')}, "
        "to_json(list(val ORDER BY run))::VARCHAR AS values FROM a2",
        **_candidate_steps(
            f"SELECT run, g, c, run = fold AS held FROM (SELECT {_CANDIDATE_ROWS}, {_FOLDS} AS fold FROM embeddings), "
            "(SELECT unnest(range(3)) AS run)",
            2,
        ),
    )
)
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-fold cross-validation of the candidate head."""
    _, summary = T.cross_validate(
        _candidates(spark, sf_dir), lambda: T.CandidateHead(epochs=2, track=False), folds=3
    )
    return V.rounded(summary.withColumn("values", F.to_json("values")), "mean", "std")


class HashScorer:
    """Plug-in counterpart of the native mock scorer, batched."""

    def score_batch(self, batch: list[tuple[str, list[str]]]) -> list[dict]:
        if len({len(options) for _, options in batch}) != 1:
            raise ValueError("a batch must share one option count")
        return [self.score(question, options) for question, options in batch]

    def score(self, question: str, options: list[str]) -> dict:
        digest = hashlib.sha256(question.encode()).digest()
        scores = [digest[i] + 1.0 for i in range(len(options))]
        total = sum(scores)
        return {
            "scores": scores,
            "probabilities": [s / total for s in scores],
            "predicted_index": max(range(len(scores)), key=scores.__getitem__),
        }


_PLAIN = f"""
SELECT dataset, id, gold_index, list_transform(range(len(options)),
  lambda i: {byte("sha256(question)", "i")} + 1.0::DOUBLE) AS s FROM items"""


@query(
    sql(
        f"""
SELECT dataset, id, list_position(s, list_max(s))::INT - 1 AS predicted_index,
  {r9("top", "list_max(s) / list_sum(s)")}, true AS timed FROM plain""",
        plain=_PLAIN,
    )
)
def scorer_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batched Python scorer over items with different option counts."""
    scored = S.score_items(V.all_items(spark, sf_dir), HashScorer, batch_size=32)
    out = scored.select(
        "dataset", "id", "predicted_index", F.array_max("probabilities").alias("top"),
        (F.col("latency_ms") >= 0).alias("timed"),
    )
    return V.rounded(out, "top")


class FlakyService:
    """Injected client: fails twice with a retryable status, then answers like the mock scorer."""

    def __init__(self) -> None:
        self.calls = 0
        self.send = S.RetryingClient(self.post, max_retries=2, sleep=lambda _: None)

    def post(self, payload: str) -> tuple[int, dict[str, str], str]:
        self.calls += 1
        if self.calls % 3:
            return 503, {"retry-after": "0.1"}, ""
        body = json.loads(payload)
        options = list(body["questions"]["answer"]["criteria"].values())
        result = HashScorer().score(body["state"], options)
        answer = {
            "choice": f"option_{result['predicted_index']}",
            "probabilities": {f"option_{i}": p for i, p in enumerate(result["probabilities"])},
        }
        return 200, {}, json.dumps({"answers": {"answer": answer}, "model": body["model"]})

    def __call__(self, payload: str) -> str:
        return self.send(payload)


@query(
    sql(
        f"""
SELECT id, list_position(s, list_max(s))::INT - 1 AS predicted_index, {r9("top", "list_max(s) / list_sum(s)")},
  'latest' AS response_model FROM plain WHERE starts_with(dataset, 'prio_')""",
        plain=_PLAIN,
    )
)
def retrying_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests sent through a retrying client, answers parsed back into columns."""
    items = V.items_choice(spark, sf_dir)
    requests = items.select(
        "id",
        F.size("options").alias("n"),
        P.typed_request(F.col("task"), F.col("question"), F.col("options"), "latest").alias("request"),
    )
    answered = S.remote_answers(requests, FlakyService)
    parsed = answered.select("id", A.parse_response(F.col("response"), F.col("n")).alias("r"))
    out = parsed.select(
        "id",
        "r.scored.predicted_index",
        F.array_max("r.scored.probabilities").alias("top"),
        "r.response_model",
    )
    return V.rounded(out, "top")


_INCREMENTAL = (
    "accuracy", "p50_latency_ms", "p95_latency_ms", "ece", "spearman", "quadratic_weighted_kappa",
)


@query(
    sql(f"SELECT model, dataset, total, {', '.join(r9(c) for c in _INCREMENTAL)} FROM dm WHERE task = 'score'",
        present="SELECT * FROM preds")
)
def incremental_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions arriving in two drops, ingested exactly once, equal the batch result."""
    predictions = V.predict(V.items_score(spark, sf_dir)).withColumn(
        "item_metadata", F.lit(None).cast("map<string,string>")
    )
    root = scratch_dir(spark, "incremental")
    drop, state, checkpoint = f"{root}/drop", f"{root}/state", f"{root}/checkpoint"
    early = F.col("model").isin("m0", "m1", "m2")
    predictions.filter(early).write.mode("append").parquet(drop)
    ingest(spark, drop, state, checkpoint)
    predictions.filter(~early).write.mode("append").parquet(drop)
    ingest(spark, drop, state, checkpoint)
    out = current_metrics(spark, state).select("model", "dataset", "total", *_INCREMENTAL)
    return V.rounded(out, *_INCREMENTAL)


_MOCK2 = f"""
SELECT model, dataset, gold_index, list_position(s, list_max(s)) - 1 AS predicted_index FROM (
  SELECT model, dataset, gold_index, list_transform(range(n), lambda i: {byte("h", "i")} + 1.0::DOUBLE) AS s FROM (
    SELECT model, dataset, gold_index, n, sha256(model || ':' || question) AS h
    FROM flow_items, (SELECT unnest(['m0', 'm1']) AS model)))"""
_FLOW = {
    "flow_items": f"""
SELECT 'long_docs' AS dataset, {strip("'長文ですか？ ' || text")} AS question, (n_chars >= 1000)::INT AS gold_index, 2 AS n
FROM documents WHERE lang <> 'es'
UNION ALL SELECT 'event_size', '{V.EVENT_PROMPT}' || {NL} || '状態: ' || event_type || ' ' || value,
  (value >= 100)::INT + (value >= 200)::INT + (value >= 300)::INT + (value >= 400)::INT, 5
FROM events WHERE event_type IN ('click', 'view')""",
    "flow_preds": _MOCK2,
}


@query(
    sql(
        f"""
SELECT model, {r9("noul", "n")}, CAST(NULL AS DOUBLE) AS choice, {r9("score", "s")}, {r9("overall", "(n + s * 3) / 4")},
  'partial' AS overall_status, '2/3' AS coverage
FROM (SELECT model, 2 * count(*) FILTER (WHERE dataset = 'long_docs' AND predicted_index = 1 AND gold_index = 1)
    / (2 * count(*) FILTER (WHERE dataset = 'long_docs' AND predicted_index = 1 AND gold_index = 1)
       + count(*) FILTER (WHERE dataset = 'long_docs' AND predicted_index <> gold_index)) AS n,
  avg((predicted_index = gold_index)::INT) FILTER (WHERE dataset = 'event_size') AS s
  FROM flow_preds GROUP BY model)""",
        **_FLOW,
    )
)
def evaluation_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration to leaderboard: read, filter, convert, score, evaluate, roll up."""
    config = {
        "version": 1,
        "runtime": {"datasets_root": sf_dir, "seed": 42},
        "models": [{"id": "m0"}, {"id": "m1"}, {"id": "off", "enabled": False}],
        "datasets": [
            {
                "id": "long_docs",
                "task": "noul",
                "source": {
                    "path": "documents.parquet", "format": "parquet", "adapter": "noul",
                    "gold_field": "n_chars", "positive_min": 1000, "item_id_field": "doc_id",
                    "question_template": "長文ですか？ {text}", "where_not": {"lang": "es"},
                },
            },
            {
                "id": "event_size",
                "task": "score",
                "source": {
                    "path": "events.parquet", "format": "parquet", "adapter": "score",
                    "gold_field": "value", "gold_thresholds": V.EVENT_THRESHOLDS,
                    "criteria": V.EVENT_CRITERIA, "prompt": V.EVENT_PROMPT,
                    "question_template": "{event_type} {value}",
                    "where_in": {"event_type": ["click", "view"]},
                },
            },
            {"id": "absent", "source": {"path": "absent.parquet", "format": "parquet"}},
        ],
        "tasks": {
            "noul": {"datasets": ["long_docs"], "aggregate_metric": "f1"},
            "score": {"datasets": ["event_size"], "aggregate_metric": "accuracy"},
            "choice": {"datasets": ["absent"], "aggregate_metric": "accuracy"},
            "summary": {"weights": {"noul": 1, "score": 3}},
        },
    }

    def scorer(model: str):
        def run(items: DataFrame) -> DataFrame:
            usage = F.lit(None).cast("struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>")
            return S.mock_scores(items, F.lit(model)).withColumns(
                {"latency_ms": F.lit(1.0), "score_metadata": usage}
            )

        return run

    board = evaluate(spark, config, {m: scorer(m) for m in ("m0", "m1")}).board
    out = board.select("model", "noul", "choice", "score", "overall", "overall_status", "coverage")
    return V.rounded(out, "noul", "choice", "score", "overall")




@query(
    "SELECT count(*) AS n, count(*) FILTER (WHERE label >= 5) AS positives, true AS falling, true AS stationary FROM embeddings"
)
def head_fit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yes/no head's loss never rises, and its gradient is near zero where it stopped."""
    reg = 0.01
    rows = V.table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("gold_index"))
    model = T.get_trainer("yes_no_head", epochs=100, reg=reg).fit(rows)
    losses = [h["mean_loss"] for h in model.history]
    falling = all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    wrong = F.get("probabilities", F.lit(1)) - F.col("gold_index")
    slopes = model.transform(rows).select(
        "gold_index", F.posexplode(F.transform("embedding", lambda x: x.cast("double") * wrong)).alias("pos", "slope")
    )
    weight = F.element_at(F.array(*map(F.lit, model.weights)), F.col("pos") + 1)
    sums = slopes.groupBy("pos").agg(
        F.avg("slope").alias("slope"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold_index") == 1).alias("positives")
    )
    return sums.agg(
        F.max("n").alias("n"), F.max("positives").alias("positives"), F.lit(falling).alias("falling"),
        (F.max(F.abs(F.col("slope") + reg * weight)) < 1e-3).alias("stationary"),
    )


@query(
    f"""
WITH r AS (SELECT label % 4 AS g, list_transform(range(4), lambda i: embedding[16 * i + 1:16 * i + 16]::DOUBLE[]) AS c FROM embeddings),
s AS (SELECT j, avg(list_sum(list_transform(c, lambda v, k: (0.25 - (k = g + 1)::INT) * v[j]))) AS slope
  FROM r, (SELECT unnest(range(1, 17)) AS j) GROUP BY j),
w AS (SELECT list(-0.05 * slope / (abs(slope) + 1e-8) ORDER BY j) AS w FROM s),
z AS (SELECT g, list_transform(c, lambda v: list_dot_product(v, w)) AS z FROM r, w)
SELECT 1 AS epoch, {r9("mean_loss", "ln(4)")}
UNION ALL SELECT 2, {r9("mean_loss", "avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[g + 1])")} FROM z"""
)
def candidate_fit_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the candidate head's first two epochs: equal candidates, then one step against the gradient."""
    model = T.CandidateHead(epochs=2, lr=0.05, track=False).fit(_candidates(spark, sf_dir))
    return V.rounded(T.history_frame(spark, model).select("epoch", "mean_loss"), "mean_loss")
