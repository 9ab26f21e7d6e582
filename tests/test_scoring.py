import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.operators import scoring as S
from gavel.operators import training as T
from gavel.plans.scoring_queries import HashScorer, hash_encoder


def items(spark, counts=(2, 3, 2, 5)):
    rows = [("d", "choice", f"i{i}", f"q{i}", [f"o{j}" for j in range(n)], 0) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "dataset string, task string, id string, question string, options array<string>, gold_index int")


def test_mock_matches_digest(spark):
    for row in S.mock_scores(items(spark, (2, 9, 32))).collect():
        digest = hashlib.sha256(row["question"].encode()).digest()
        scores = [digest[i] + 1.0 for i in range(len(row["options"]))]
        assert row["scores"] == scores and row["predicted_index"] == scores.index(max(scores))
        assert sum(row["probabilities"]) == pytest.approx(1.0)
    with pytest.raises(Exception, match="at most 32"):
        S.mock_scores(items(spark, (33,))).collect()


def test_plugin_equals_native(spark):
    df = items(spark, tuple(2 + i % 4 for i in range(50)))
    native = {r["id"]: (r["scores"], r["predicted_index"]) for r in S.mock_scores(df).collect()}
    for batch in (1, 4):
        got = S.score_items(df, HashScorer, batch_size=batch).collect()
        assert {r["id"]: (r["scores"], r["predicted_index"]) for r in got} == native
        assert all(r["latency_ms"] >= 0 and r["score_metadata"]["usage"] is None for r in got)
    with pytest.raises(ValueError):
        S.score_items(df, HashScorer, 0)


def test_retry_rules():
    def client(replies):
        waits, left = [], list(replies)
        return S.RetryingClient(lambda _: left.pop(0), 2, waits.append), waits

    call, waits = client([(503, {}, ""), (429, {"retry-after": "9"}, ""), (200, {}, "ok")])
    assert call("x") == "ok" and waits == [0.5, 5.0]
    call, waits = client([(500, {}, "")] * 3)
    with pytest.raises(RuntimeError, match="500"):
        call("x")
    assert waits == [0.5, 1.0]
    call, waits = client([(400, {}, "")])
    with pytest.raises(RuntimeError, match="400"):
        call("x")
    assert waits == []


def test_encode_once(spark):
    df = items(spark)
    distinct = []

    def encode(table):
        distinct.append(table)
        return hash_encoder(table)

    got = {r["id"]: r for r in S.encode_once(df, encode).collect()}
    assert distinct[0].count() == 4 + 5  # every question, every distinct option
    assert len(got["i3"]["candidate_vectors"]) == 5
    digest = hashlib.sha256(b"o1").digest()
    raw = [b / 127.5 - 1 for b in digest]
    norm = sum(v * v for v in raw) ** 0.5
    assert got["i0"]["candidate_vectors"][1] == pytest.approx([v / norm for v in raw])
    copies = df.union(df.withColumn("id", F.concat("id", F.lit("x")))).union(df)
    assert S.encode_once(copies, hash_encoder).count() == 12
    scored = S.contrastive(S.encode_once(df, hash_encoder), 500.0).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in scored)


def test_a_candidate_list_is_put_together_once(spark, monkeypatch):
    """One row a list, not one an item; shared and own lists give the same vectors."""
    rows = [(f"i{k}", "noul" if k % 5 == 0 else "choice", f"q{k % 7}", ["a", "b"] if k % 3 else ["b", "q1"]) for k in range(30)]
    df = spark.createDataFrame([*rows, ("n", "choice", None, ["a", "b"])], "id string, task string, question string, options array<string>")
    sizes, write = {}, S.materialize
    monkeypatch.setattr(S, "materialize", lambda table, name: sizes.setdefault(name, table.count()) and write(table, name))
    found = []
    for often in (1, 8, 1000):
        monkeypatch.setattr(S, "OFTEN", often)
        found.append({r["id"]: r for r in S.encode_once(df, hash_encoder).collect()})
    assert sizes["packed"] == 2 + 6  # two lists of choices, those of the yes/no questions
    assert found[0] == found[1] == found[2] and len(found[0]) == 31
    assert found[0]["n"]["state_vector"] is None and len(found[0]["i1"]["candidate_vectors"]) == 2
    assert found[0]["i3"]["candidate_vectors"][1] == found[0]["i1"]["state_vector"]  # both q1


def test_few_shot(spark):
    df = items(spark).withColumn("k", F.substring("id", 2, 5).cast("int"))
    pack = S.few_shot_pack(df, 2, "k")
    got = S.with_few_shot(df.withColumn("task", F.when(F.col("k") == 3, "noul").otherwise(F.col("task"))), pack).collect()
    by_id = {r["id"]: r["examples"] for r in got}
    assert [e["question"] for e in by_id["i0"]] == ["q0", "q1"] and by_id["i3"] == []


def test_entailment_has_no_probabilities(spark):
    from gavel.plans.scoring_queries import HashPairScorer

    rows = S.entailment(items(spark), HashPairScorer, "en", pair_batch=3).collect()
    for r in rows:
        want = [hashlib.sha256(f"{r['question']}|The correct answer is: {o}".encode()).digest()[0] / 255 for o in r["options"]]
        assert r["scores"] == pytest.approx(want) and r["probabilities"] is None


def vectors(spark, n=120):
    x = F.array((F.col("id") % 7 - 3).cast("double"), (F.col("id") % 5 - 2).cast("double"))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), x.alias("embedding"))


def test_yes_no_head_learns(spark):
    df = vectors(spark).withColumn("gold_index", (F.element_at("embedding", 1) > 0).cast("int")).withColumn("task", F.lit("noul"))
    model = T.get_trainer("yes_no_head").fit(df, df)
    assert model.history[-1]["val_accuracy"] > 0.95
    assert model.history[0]["mean_loss"] > model.history[-1]["mean_loss"]
    with pytest.raises(KeyError):
        T.get_trainer("other")


def candidate_rows(spark):
    e = F.col("embedding")
    shifted = F.transform(e, lambda v: -v)
    return vectors(spark).select(
        "id", F.array(e, shifted).alias("candidates"), F.lit("choice").alias("task"),
        F.when(F.element_at("embedding", 2) >= 0, 0).otherwise(1).alias("gold_index"),
    )


def test_candidate_head_learns(spark):
    df = candidate_rows(spark)
    model = T.CandidateHead(epochs=12, lr=0.2).fit(df, df)
    losses = [h["mean_loss"] for h in model.history]
    assert losses[-1] < losses[0] and model.history[-1]["val_accuracy"] > 0.9
    assert T.history_frame(spark, model).count() == 12


def fold_rows(spark, n=90):
    """Vectors with noise in the answers, so that the weights stay finite."""
    own = vectors(spark, n).withColumn("task", F.lit("noul")).withColumn("fold", (F.col("id").cast("int") % 3).cast("int"))
    answer = (F.element_at("embedding", 1) + F.element_at("embedding", 2) * 0.5 > 0) != (F.col("id").cast("int") % 11 == 0)
    return own.withColumn("gold_index", answer.cast("int"))


@pytest.mark.parametrize("newton_size", [512, 0])
def test_yes_no_steps_reach_the_optimum(spark, newton_size):
    """Newton and L-BFGS against a plain descent over the same rows, for all folds together."""
    rows = fold_rows(spark)
    local = rows.toPandas()
    x = np.column_stack([np.stack(local["embedding"]), np.ones(len(local))])
    y, fold = local["gold_index"].to_numpy(), local["fold"].to_numpy()
    models = T.YesNoHead(epochs=60, reg=0.01, newton_size=newton_size).fit_folds(rows, range(3))
    for k, model in enumerate(models):
        own, gold, w = x[fold != k], y[fold != k], np.zeros(3)
        for _ in range(20_000):
            p = 1 / (1 + np.exp(-own @ w))
            w = w - 0.2 * (own.T @ (p - gold) / len(own) + np.append(0.01 * w[:2], 0))
        assert [*model.weights, model.bias] == pytest.approx(w.tolist(), abs=1e-6)
        losses = [h["mean_loss"] for h in model.history]
        assert losses[0] == pytest.approx(np.log(2)) and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
        last = model.history[-1]
        assert last["train_accuracy"] == ((own @ w >= 0) == gold).mean()
        assert last["val_accuracy"] == ((x[fold == k] @ w >= 0) == y[fold == k]).mean()


def test_separable_rows_and_one_answer(spark):
    rows = vectors(spark).withColumn("gold_index", (F.element_at("embedding", 1) > 0).cast("int"))
    model = T.YesNoHead(epochs=8).fit(rows, rows)
    assert model.history[-1]["train_accuracy"] == model.history[-1]["val_accuracy"] == 1.0
    model = T.YesNoHead(epochs=8).fit(rows.withColumn("gold_index", F.lit(1)))
    assert np.isfinite(model.weights).all() and model.history[-1]["train_accuracy"] == 1.0 and model.history[-1]["val_accuracy"] is None
    with pytest.raises(ValueError, match="no training items"):
        T.YesNoHead().fit(rows.limit(0))


@pytest.mark.parametrize("head", [T.YesNoHead(epochs=3, reg=0.1), T.CandidateHead(epochs=3)])
def test_folds_together_equal_folds_apart(spark, head):
    rows = fold_rows(spark).withColumn("candidates", F.array("embedding", F.transform("embedding", lambda v: -v * 2)))
    together = head.fit_folds(rows, range(3))
    for k, model in enumerate(together):
        apart = head.fit(rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k))
        assert model.weights == pytest.approx(apart.weights) and model.bias == pytest.approx(apart.bias)
        for one, other in zip(model.history, apart.history, strict=True):
            assert one == pytest.approx(other)


def test_trainers_without_folds_still_cross_validate(spark):
    class Plain:
        def fit(self, train, validation=None):
            return T.CandidateHead(epochs=2, track=False).fit(train)

    df = candidate_rows(spark)
    _, plain = T.cross_validate(df, Plain, folds=3)
    _, together = T.cross_validate(df, lambda: T.CandidateHead(epochs=2, track=False), folds=3)
    assert plain.collect() == together.collect()


def test_an_epoch_of_all_folds_is_one_job(spark):
    """Jobs grow with the epochs, not with the folds."""
    rows = fold_rows(spark).withColumn("candidates", F.array("embedding", F.transform("embedding", lambda v: -v))).cache()
    tracker, counts = spark.sparkContext.statusTracker(), []
    for runs in (1, 3):
        spark.sparkContext.setJobGroup(f"folds-{runs}", "")
        T.CandidateHead(epochs=4, track=False).fit_folds(rows, range(runs))
        counts.append(len(tracker.getJobIdsForGroup(f"folds-{runs}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_cross_validation(spark):
    df = candidate_rows(spark)
    models, summary = T.cross_validate(df, lambda: T.CandidateHead(epochs=3, lr=0.2, track=False), folds=3)
    rows = summary.collect()
    assert len(models) == 3 and [r["metric"] for r in rows] == ["accuracy"]
    assert len(rows[0]["values"]) == 3 and 0 <= rows[0]["std"] < 0.5
    models, summary = T.cross_validate(df, lambda: T.CandidateHead(epochs=1, track=False), folds=1)
    assert len(models) == 1 and summary is None


def test_cv_summary_uses_population_std(spark):
    rows = [("choice", f, a) for f, a in enumerate((0.5, 0.7, 0.9))]
    df = spark.createDataFrame(rows, "task string, fold int, accuracy double")
    nulls = [m for g in T.FOLD_METRICS.values() for m in g if m != "accuracy"]
    df = df.withColumns({m: F.lit(None).cast("double") for m in nulls})
    got = T.cv_summary(df).first()
    assert got["mean"] == pytest.approx(0.7) and got["std"] == pytest.approx((0.08 / 3) ** 0.5)
    assert got["values"] == [0.5, 0.7, 0.9]
