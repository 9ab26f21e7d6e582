"""Physical plans: pushdown, pruning and the absence of all-pairs joins."""

import pytest

from gavel.operators import metrics as M
from gavel.operators.ranking import hash_rank
from gavel.plans import QUERIES
from gavel.plans import views as V
from gavel.schemas import PREDICTION

SF_DIR = "/root/testdata/sf0.001"
# These run Spark jobs while they are built.
EAGER = {
    "head_training", "candidate_head", "cross_validation", "head_fit_check", "candidate_fit_losses", "yes_no_epochs", "csv_blocks", "zip_members", "incremental_eval", "source_round_trips",
    "mirror_round_trip", "multi_file_row_numbers", "corpus_files", "stored_predictions", "leaderboard_documents", "contrastive_scores",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_all_pairs_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["latency_profile"](spark, SF_DIR))
    assert "html" not in text and "o_totalprice" not in text
    text = plan(QUERIES["value_percentiles"](spark, SF_DIR))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in text


def test_stored_predictions_prune_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([], PREDICTION).write.parquet(path)
    text = plan(M.latency_profile(spark.read.parquet(path)))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("probabilities" not in s and "scores" not in s for s in scans)


def test_percentiles_read_their_input_once(spark):
    df = QUERIES["value_percentiles"](spark, SF_DIR)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan") == 2  # the counts and the value cells


def test_metrics_combine_before_the_shuffle(spark):
    text = plan(M.metric_cells(V.preds(spark, SF_DIR)))
    assert text.count("Exchange hashpartitioning") <= 4 and "partial_sum" in text


def test_hash_rank_shuffles_rows_once(spark):
    """The offsets join on the rows' own partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("string(id) AS id", "id % 3 AS k")
        text = plan(hash_rank(df, ["k"], "id"))
        rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert len(rows) <= 4, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_predictions_hash_their_question_once(spark):
    """Latency and scores come from one digest."""
    text = V.predict(V.items_choice(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sha2(") == 1
