from pyspark.sql import functions as F

from gavel.operators.metrics import summarize
from gavel.operators.scoring import mock_scores
from gavel.streaming import incremental as I


def predictions(spark, low, high):
    rows = spark.range(low, high).select(
        F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.lit("score").alias("task"),
        F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("q"), "id").alias("question"),
        F.array(*[F.lit(x) for x in "abcd"]).alias("options"), (F.col("id") % 4).cast("int").alias("gold_index"),
    )
    return mock_scores(rows).select(
        "model", "dataset", "task", "id", "gold_index", "predicted_index", "scores", "probabilities",
        (F.col("predicted_index") * 1.5).alias("latency_ms"),
        F.lit(None).cast("map<string,string>").alias("item_metadata"),
        F.lit(None).cast("struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>").alias("score_metadata"),
    )


def close(a, b):
    return all(
        x == y or (x is not None and y is not None and abs(x - y) < 1e-12)
        for x, y in zip(a.asDict().values(), b.asDict().values())
        if not isinstance(x, str)
    )


def test_each_file_counts_once(spark, tmp_path):
    drop, state, checkpoint = (f"{tmp_path}/{n}" for n in ("drop", "state", "checkpoint"))
    predictions(spark, 0, 70).write.mode("append").parquet(drop)
    I.ingest(spark, drop, state, checkpoint)
    assert I.current_metrics(spark, state).first()["total"] == 70
    predictions(spark, 70, 150).write.mode("append").parquet(drop)
    I.ingest(spark, drop, state, checkpoint, max_files=1)
    I.ingest(spark, drop, state, checkpoint)
    got = I.current_metrics(spark, state)
    want = summarize(predictions(spark, 0, 150)).select(*got.columns)
    assert close(got.first(), want.first())
    I.compact(spark, state, f"{tmp_path}/compacted")
    assert close(I.current_metrics(spark, f"{tmp_path}/compacted").first(), want.first())
