import csv
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gavel.operators import leaderboard as L
from gavel.operators.mirror import mirror_counts, mirror_subsets
from gavel.sources import sinks as S


def parts(path, suffix):
    return sorted(p for p in Path(path).rglob(f"part-*{suffix}*") if not p.name.startswith("."))


def test_predictions_refuse_overwrite(spark, tmp_path):
    df = spark.range(4).select(
        F.lit("r").alias("run"), F.lit("m").alias("model"), F.concat(F.lit("d"), F.col("id") % 2).alias("dataset"), "id"
    )
    path = tmp_path / "run"
    path.mkdir()
    S.write_predictions(df, str(path))
    assert spark.read.parquet(str(path)).filter("dataset = 'd1'").count() == 2
    with pytest.raises(FileExistsError):
        S.write_predictions(df, str(path))
    S.write_predictions(df, f"{tmp_path}/lines", fmt="json")
    assert spark.read.json(f"{tmp_path}/lines").count() == 4


def test_run_metadata_and_summaries(spark, tmp_path):
    S.write_run_metadata(spark.range(1).select(F.lit("r").alias("run_id")), f"{tmp_path}/meta")
    assert spark.read.json(f"{tmp_path}/meta").first()["run_id"] == "r"
    rows = [("choice", d, 0.5) for d in "cab"] + [("noul", "z", None)]
    df = spark.createDataFrame(rows, "task string, dataset string, f1 double")
    S.write_summaries(df, f"{tmp_path}/sum")
    lines = [json.loads(x) for x in parts(f"{tmp_path}/sum/task=choice", ".json")[0].read_text().splitlines()]
    assert [x["dataset"] for x in lines] == ["a", "b", "c"]


def board(spark):
    schema = "model string, task string, dataset string, metric string, total bigint, value double, normalized double"
    scores = spark.createDataFrame(
        [("m", "noul", "n1", "f1", 4, 0.5, 0.5), ("m", "choice", "c1", "accuracy", 2, 1.0, 1.0),
         ("m", "choice", "c2", "accuracy", None, None, None)], schema
    )
    tasks = L.task_scores(scores)
    return L.leaderboard(tasks), tasks, scores


def test_leaderboard_document(spark, tmp_path):
    documents = S.leaderboard_json(*board(spark))
    S.write_leaderboard(documents, f"{tmp_path}/lb")
    doc = json.loads(parts(f"{tmp_path}/lb", ".txt")[0].read_text())
    assert doc["id"] == "m" and doc["overall_status"] == "partial" and doc["primitive_coverage"] == "2/3"
    choice = doc["primitives"]["choice"]
    assert (choice["status"], choice["completed_datasets"], choice["configured_datasets"]) == ("partial", 1, 2)
    assert [d["dataset"] for d in choice["datasets"]] == ["c1"]


def test_mirror(spark, tmp_path):
    rows = spark.createDataFrame(
        [("Noul", "a", 1), ("Noul", "a", 2), ("Choice", "b", 3), ("Score", "c", 4)],
        "primitive string, dataset_id string, n int",
    )
    S.write_mirror(rows, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 4
    S.write_mirror_subsets(rows, f"{tmp_path}/s")
    assert {n: spark.read.parquet(f"{tmp_path}/s/{n}").count() for n in mirror_subsets(rows)} == {
        "noul": 2, "choice": 1, "score": 1, "all": 4
    }
    got = {(r["subset"], r["dataset_id"]): r["rows"] for r in mirror_counts(rows).collect()}
    assert got[("all", "a")] == 2 and got[("noul", "a")] == 2 and len(got) == 6


def test_status(spark, tmp_path):
    runs = spark.createDataFrame(
        [("a", False, 1), ("b", True, 0), ("c", True, 2), ("d", True, 2)], "run string, enabled boolean, datasets int"
    )
    skipped = spark.createDataFrame([("c", "x"), ("c", "y")], "run string, dataset string")
    S.append_status(S.run_status(runs, skipped), f"{tmp_path}/st")
    S.append_status(S.run_status(runs, skipped), f"{tmp_path}/st")
    rows = {(r["run"], r["status"]) for r in spark.read.json(f"{tmp_path}/st").collect()}
    assert rows == {("a", "disabled"), ("b", "no_datasets"), ("c", "partial"), ("d", "complete")}


def test_trainer_files_and_corpus(spark, tmp_path):
    items = spark.createDataFrame(
        [("q", ["a", "b"], 1, "train"), ("r", ["a", "b"], 0, "val")],
        "question string, options array<string>, gold_index int, split string",
    )
    S.write_trainer_files(items, f"{tmp_path}/t")
    line = json.loads(parts(f"{tmp_path}/t/split=train", ".json")[0].read_text())
    assert line == {"context": "q", "options": ["a", "b"], "label": 1}
    S.write_corpus(items.withColumn("task", F.lit("x")), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/split=val/task=x").count() == 1


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "x,\ny", 1.5), ("c", None, None)], "model string, family string, value double")
    S.write_csv_export(df.orderBy("model"), f"{tmp_path}/e")
    raw = parts(f"{tmp_path}/e", ".txt")[0].read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert rows == [["model", "family", "value"], ['a "b"', "x,\ny", "1.5"], ["c", "", ""]]


def test_catalog(spark, tmp_path):
    S.write_catalog(spark.range(2), f"{tmp_path}/cat")
    with pytest.raises(Exception):
        S.write_catalog(spark.range(2), f"{tmp_path}/cat")
