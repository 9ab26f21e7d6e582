import json
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from gavel.schemas import PREDICTION_LINE, RUN_METADATA
from gavel.sources import readers as R

CSV = '﻿id,text,n\n1,"two\nlines, ""quoted""",007\n2,日本,\n3,plain,x\n'


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    rows = R.read_source(spark, "csv", write(tmp_path / "a.csv", CSV)).orderBy("row_index").collect()
    assert [r["id"] for r in rows] == ["1", "2", "3"]
    assert rows[0]["text"] == 'two\nlines, "quoted"' and rows[0]["n"] == "007"
    assert [r["row_index"] for r in rows] == [0, 1, 2]


def test_tsv_with_odd_headers(spark, tmp_path):
    text = "Sentence\tTrain/Dev/Test\tAvg. Readers_Joy\nうれしい\ttest\t3\n悲しい\ttrain\t0\n"
    df = R.read_source(spark, "tsv", write(tmp_path / "w.tsv", text))
    from gavel.operators.items import build_items

    source = {
        "adapter": "score", "question_field": "Sentence", "gold_field": "Avg. Readers_Joy",
        "criteria": ["なし", "弱", "中", "強"], "where": {"Train/Dev/Test": "test"}, "prompt": "評価",
    }
    item = build_items(df, "wrime", source).collect()
    assert len(item) == 1 and item[0]["gold_index"] == 3
    assert item[0]["id"] == "wrime:0" and item[0]["question"] == "評価\n状態: うれしい"


def test_jsonl(spark, tmp_path):
    text = '{"id": "a", "v": [1, 2]}\n\n   \n{"id": "b", "v": []}\n'
    rows = R.read_source(spark, "jsonl", write(tmp_path / "a.jsonl", text)).orderBy("row_index").collect()
    assert [(r["id"], list(r["v"]), r["row_index"]) for r in rows] == [("a", [1, 2], 0), ("b", [], 1)]
    with pytest.raises(Exception):
        R.read_source(spark, "jsonl", write(tmp_path / "bad.jsonl", '{"id": 1}\n{oops\n')).collect()


def test_row_index_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.jsonl", "".join(f'{{"n": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_source(spark, "jsonl", path)
        assert df.rdd.getNumPartitions() > 3
        assert df.filter(F.col("n") != F.col("row_index")).count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).coalesce(1).write.parquet(path)
    assert {(r["id"], r["row_index"]) for r in R.read_source(spark, "parquet", path).collect()} == {
        (i, i) for i in range(5)
    }


def test_arrow_stream(spark, tmp_path):
    path = str(tmp_path / "a.arrow")
    table = pa.table({"q": ["x", "y", "z"], "label": [0, 1, 2], "tags": [["a"], [], ["b", "c"]]})
    with ipc.new_stream(path, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=2):
            writer.write_batch(batch)
    rows = R.read_source(spark, "arrow", R.resolve_one(spark, f"{tmp_path}/*.arrow")).collect()
    assert [(r["q"], r["label"], list(r["tags"]), r["row_index"]) for r in rows] == [
        ("x", 0, ["a"], 0), ("y", 1, [], 1), ("z", 2, ["b", "c"], 2)
    ]
    assert R.read_arrow(spark, [path, path]).count() == 6


def test_subject_zip(spark, tmp_path):
    path = tmp_path / "b.zip"
    head = "question,A,B,C,D,answer\n"
    with zipfile.ZipFile(path, "w") as bundle:
        bundle.writestr("JMMLU/test/law.csv", ("﻿" + head + '"改\n行",a,b,c,d,B\n').encode())
        bundle.writestr("JMMLU/test/art.csv", (head + "日本語,1,2,3,4,A\nNA,1,2,3,4,C\n").encode("cp932"))
        bundle.writestr("JMMLU/test/._law.csv", b"\x00\x01")
        bundle.writestr("JMMLU/dev/law.csv", head + "no,a,b,c,d,A\n")
        bundle.writestr("JMMLU/test/readme.txt", "no")
    rows = R.read_source(spark, "jmmlu_zip", str(path)).orderBy("row_index").collect()
    assert [(r["subject"], r["question"], r["answer"], r["row_index"]) for r in rows] == [
        ("art", "日本語", "A", 0), ("art", "NA", "C", 1), ("law", "改\n行", "B", 2)
    ]


def test_resolution(spark, tmp_path):
    write(tmp_path / "one" / "x.csv", "a\n1\n")
    write(tmp_path / "two" / "x.csv", "a\n1\n")
    assert R.resolve_one(spark, f"{tmp_path}/one/*.csv").endswith("one/x.csv")
    with pytest.raises(R.SourceError):
        R.resolve_one(spark, f"{tmp_path}/*/x.csv")
    with pytest.raises(FileNotFoundError):
        R.resolve_one(spark, f"{tmp_path}/none.csv")
    assert R.resolve_source(spark, [f"{tmp_path}/none.csv", f"{tmp_path}/two/x.csv"]).endswith("two/x.csv")
    with pytest.raises(R.SourceError):
        R.resolve_source(spark, [f"{tmp_path}/none.csv"])
    with pytest.raises(R.SourceError):
        R.read_source(spark, "xml", "x")


def run_dir(root, name, scorer, lines, **extra):
    meta = {"run_id": name, "dataset": "d", "task_type": "noul", "scorer": scorer, **extra}
    write(root / name / "metadata.json", json.dumps(meta, indent=2))
    write(root / name / "predictions.jsonl", "\n".join(json.dumps(x) for x in lines) + "\n\n")


def test_records(spark, tmp_path):
    line = {
        "id": "d:1", "gold_index": 1, "predicted_index": 0, "scores": [0.6, 0.4], "probabilities": None,
        "latency_ms": 2.0, "item_metadata": {"k": "v"}, "score_metadata": {"usage": {"input_tokens": 3}},
    }
    run_dir(tmp_path, "r1", {"scorer": "mock", "model": "big"}, [line, {**line, "id": "d:2"}], schema_version=1)
    run_dir(tmp_path, "r2", {"scorer": "mock"}, [line])
    rows = R.read_records(spark, str(tmp_path)).orderBy("run_id", "sample_id").collect()
    assert [(r["run_id"], r["system_id"], r["model_id"], r["sample_id"]) for r in rows] == [
        ("r1", "mock:big", "big", "d:1"), ("r1", "mock:big", "big", "d:2"), ("r2", "mock", None, "d:1")
    ]
    first = rows[2]
    assert (first["schema_version"], first["primitive"], first["probabilities"]) == (1, "noul", None)
    assert first["score_metadata"]["usage"]["input_tokens"] == 3


@pytest.mark.parametrize(
    "name,text",
    [("a.json", '[{"dataset": "x", "accuracy": 0.5}]'), ("b.json", '{"rows": [{"dataset": "x", "accuracy": 0.5}]}'),
     ("c.json", '{"dataset": "x", "accuracy": 0.5}'), ("d.jsonl", '{"dataset": "x", "accuracy": 0.5}\n\n')],
)
def test_results(spark, tmp_path, name, text):
    rows = R.read_results(spark, write(tmp_path / name, text)).collect()
    assert [(r["dataset"], r["accuracy"]) for r in rows] == [("x", 0.5)]


def test_results_format(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.range(1).write.parquet(path)
    assert R.read_results(spark, path).count() == 1
    with pytest.raises(R.SourceError):
        R.read_results(spark, "x.txt")


def manifest(version=1):
    entry = {
        "id": "a", "title": "A", "description": "d", "tasks": ["noul"],
        "source": {"kind": "hf_dataset", "repo_id": "o/a", "split": "test", "revision": "f" * 40},
        "url": "https://example.org/a", "license": "MIT", "rows": 3, "access": "open",
        "distribution": "mirror", "profile_datasets": ["a1", "a2"],
    }
    gated = {**entry, "id": "g", "access": "gated", "distribution": "router", "reason": "terms"}
    del gated["description"]
    return {
        "version": version, "repo_id": "t/r", "license": "x", "subsets": {"noul": ["a"], "all": ["a"]},
        "datasets": [entry], "excluded": [gated],
    }


def test_manifest(spark, tmp_path):
    from gavel.operators import catalog as C

    doc = R.read_manifest(spark, write(tmp_path / "m.json", json.dumps(manifest(), indent=1)))
    entries, members = C.entries(doc), R.subset_members(doc)
    assert [r["id"] for r in C.select_subset(entries, members, "noul").collect()] == ["a"]
    both = C.catalog_rows(C.select_subset(entries, members, "noul", include_gated=True)).collect()
    assert sorted((r["id"], r["description"]) for r in both) == [("a", "d"), ("g", "terms")]
    assert both[0]["viewer_url"] == "https://huggingface.co/datasets/o/a/viewer/default/test"
    assert C.violations(entries, members).count() == 0
    with pytest.raises(ValueError):
        C.select_subset(entries, members, "other")
    bad = R.read_manifest(spark, write(tmp_path / "n.json", json.dumps(manifest(2))))
    with pytest.raises(Exception, match="unsupported manifest version"):
        bad.collect()


def test_rubric_corpus(spark, tmp_path):
    from gavel.operators.corpus import load_corpus

    def row(i, kind="noul", lang="Japanese", expected="yes"):
        return {
            "id": f"r{i}", "lang": lang, "question_type": kind, "state": f" s{i} ", "instructions": "ask",
            "options": [{"label": "yes", "description": "はい条件"}, {"label": "no", "description": ""}],
            "expected": expected, "topic": "t",
        }

    one = write(tmp_path / "1.jsonl", "\n".join(json.dumps(r) for r in [row(1), row(2, lang="English"), row(3, expected="no")]))
    two = write(tmp_path / "2.jsonl", "\n" + json.dumps(row(4, kind="choice", expected="no")) + "\n")
    rows = R.read_rubric_corpus(spark, [one, two])
    items = load_corpus(rows, "noul", "corp").orderBy("id").collect()
    assert [(i["id"], i["gold_index"]) for i in items] == [("r1", 1), ("r3", 0)]
    assert items[0]["question"] == "s1\n\nask\nはい: はい条件\nいいえ: no"
    assert items[0]["metadata"]["topic"] == "t"
    choice = load_corpus(rows, "choice", "corp", None).collect()
    assert [(i["options"], i["gold_index"]) for i in choice] == [(["はい条件", "no"], 1)]
    assert load_corpus(rows, "noul", "corp", None, limit=2).count() == 2
    broken = write(tmp_path / "3.jsonl", json.dumps(row(5, expected="maybe")) + "\n")
    with pytest.raises(Exception, match="expected label"):
        load_corpus(R.read_rubric_corpus(spark, [broken]), "noul", "corp").collect()
    bad = write(tmp_path / "4.jsonl", json.dumps(row(6)) + "\n{bad\n")
    with pytest.raises(Exception, match="4.jsonl:2: invalid JSON"):
        R.read_rubric_corpus(spark, [bad]).collect()
    with pytest.raises(FileNotFoundError):
        R.read_rubric_corpus(spark, [f"{tmp_path}/none.jsonl"])


def test_merge_parts(spark, tmp_path):
    parts = [f"{tmp_path}/p{i}" for i in range(3)]
    for i, part in enumerate(parts):
        spark.range(i + 2).write.parquet(part)
    assert R.merge_parts(spark, parts, f"{tmp_path}/all") == 9
    assert spark.read.parquet(f"{tmp_path}/all").count() == 9


@pytest.mark.parametrize("encoding", ["utf-8", "cp932"])
def test_summary_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "s.json", json.dumps({"label": "日本語モデル"}, ensure_ascii=False, indent=1), encoding)
    assert R.read_summary(spark, path).first()["label"] == "日本語モデル"


def test_synthetic(spark):
    rows = R.synthetic_ordinal(spark).collect()
    assert len(rows) == 800 and len({r["id"] for r in rows}) == 800
    by_id = {r["id"]: r for r in rows}
    assert by_id["risk-2-07"]["state"] == "事例8: 無視できない危険がある。" and by_id["risk-2-07"]["gold_score"] == 2




def test_row_numbers_run_through_all_files(spark, tmp_path):
    rows = spark.range(40).select("id", F.concat(F.lit("q"), "id").alias("question"))
    rows.repartition(4).write.parquet(str(tmp_path / "p"))
    (tmp_path / "a").mkdir()
    for i in range(4):
        batch = pa.record_batch({"id": pa.array(range(10 * i, 10 * i + 10)), "question": pa.array(["q"] * 10)})
        with pa.ipc.new_stream(str(tmp_path / "a" / f"{i}.arrow"), batch.schema) as out:
            out.write(batch)
    arrow = R.read_arrow(spark, str(tmp_path / "a"))
    assert sorted((r.row_index, r.id) for r in arrow.collect()) == [(i, i) for i in range(40)]
    parquet = R.read_parquet(spark, str(tmp_path / "p"))
    assert parquet.columns == ["id", "question", "row_index"]
    assert sorted(r.row_index for r in parquet.collect()) == list(range(40))


def test_zip_row_numbers_run_through_all_archives(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as bundle:
            bundle.writestr("x/test/law.csv", "question,answer\n1,A\n2,B\n")
    got = R.read_subject_zip(spark, str(tmp_path / "*.zip"), "question STRING, answer STRING")
    assert sorted(r.row_index for r in got.collect()) == [0, 1, 2, 3] and "__file" not in got.columns


def test_corpus_limit_follows_the_files(spark, tmp_path):
    from gavel.operators.corpus import load_corpus

    row = (
        '{"id": "f%d-%d", "lang": "Japanese", "question_type": "noul", "state": "s", "instructions": "i", '
        '"options": [{"label": "yes"}, {"label": "no"}], "expected": "yes"}\n'
    )
    paths = []
    for f in range(2):
        paths.append(str(tmp_path / f"{f}.jsonl"))
        Path(paths[-1]).write_text("".join(row % (f, i) for i in range(4)))
    kept = load_corpus(R.read_rubric_corpus(spark, paths), "noul", "c", limit=5)
    assert sorted(r.id for r in kept.collect()) == ["f0-0", "f0-1", "f0-2", "f0-3", "f1-0"]


def test_summaries_decode_file_by_file(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('{"label": "日本", "x": 1}'.encode())
    (tmp_path / "b.json").write_bytes('{"label": "東京", "y": 2}'.encode("cp932"))
    for schema in (None, "label STRING, x BIGINT, y BIGINT"):
        got = R.read_summary(spark, str(tmp_path), schema)
        assert {(r.label, r.x, r.y) for r in got.collect()} == {("日本", 1, None), ("東京", None, 2)}


def test_runs_without_metadata_and_unknown_members_fail(spark, tmp_path):
    runs = spark.createDataFrame([], "run_dir STRING, " + RUN_METADATA)
    line = spark.createDataFrame([], PREDICTION_LINE).select("*", F.lit("d/run").alias("run_dir"))
    one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in line.schema[:-1]], F.lit("d/run").alias("run_dir"))
    with pytest.raises(Exception, match="run without metadata: d/run"):
        R.records(one, runs).collect()
