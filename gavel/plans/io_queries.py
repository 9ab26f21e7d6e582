"""Queries that write tables in a supported format and read them back."""

from __future__ import annotations

import itertools
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.operators.leaderboard import leaderboard, task_scores
from gavel.operators.leaderboard import dataset_scores as configured_scores
from gavel.operators.mirror import mirror_rows
from gavel.plans import views as V
from gavel.plans.corpus_queries import _MIRROR, _mirror_catalog
from gavel.plans.registry import query
from gavel.plans.sql_views import r9, sql
from gavel.session import scratch_dir
from gavel.sources import sinks as K
from gavel.operators.corpus import load_corpus
from gavel.operators.scoring import mock_scores
from gavel.plans.evaluation import evaluate, save
from gavel.sources.blocks import open_output, read_csv_blocks
from gavel.sources.readers import read_rubric_corpus, read_saved, read_source, read_subject_zip

_FORMATS = ("csv", "tsv", "jsonl", "parquet")
_PRINT = "CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT)"


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS format, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, "
        f"CAST(sum({_PRINT}) AS BIGINT) AS print, "
        "CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS row_numbers FROM documents"
        for f in _FORMATS
    )
)
def source_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written and read in every text format: quotes, newlines, row numbers."""
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    root = scratch_dir(spark, "sources")
    writers = {
        "csv": lambda df, path: df.write.csv(path, header=True, escape='"', quoteAll=True),
        "tsv": lambda df, path: df.write.csv(path, header=True, escape='"', quoteAll=True, sep="\t"),
        "jsonl": lambda df, path: df.write.json(path),
        "parquet": lambda df, path: df.repartition(7, "doc_id").write.parquet(path),
    }
    parts = []
    for name, write in writers.items():
        write(documents, f"{root}/{name}")
        rows = read_source(spark, name, f"{root}/{name}")
        mark = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("bigint")
        parts.append(
            rows.agg(
                F.lit(name).alias("format"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("doc_id").cast("bigint")).alias("ids"),
                F.sum(mark).alias("print"),
                F.sum("row_index").alias("row_numbers"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    sql(
        "SELECT lower(primitive) AS subset, source_license, count(*) AS rows, "
        "count(DISTINCT dataset_id) AS datasets FROM mirrored GROUP BY ALL "
        "UNION ALL SELECT 'all', source_license, count(*), count(DISTINCT dataset_id) FROM mirrored GROUP BY ALL",
        **_MIRROR,
    )
)
def mirror_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirror subsets written as Parquet and read back, `all` among them."""
    root = scratch_dir(spark, "mirror")
    K.write_mirror_subsets(
        mirror_rows(V.all_items(spark, sf_dir), _mirror_catalog(spark, sf_dir)), root
    )
    parts = [
        spark.read.parquet(f"{root}/{subset}").groupBy(F.lit(subset).alias("subset"), "source_license").agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("dataset_id").alias("datasets")
        )
        for subset in ("noul", "choice", "score", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    sql(
        f"SELECT dataset, model, count(*) AS n, {r9('accuracy', 'avg((predicted_index = gold_index)::INT)')} "
        "FROM preds WHERE task = 'choice' GROUP BY ALL"
    )
)
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions stored by run, model and dataset, read back with partition pruning."""
    root = scratch_dir(spark, "predictions")
    predictions = V.preds(spark, sf_dir).withColumn("run", F.col("task"))
    K.write_predictions(predictions, root)
    stored = spark.read.parquet(root).filter(F.col("run") == "choice")
    hit = (F.col("predicted_index") == F.col("gold_index")).cast("int")
    out = stored.groupBy("dataset", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")
    )
    return V.rounded(out, "accuracy")


@query(
    sql(
        f"""
SELECT b.model, b.coverage, b.overall_status, {r9("overall")},
  coalesce(c.datasets, 0) AS choice_datasets, {r9("choice_score", "b.choice")}
FROM (SELECT model, noul, choice, score, overall_status, coverage,
        (coalesce(noul, 0) + coalesce(choice, 0) + coalesce(score, 0)) / available AS overall
      FROM (SELECT w.*, CASE WHEN all_complete = 1 THEN 'complete' ELSE 'partial' END AS overall_status,
              available || '/3' AS coverage FROM wide w WHERE available > 0)) b
LEFT JOIN (SELECT model, count(value) AS datasets FROM scores WHERE task = 'choice' GROUP BY model) c USING (model)"""
    )
)
def leaderboard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested leaderboard documents written as JSON lines and read back."""
    scores = configured_scores(V.configured(spark, sf_dir), V.quick_metrics(spark, sf_dir))
    tasks = task_scores(scores)
    root = scratch_dir(spark, "leaderboard")
    K.write_leaderboard(K.leaderboard_json(leaderboard(tasks, order=False), tasks, scores), root)
    schema = (
        "id STRING, overall_score DOUBLE, overall_status STRING, primitive_coverage STRING, "
        "primitives MAP<STRING, STRUCT<score: DOUBLE, datasets: ARRAY<STRUCT<dataset: STRING>>>>"
    )
    choice = F.col("primitives")["choice"]
    out = spark.read.schema(schema).json(root).select(
        F.col("id").alias("model"),
        F.col("primitive_coverage").alias("coverage"),
        "overall_status",
        F.col("overall_score").alias("overall"),
        F.coalesce(F.size(choice["datasets"]).cast("bigint"), F.lit(0)).alias("choice_datasets"),
        choice["score"].alias("choice_score"),
    )
    out = out.withColumn("choice_datasets", F.greatest("choice_datasets", F.lit(0)))
    return V.rounded(out, "overall", "choice_score")


@query(
    "SELECT count(*) AS n, count(*) AS numbers, count(*) - 1 AS last, least(100, count(*)) AS first_rows FROM documents"
)
def multi_file_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in many Parquet files: every row has a number of its own, and a limit takes the first."""
    root = scratch_dir(spark, "files")
    V.table(spark, sf_dir, "documents").repartition(9, "doc_id").write.parquet(root)
    rows = read_source(spark, "parquet", root)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("row_index").alias("numbers"),
        F.max("row_index").alias("last"),
        F.count_if(F.col("row_index") < 100).alias("first_rows"),
    )


_CORPUS = "SELECT conv_id, turn, text, turn % 2 AS part FROM conversations"


@query(
    f"""
WITH c AS ({_CORPUS}),
o AS (SELECT *, row_number() OVER (ORDER BY part, conv_id, turn) AS place, count(*) FILTER (part = 0) OVER () AS first FROM c)
SELECT conv_id || '-' || turn AS id FROM o WHERE place <= first + 5"""
)
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus in two sources: a limit takes all rows of the first and five of the second, in their order."""
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2).alias("part"))
    option = lambda label: F.struct(F.lit(label).alias("label"), F.lit("").alias("description"))
    root, paths = scratch_dir(spark, "corpus"), []
    for part in (0, 1):
        paths.append(f"{root}/{part}")
        turns.filter(F.col("part") == part).orderBy("conv_id", "turn").select(
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.lit("Japanese").alias("lang"),
            F.lit("noul").alias("question_type"),
            F.lit("state").alias("state"),
            F.lit("instructions").alias("instructions"),
            F.array(option("yes"), option("no")).alias("options"),
            F.lit("yes").alias("expected"),
        ).write.json(paths[-1])
    first = turns.filter("part = 0").count()
    items = load_corpus(read_rubric_corpus(spark, paths), "noul", "corpus", limit=first + 5)
    return items.select(F.regexp_replace("id", "^corpus:", "").alias("id"))


@query(
    f"SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum({_PRINT}) AS BIGINT) AS print, "
    "CAST(sum((n_chars + 1) * doc_id) AS BIGINT) AS weighed, "
    "CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS row_numbers, 0::BIGINT AS out_of_order, count(*) > 150 AS many_tasks FROM documents"
)
def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV files sorted by id, every row repeated as a quoted field of many lines, read in small blocks.

    All rows come back whole, numbered in file order, and not by one task a file.
    """
    root = scratch_dir(spark, "blocks")
    documents = V.table(spark, sf_dir, "documents").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    lines = F.concat_ws("\n", F.lit('"quoted", line'), "text", F.lit(""))
    documents.select("doc_id", "text", lines.alias("lines"), (F.col("n_chars") + 1).alias("size")).write.csv(
        root, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    rows = read_csv_blocks(spark, root, block=1 << 16)
    number = F.col("doc_id").cast("bigint")
    whole = F.col("lines") == lines
    mark = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("bigint")
    before = F.lag("doc_id").over(Window.partitionBy("part").orderBy("row_index"))
    numbered = rows.select(
        number.alias("doc_id"), "row_index", F.floor(F.col("row_index") / 64).alias("part"), mark.alias("mark"), whole.alias("whole"),
        F.col("size").cast("bigint").alias("size"), F.spark_partition_id().alias("task"),
    ).withColumn("before", before)
    return numbered.filter("whole").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum("mark").alias("print"),
        F.sum(F.col("size") * F.col("doc_id")).alias("weighed"), F.sum("row_index").alias("row_numbers"),
        F.count_if(F.col("before") >= F.col("doc_id")).alias("out_of_order"), (F.count_distinct("task") > 4).alias("many_tasks"),
    )


ARCHIVE_ROWS = 10_000  # documents of an archive, on the average


def _write_archives(rows: DataFrame, root: str, archives: int) -> None:
    """(subject, doc_id, text) as zip archives of one CSV member a subject, each archive by one task, member by member."""

    def write(frames):
        parts = ((key, part) for frame in frames for key, part in frame.groupby(["archive", "subject"]))
        for archive, own in itertools.groupby(parts, key=lambda part: part[0][0]):
            with open_output(f"{root}/{archive}.zip") as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
                for (_, subject), same in itertools.groupby(own, key=lambda part: part[0]):
                    member = pd.concat([part for _, part in same])
                    bundle.writestr(f"data/test/{subject}.csv", member[["doc_id", "text"]].to_csv(index=False))
            yield pd.DataFrame({"archive": [archive]})

    dealt = rows.withColumn("archive", F.pmod(F.xxhash64("subject"), F.lit(archives))).repartition(archives, "archive")
    ordered = dealt.sortWithinPartitions("archive", "subject")
    ordered.mapInPandas(write, "archive LONG").write.format("noop").mode("overwrite").save()


@query(
    f"""
SELECT subject, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum({_PRINT}) AS BIGINT) AS print,
  CAST(sum(count(*)) OVER () * (sum(count(*)) OVER () - 1) / 2 AS BIGINT) AS row_numbers
FROM (SELECT doc_id, text, coalesce(source, 'none') || '-' || (doc_id // 100) AS subject FROM documents) GROUP BY subject"""
)
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in zip archives of many members, every member read once, by tasks of many members."""
    root = scratch_dir(spark, "archives")
    documents = V.table(spark, sf_dir, "documents")
    archives = max(8, documents.count() // ARCHIVE_ROWS)
    subject = F.concat_ws("-", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100))
    _write_archives(documents.select(subject.alias("subject"), "doc_id", "text"), root, archives)
    rows = read_subject_zip(spark, root, "doc_id STRING, text STRING")
    mark = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("bigint")
    found = rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("bigint")).alias("ids"), F.sum(mark).alias("print"),
        F.sum("row_index").alias("own"),
    )
    # One row a subject in this window.
    return found.withColumn("row_numbers", F.sum("own").over(Window.partitionBy())).drop("own")


_SAVED = """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents WHERE lang <> 'es' OR lang IS NULL),
runs AS (SELECT * FROM (VALUES ('001/m0/long_docs', 'mock:m0'), ('001/m1/long_docs', 'unknown:m1')) AS t(run_id, system_id))
SELECT run_id, system_id, 'long_docs' AS dataset_id, 'noul' AS primitive, 'r7' AS dataset_revision, count(*) AS records,
  count(DISTINCT id) AS ids, count(*) FILTER (WHERE n_chars >= 1000) AS positives, count(*) AS scored,
  'partial' AS status, 2 * count(*) AS predictions, 'absent: source_not_found' AS skipped, 'off' AS disabled
FROM d, runs GROUP BY run_id, system_id"""


@query(_SAVED)
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents is saved, then read back as records with its ledger row."""
    config = {
        "version": 1,
        "runtime": {"datasets_root": sf_dir},
        "models": [{"id": "m0", "scorer": "mock"}, {"id": "m1"}, {"id": "off", "enabled": False}],
        "datasets": [
            {
                "id": "long_docs",
                "task": "noul",
                "source": {
                    "path": "documents.parquet", "format": "parquet", "adapter": "noul", "revision": "r7",
                    "gold_field": "n_chars", "positive_min": 1000, "item_id_field": "doc_id",
                    "question_template": "{text}", "where_not": {"lang": "es"},
                },
            },
            {"id": "absent", "source": {"path": "absent.parquet", "format": "parquet"}},
        ],
        "tasks": {"noul": {"datasets": ["long_docs"]}, "choice": {"datasets": ["absent"]}},
    }
    usage = "struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>"

    def scorer(model: str):
        return lambda items: mock_scores(items, F.lit(model)).withColumns(
            {"latency_ms": F.lit(1.0), "score_metadata": F.lit(None).cast(usage)}
        )

    root = scratch_dir(spark, "saved")
    save(evaluate(spark, config, {m: scorer(m) for m in ("m0", "m1")}), root, "001")
    totals = read_saved(spark, root).groupBy("run_id", "system_id", "dataset_id", "primitive", "dataset_revision").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("sample_id").alias("ids"),
        F.count_if(F.col("gold_index") == 1).alias("positives"), F.count_if(F.size("scores") == 2).alias("scored"),
    )
    ledger = spark.read.json(f"{root}/status").filter(F.col("elapsed_seconds") > 0).select(
        F.col("run").alias("__run"), "status", "predictions",
        F.concat_ws(", ", F.transform("reasons", lambda r: F.concat_ws(": ", r["dataset"], r["reason"]))).alias("skipped"),
        F.concat_ws(", ", "disabled_models").alias("disabled"),
    )
    return totals.join(ledger, F.substring_index("run_id", "/", 1) == F.col("__run")).drop("__run")
