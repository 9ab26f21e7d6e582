"""Readers for the benchmark, corpus, result and catalogue files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.operators.items import ROW_INDEX
from gavel.schemas import MANIFEST, PREDICTION_LINE, RUBRIC_ROW, RUN_METADATA, SCHEMA_VERSION, require
from gavel.session import checked_broadcast, materialize
from gavel.sources import arrow_stream
from gavel.sources.blocks import blocks_of, files_of, open_file, read_csv_blocks, splittable

LEGACY_ENCODING = "cp932"


class SourceError(RuntimeError):
    """A configured source cannot be read."""


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths that match a pattern, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop) or []
    return sorted(status.getPath().toString() for status in found)


def resolve_one(spark: SparkSession, pattern: str) -> str:
    """The one file behind a pattern; none or several are errors."""
    paths = glob(spark, pattern)
    if not paths:
        raise FileNotFoundError(f"dataset source not found: {pattern}")
    if len(paths) != 1:
        raise SourceError(f"dataset source must match one file: {pattern}")
    return paths[0]


def resolve_source(spark: SparkSession, candidates: Sequence[str]) -> str:
    """First candidate pattern that is staged; a staged copy beats any later source."""
    for pattern in candidates:
        if glob(spark, pattern):
            return resolve_one(spark, pattern)
    raise SourceError(f"dataset source not configured: {list(candidates)}")


def with_row_index(df: DataFrame) -> DataFrame:
    """Adds the 0-based row number in (file, offset) order of a text source.

    Row numbers inside a file block are known to its task; a small table with
    one row per block turns them into global numbers.
    """
    meta = F.col("_metadata")
    block = ["__file", "__start"]
    rows = df.select(
        "*",
        meta["file_path"].alias("__file"),
        meta["file_block_start"].alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = rows.groupBy(*block).agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *block, "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    index = (F.col("__offset") + F.col("__id") - F.col("__first")).alias(ROW_INDEX)
    return rows.join(offsets, block).select(*[F.col(f"`{c}`") for c in df.columns], index)


def read_csv(spark: SparkSession, path: str, sep: str = ",", quoted_newlines: bool = True) -> DataFrame:
    """Header row, all strings, quoted newlines, UTF-8 BOM dropped.

    Here a file with quoted newlines is one task; `read_csv_blocks` splits it.
    """
    return spark.read.csv(
        path, sep=sep, header=True, multiLine=quoted_newlines, escape='"', quote='"',
        inferSchema=False, encoding="UTF-8", mode="FAILFAST",
    )


def read_numbered_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with `row_index`: in blocks where they can be read, else each file in one task."""
    if splittable(spark, path):
        return read_csv_blocks(spark, path, sep)
    return with_row_index(read_csv(spark, path, sep))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the job."""
    reader = spark.read.option("mode", "FAILFAST").option("encoding", "UTF-8")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _numbered(rows: DataFrame, file: str, counts: DataFrame) -> DataFrame:
    """Turns row numbers inside files into numbers over all files, in the order of column `file`.

    `counts` has one row a file (file, __rows), so its window and its checked
    broadcast grow with the files, not with their rows.
    """
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(file, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    joined = rows.join(checked_broadcast(offsets), file)
    return joined.withColumn(ROW_INDEX, F.col(ROW_INDEX) + F.col("__offset")).drop(file, "__offset")


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet with the row number over all files, in path order, as `row_index`."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    file = F.col("_metadata.file_path").alias("__file")
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows"))
    rows = df.select("*", F.col("_metadata.row_index").alias(ROW_INDEX), file)
    return _numbered(rows, "__file", counts)


def read_arrow(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Arrow streams with the row number over all files, in the given (sorted) order."""
    arrow_stream.register(spark)
    found = [p for one in ([path] if isinstance(path, str) else path) for p in (glob(spark, f"{one}/*.arrow") or [one])]
    # Local paths and Hadoop's `file:/x` become `file:///x`; other schemes stay.
    local = [p.removeprefix("file://").removeprefix("file:") for p in found]
    uris = [p if "://" in p else f"file://{p}" for p in local]
    df = spark.read.format("arrow_stream").option("paths", "\n".join(uris)).load()
    if len(uris) == 1:
        return df.drop("__file")
    return _numbered(df, "__file", df.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows")))


def _decode(raw: bytes, name: str) -> str:
    for encoding in ("utf-8-sig", LEGACY_ENCODING):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise SourceError(f"cannot decode: {name}")


def read_subject_zip(
    spark: SparkSession, path: str, schema: str, folder: str = "test"
) -> DataFrame:
    """Zip of per-subject CSV files; `schema` lists the CSV columns (strings).

    Only `<folder>/*.csv` members count, in name order; `subject` is the file
    stem. The archives' directories are listed first; then every member is read once, in
    its own range of the archive, by tasks of SPREAD members and more that BLOCK bytes
    bound on the average. A task opens an archive once. `row_index` counts through all
    members of all archives in path order. A member must fit a task's memory.
    """
    names = [part.split()[0] for part in schema.split(",")]
    files = [name for name, _ in files_of(spark, path)]

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["id"]:
                with open_file(files[at]) as file, zipfile.ZipFile(file) as bundle:
                    found = sorted(
                        (m.filename, m.file_size)
                        for m in bundle.infolist()
                        if f"/{folder}/" in f"/{m.filename}"
                        and m.filename.endswith(".csv")
                        and not m.filename.rsplit("/", 1)[-1].startswith("._")
                    )
                yield pd.DataFrame(
                    {"archive": at, "member": [m for m, _ in found], "place": range(len(found)), "size": [n for _, n in found]}
                )

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, own in frame.groupby("archive", sort=False):
                with open_file(files[archive]) as file, zipfile.ZipFile(file) as bundle:
                    for at, member in zip(own["id"], own["member"]):
                        text = _decode(bundle.read(member), member)
                        rows = pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False).reindex(columns=names)
                        rows["subject"] = member.rsplit("/", 1)[-1].removesuffix(".csv")
                        rows[ROW_INDEX] = range(len(rows))
                        rows["__member"] = at
                        yield rows

    listed = blocks_of(spark, len(files)).mapInPandas(members, "archive BIGINT, member STRING, place BIGINT, size BIGINT")
    # One row a member in this window.
    listed = materialize(listed, "zip-members").selectExpr(
        "row_number() OVER (ORDER BY archive, place) - 1L AS id", "archive", "member", "size"
    )
    listed = materialize(listed, "zip-order")
    count, size = listed.agg(F.count(F.lit(1)), F.ceil(F.avg("size")).cast("long")).first()
    own = blocks_of(spark, count, size or 1).join(checked_broadcast(listed.drop("size"), 1_000_000), "id")
    rows = own.mapInPandas(unzip, f"{schema}, subject STRING, {ROW_INDEX} BIGINT, __member BIGINT")
    rows = materialize(rows, "zip-rows")
    return _numbered(rows, "__member", rows.groupBy("__member").agg(F.count(F.lit(1)).alias("__rows")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "arrow": read_arrow,
    "csv": read_numbered_csv,
    "tsv": lambda spark, path: read_numbered_csv(spark, path, "\t"),
    "jsonl": lambda spark, path: with_row_index(read_jsonl(spark, path)),
    "parquet": read_parquet,
    "jmmlu_zip": lambda spark, path: read_subject_zip(
        spark, path, "question STRING, A STRING, B STRING, C STRING, D STRING, answer STRING"
    ),
}


def read_source(spark: SparkSession, source_format: str, path: str) -> DataFrame:
    """Raw rows with `row_index`, by format name."""
    if source_format not in READERS:
        raise SourceError(f"unsupported dataset format: {source_format}")
    return READERS[source_format](spark, path)


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Tree of run directories as normalised records."""
    return records(
        spark.read.schema(PREDICTION_LINE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "predictions.jsonl")
        .json(root)
        .select("*", _run_dir(F.col("_metadata.file_path")).alias("run_dir")),
        spark.read.schema(RUN_METADATA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metadata.json")
        .json(root)
        .select("*", _run_dir(F.col("_metadata.file_path")).alias("run_dir")),
    )


def read_saved(spark: SparkSession, root: str) -> DataFrame:
    """Records of runs that `save` stored under `root`: Parquet predictions and metadata lines.

    Partition values are read as text, so that a run called `001` keeps its name.
    """
    found = spark.read.parquet(f"{root}/predictions").schema
    by = ("run", "model", "dataset")
    kept = T.StructType([T.StructField(f.name, T.StringType()) if f.name in by else f for f in found])
    stored = spark.read.schema(kept).parquet(f"{root}/predictions")
    line = T.StructType.fromDDL(PREDICTION_LINE)
    names = {"item_metadata": "metadata"}
    columns = {f.name: next((c for c in (f.name, names.get(f.name)) if c in stored.columns), None) for f in line}
    predictions = stored.select(
        *[
            (F.lit(None) if columns[f.name] is None else F.col(columns[f.name])).cast(f.dataType).alias(f.name)
            for f in line
        ],
        F.concat_ws("/", *by).alias("run_dir"),
    )
    runs = spark.read.schema(RUN_METADATA).json(f"{root}/metadata").withColumn("run_dir", F.col("run_id"))
    return records(predictions, runs)


def _run_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def records(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """Predictions joined with their run's metadata, in the record shape.

    Runs are one row per directory, broadcast up to a checked number of rows. A
    prediction whose directory has no metadata is an error.
    """
    stem = F.regexp_extract("run_dir", r"([^/]*)$", 1)
    method = F.coalesce("scorer.scorer", F.lit("unknown"))
    model = F.nullif(F.col("scorer.model"), F.lit(""))
    meta = runs.select(
        "run_dir",
        F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"),
        F.coalesce("run_id", stem).alias("run_id"),
        method.alias("method_id"),
        F.concat_ws(":", method, model).alias("system_id"),
        F.col("scorer.model").alias("model_id"),
        F.coalesce("dataset", stem).alias("dataset_id"),
        "dataset_revision",
        F.coalesce("task_type", F.lit("choice")).alias("primitive"),
    )
    known = checked_broadcast(meta.withColumn("__known", F.lit(True)))
    joined = predictions.join(known, "run_dir", "left")
    message = F.concat(F.lit("run without metadata: "), F.col("run_dir"))
    return require(joined, F.col("__known"), message).select(
        "schema_version", "run_id", "method_id", "system_id", "model_id", "dataset_id",
        "dataset_revision", F.col("id").alias("sample_id"), "primitive", "gold_index",
        "predicted_index", "scores", "probabilities", "latency_ms", "item_metadata",
        "score_metadata",
    )


def read_results(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """Result rows from JSON (list, `{"rows": []}` or one object), JSON lines or Parquet."""
    fmt = (declared or "auto").lower()
    if fmt == "auto":
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix not in ("json", "jsonl", "parquet"):
            raise SourceError(f"cannot detect result format from suffix: {path}")
        fmt = suffix
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return read_jsonl(spark, path)
    if fmt != "json":
        raise SourceError(f"unsupported result format: {fmt}")
    df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if "rows" in df.columns and df.schema["rows"].dataType.typeName() == "array":
        return df.select(F.inline("rows"))
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue document; only version 1 is supported."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return require(df, F.col("version") == 1, "unsupported manifest version")


def subset_members(manifest: DataFrame) -> DataFrame:
    """(subset, position, id) rows of a catalogue document."""
    return manifest.select(F.explode("subsets").alias("subset", "ids")).select(
        "subset", F.posexplode("ids").alias("position", "id")
    )


def read_rubric_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rubric JSON lines of several files; a bad line fails with its file, record number and start.

    `file_order` is the place of a file in the given order, `row_index` the
    0-based number of the record inside it; source order is by both.
    """
    corrupt = "_corrupt"
    parts = []
    for order, path in enumerate(paths):
        if not glob(spark, path):
            raise FileNotFoundError(f"corpus file not found: {path}")
        raw = spark.read.schema(f"{RUBRIC_ROW}, {corrupt} STRING").json(
            path, columnNameOfCorruptRecord=corrupt
        )
        parts.append(
            with_row_index(raw).withColumns(
                {"file_order": F.lit(order), "file": F.lit(path)}
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    number = (F.col(ROW_INDEX) + 1).cast("string")
    message = F.concat(F.col("file"), F.lit(":"), number, F.lit(": invalid JSON: "), F.substring(corrupt, 1, 80))
    return require(rows, F.col(corrupt).isNull(), message).drop(corrupt, "file")


def merge_parts(spark: SparkSession, parts: Sequence[str], target: str) -> int:
    """Several Parquet parts as one dataset; returns the row count seen while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df = spark.read.parquet(*parts).observe(seen, F.count(F.lit(1)).alias("rows"))
    df.write.parquet(target)
    return int(seen.get["rows"])


def read_summary(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Summary JSON documents, each in UTF-8 or else in the legacy encoding, file by file.

    Without a schema it is the one that all documents share.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [_decode(raw, name) for raw, name in zip(frame["content"], frame["path"])]
            yield pd.DataFrame({"value": texts})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    documents = raw.mapInPandas(decode, "value STRING")
    if schema is None:
        return spark.read.json(documents.rdd.map(lambda row: row.value), multiLine=True, mode="FAILFAST")
    parsed = documents.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("d.*")


# The synthetic ordinal dataset.
SYNTHETIC_LEVELS = {
    "urgency": [
        "対応期限はなく、通常処理で問題ない",
        "一週間以内に確認してほしい",
        "二日以内の対応を希望する",
        "本日中に対応しないと業務へ影響する",
        "生命・安全に直結し、直ちに対応が必要である",
    ],
    "dissatisfaction": [
        "対応に満足している",
        "小さな不便はあるが概ね満足している",
        "問題があり改善を求めている",
        "強い不満があり早急な改善を要求している",
        "極めて強い不満があり契約解除を要求している",
    ],
    "risk": [
        "危険性は認められない",
        "軽微な注意が必要である",
        "無視できない危険がある",
        "重大事故につながる高い危険がある",
        "差し迫った生命の危険がある",
    ],
    "relevance": [
        "質問と回答は無関係である",
        "回答は質問へわずかに触れている",
        "回答は質問へ部分的に答えている",
        "回答は質問へほぼ適切に答えている",
        "回答は質問へ完全かつ直接的に答えている",
    ],
}


def synthetic_ordinal(spark: SparkSession, variants: int = 40) -> DataFrame:
    """Deterministic ordinal rows: dimensions x levels x variants."""
    levels = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                F.lit(level).alias("gold_score"),
                F.lit(text).alias("text"),
            )
            for name, texts in SYNTHETIC_LEVELS.items()
            for level, text in enumerate(texts)
        ]
    )
    rows = spark.range(variants).select(F.col("id").alias("variant"), F.inline(levels))
    return rows.select(
        "dimension",
        F.format_string("%s-%d-%02d", "dimension", "gold_score", "variant").alias("id"),
        F.format_string("事例%d: %s。", F.col("variant") + 1, F.col("text")).alias("state"),
        "gold_score",
    )
