"""Queries over catalogues, mirrors, corpora and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import catalog as C
from gavel.operators import corpus as K
from gavel.operators import leaderboard as L
from gavel.operators import mirror as R
from gavel.operators import ranking as O
from gavel.plans import views as V
from gavel.plans.registry import query
from gavel.plans.sql_views import NL, r9, sql, strip
from gavel.sources.readers import records as join_records

# A catalogue of one entry per part: invented provenance from the part's columns.
_KINDS = ("hf_dataset", "hf_snapshot", "own", "git", "hf_parquet")
_LICENCES = ("MIT", "CC BY 4.0", "CC BY-NC-ND 4.0", "Apache-2.0")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries derived from `part`."""
    part = V.table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    gated = key % 10 == 0
    tasks = F.filter(
        F.array(
            F.when(key % 2 == 0, "noul"), F.when(key % 3 != 1, "choice"), F.when(key % 5 == 1, "score")
        ),
        lambda t: t.isNotNull(),
    )
    kind = _pick(_KINDS, size)
    hosted = kind.isin("hf_dataset", "hf_snapshot", "hf_parquet")
    source = F.struct(
        kind.alias("kind"),
        F.when(hosted, F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("repo_id"),
        F.when(kind == "git", F.concat(F.lit("https://git.example.org/"), key, F.lit(".git"))).alias("url"),
        F.when(kind == "own", F.concat(F.lit("own/"), key)).alias("path"),
        F.when(key % 4 == 0, F.col("p_type")).alias("config"),
        F.when(key % 7 != 0, "test").alias("split"),
        F.when(key % 11 != 0, F.substring(F.sha2("p_name", 256), 1, 40)).alias("revision"),
        F.struct(F.when(key % 13 == 0, F.concat(F.lit("origin/"), key)).alias("repo_id")).alias("derived_from"),
    )
    return part.select(
        F.lit("team/bench").alias("manifest_repo"),
        gated.alias("gated"),
        key.alias("position"),
        F.concat(F.lit("ds"), key).alias("id"),
        F.col("p_name").alias("title"),
        F.when(~gated, F.concat(F.lit("about "), "p_name")).alias("description"),
        F.when(gated, "terms must be accepted").alias("reason"),
        tasks.alias("tasks"),
        source.alias("source"),
        F.when(key % 17 != 0, F.concat(F.lit("https://example.org/"), key)).alias("url"),
        _pick(_LICENCES, key).alias("license"),
        (size * 100).cast("bigint").alias("rows"),
        F.when(gated | (key % 19 == 0), "gated").otherwise("open").alias("access"),
        F.when(key % 4 == 2, "router").when(key % 9 != 8, "mirror").alias("distribution"),
        F.array(F.concat(F.lit("ds"), key)).alias("profile_datasets"),
    )


def member_table(catalog: DataFrame) -> DataFrame:
    """Subset membership: the entries' tasks and `all`, with some ids left out or unknown."""
    open_ = catalog.filter(~F.col("gated") & (F.col("position") % 23 != 0))
    subset = F.explode(F.concat(F.col("tasks"), F.array(F.lit("all")))).alias("subset")
    listed = open_.select(subset, "position", "id")
    strange = catalog.filter(F.col("position") % 29 == 0).select(
        F.lit("choice").alias("subset"), "position", F.concat("id", F.lit("-old")).alias("id")
    )
    return listed.unionByName(strange)


_CATALOG = {
    "cat": f"""
SELECT *, CASE WHEN kind IN ('hf_dataset', 'hf_snapshot', 'hf_parquet') THEN p_brand || '/' || replace(p_name, ' ', '-') END AS repo_id,
  CASE WHEN kind = 'git' THEN 'https://git.example.org/' || p_partkey || '.git' END AS git_url,
  CASE WHEN kind = 'own' THEN 'own/' || p_partkey END AS path
FROM (SELECT p.*, p_partkey % 10 = 0 AS gated, 'ds' || p_partkey AS id,
  list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'noul' END, CASE WHEN p_partkey % 3 <> 1 THEN 'choice' END,
               CASE WHEN p_partkey % 5 = 1 THEN 'score' END], lambda t: t IS NOT NULL) AS tasks,
  ({list(_KINDS)})[p_size % 5 + 1] AS kind,
  CASE WHEN p_partkey % 4 = 0 THEN p_type END AS config,
  CASE WHEN p_partkey % 7 <> 0 THEN 'test' END AS split,
  CASE WHEN p_partkey % 11 <> 0 THEN substr(sha256(p_name), 1, 40) END AS revision,
  CASE WHEN p_partkey % 13 = 0 THEN 'origin/' || p_partkey END AS origin,
  CASE WHEN p_partkey % 17 <> 0 THEN 'https://example.org/' || p_partkey END AS url,
  ({list(_LICENCES)})[CAST(p_partkey % 4 AS INT) + 1] AS license,
  CASE WHEN p_partkey % 10 = 0 OR p_partkey % 19 = 0 THEN 'gated' ELSE 'open' END AS access,
  CASE WHEN p_partkey % 4 = 2 THEN 'router' WHEN p_partkey % 9 <> 8 THEN 'mirror' END AS distribution
  FROM part p)""",
    "mem": """
SELECT unnest(list_append(tasks, 'all')) AS subset, p_partkey AS position, id FROM cat
WHERE NOT gated AND p_partkey % 23 <> 0
UNION ALL SELECT 'choice', p_partkey, id || '-old' FROM cat WHERE p_partkey % 29 = 0""",
    "cat_rows": f"""
SELECT id, gated, p_partkey AS position, p_name AS title, coalesce(distribution, 'router') AS distribution,
  array_to_string(tasks, ',') AS tasks, p_size * 100 AS rows, license, kind AS source_kind,
  coalesce(repo_id, git_url, 'team/bench') AS source_repo, config AS source_config,
  split AS source_split, revision,
  CASE WHEN kind IN ('hf_dataset', 'hf_parquet') AND split IS NOT NULL
         THEN '{C.HUB}' || repo_id || '/viewer/' || coalesce(config, 'default') || '/' || split
       WHEN kind = 'hf_snapshot' THEN '{C.HUB}' || repo_id || '/tree/' || coalesce(revision, 'main')
       WHEN kind = 'own' THEN '{C.HUB}team/bench/tree/main/' || path
       ELSE regexp_replace(git_url, '\\.git$', '') || '/tree/' || revision END AS viewer_url,
  CASE WHEN gated THEN 'terms must be accepted' ELSE 'about ' || p_name END AS description,
  distribution AS raw_distribution
FROM cat""",
}
_ROW = (
    "id, title, distribution, tasks, rows::BIGINT AS rows, license, source_kind, source_repo, "
    "source_config, source_split, revision, viewer_url, description"
)


@query(
    sql(
        f"""
SELECT 'noul+gated' AS subset, {_ROW} FROM cat_rows WHERE id IN (SELECT id FROM mem WHERE subset = 'noul')
  OR (gated AND list_contains(string_split(tasks, ','), 'noul'))
UNION ALL
SELECT 'all', {_ROW} FROM cat_rows WHERE id IN (SELECT id FROM mem WHERE subset = 'all')
UNION ALL
SELECT 'router', {_ROW} FROM cat_rows WHERE gated OR raw_distribution = 'router'""",
        **_CATALOG,
    )
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset and router listings with provenance and viewer addresses."""
    catalog = catalog_table(spark, sf_dir)
    members = member_table(catalog)
    chosen = {
        "noul+gated": C.select_subset(catalog, members, "noul", include_gated=True),
        "all": C.select_subset(catalog, members, "all"),
        "router": C.router_entries(catalog),
    }
    parts = [C.catalog_rows(df).select(F.lit(n).alias("subset"), "*") for n, df in chosen.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    sql(
        """
SELECT 'unknown_subset_id' AS rule, id FROM mem WHERE id NOT IN (SELECT id FROM cat WHERE NOT gated)
UNION ALL SELECT 'task_not_in_subset', id FROM (SELECT id, unnest(tasks) AS subset FROM cat WHERE NOT gated) t
  WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.id = t.id AND m.subset = t.subset)
UNION ALL SELECT 'missing_from_all', id FROM cat WHERE NOT gated
  AND id NOT IN (SELECT id FROM mem WHERE subset = 'all')
UNION ALL SELECT 'revision_not_pinned', id FROM cat WHERE NOT gated AND kind <> 'own' AND revision IS NULL
UNION ALL SELECT 'origin_not_documented', id FROM cat WHERE url IS NULL
UNION ALL SELECT 'licence_not_mirrorable', id FROM cat WHERE distribution = 'mirror' AND license = 'CC BY-NC-ND 4.0'
UNION ALL SELECT 'gated_by_default', id FROM cat WHERE NOT gated AND access <> 'open'""",
        **_CATALOG,
    )
)
def catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken catalogue rules, one row per rule and entry."""
    catalog = catalog_table(spark, sf_dir)
    return C.violations(catalog, member_table(catalog))


# Model ids derived from the part table.
_STEMS = (
    "Qwen3-{n}B-Instruct", "Qwen3.5-{n}B", "qwen3-swallow-{n}b-rl", "gemma-4-E{n}B-it-qat",
    "sarashina2.2-{n}b-sft", "llm-jp-4-{n}b-thinking", "Qwen2.5-{n}.5B-base", "other-model-cpt",
)


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    model = F.replace(
        _pick(_STEMS, F.col("p_partkey")), F.lit("{n}"), F.col("p_size").cast("string")
    )
    named = part.select("p_partkey", model.alias("model"), F.col("p_retailprice").alias("price"))
    return named.withColumns(C.model_spec(F.col("model")))


_SPEC_VIEWS = {
    "ids": f"""
SELECT p_partkey, p_retailprice AS price, CAST(p_partkey % 8 AS INT) AS k,
  replace(({list(_STEMS)})[CAST(p_partkey % 8 AS INT) + 1], '{{n}}', CAST(p_size AS VARCHAR)) AS model, p_size
FROM part""",
    "specs": """
SELECT p_partkey, model, price,
  ['Qwen3', 'Qwen3.5', 'Qwen3-Swallow', 'Gemma 4', 'Sarashina2.2', 'LLM-jp 4', 'Qwen2.5', 'Other'][k + 1] AS family,
  CASE WHEN k = 7 THEN NULL WHEN k = 6 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS size,
  ['Instruct', 'Instruct + Thinking', 'RL', 'Instruct · QAT', 'SFT', 'Thinking', 'Base', 'CPT'][k + 1] AS variant,
  ['Instruct', 'Instruct,Thinking', 'other', 'Instruct', 'other', 'Thinking', 'Base', 'other'][k + 1] AS tags
FROM ids""",
}


@query(sql("SELECT p_partkey, model, family, size, variant, tags FROM specs", **_SPEC_VIEWS))
def model_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, size, variant and tags read from model ids, in catalogue order."""
    specs = model_table(spark, sf_dir).withColumn("label", F.col("model"))
    return L.catalog_order(specs).select(
        "p_partkey", "model", "family", "size", "variant", F.array_join("tags", ",").alias("tags")
    )


@query(
    sql(
        """
SELECT p_partkey, model, price FROM specs
WHERE (size IS NULL OR size BETWEEN 4 AND 20)
  AND (tags LIKE '%Thinking%' OR tags LIKE '%other%')""",
        **_SPEC_VIEWS,
    )
)
def ranking_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking filter by size range, unsized models and variant tags, best value first."""
    from gavel.operators.filters import ranking_filter

    rows = ranking_filter(model_table(spark, sf_dir), "price", ["Thinking", "other"], 4, 20, True)
    return L.ranking_order(rows, "price").select("p_partkey", "model", "price")


def _mirror_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue whose profile datasets are the datasets of the item table."""
    datasets = V.configured(spark, sf_dir).filter(F.col("model") == "m0").select("dataset", "task")
    closed = F.col("dataset") == "value_view"
    none = F.lit(None).cast("string")
    return datasets.select(
        F.lit("team/bench").alias("manifest_repo"),
        F.lit(False).alias("gated"),
        F.upper("dataset").alias("title"),
        F.concat(F.lit("https://example.org/"), "dataset").alias("url"),
        F.lit("MIT").alias("license"),
        F.when(closed, "router").otherwise("mirror").alias("distribution"),
        F.struct(
            F.when(F.col("task") == "noul", F.concat(F.lit("hub/"), "dataset")).alias("repo_id"),
            none.alias("url"),
            F.when(F.col("task") == "score", "train").alias("split"),
            F.struct(F.when(F.col("dataset") == "quality", "origin/q").alias("repo_id")).alias("derived_from"),
        ).alias("source"),
        F.array("dataset").alias("profile_datasets"),
    )


_MIRROR = {
    "mirrored": """
SELECT CASE WHEN starts_with(id, dataset) THEN id ELSE dataset || ':' || id END AS id,
  CASE task WHEN 'noul' THEN 'Noul' WHEN 'choice' THEN 'Choice' ELSE 'Score' END AS primitive,
  dataset AS dataset_id, upper(dataset) AS source_dataset,
  CASE WHEN dataset = 'quality' THEN 'origin/q' WHEN task = 'noul' THEN 'hub/' || dataset ELSE 'team/bench' END AS source_repo,
  'https://example.org/' || dataset AS source_url,
  CASE WHEN task = 'score' THEN 'train' ELSE '(none)' END AS source_split, 'MIT' AS source_license,
  question, options, gold_index FROM items WHERE dataset <> 'value_view'""",
}


@query(
    sql(
        "SELECT id, primitive, dataset_id, source_dataset, source_repo, source_url, source_split, "
        "source_license, sha256(question) AS question_hash, array_to_string(options, '|') AS options, "
        "CAST(gold_index AS INT) AS gold_index FROM mirrored",
        **_MIRROR,
    )
)
def mirror_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of mirrored datasets in the publishable shape with provenance."""
    rows = R.mirror_rows(V.all_items(spark, sf_dir), _mirror_catalog(spark, sf_dir))
    return rows.select(
        "id", "primitive", "dataset_id", "source_dataset", "source_repo", "source_url", "source_split",
        "source_license", F.sha2("question", 256).alias("question_hash"),
        F.array_join("options", "|").alias("options"), "gold_index",
    )


@query(
    sql(
        "SELECT lower(primitive) AS subset, dataset_id, count(*) AS rows FROM mirrored GROUP BY ALL "
        "UNION ALL SELECT 'all', dataset_id, count(*) FROM mirrored GROUP BY ALL",
        **_MIRROR,
    )
)
def mirror_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per (subset, dataset), `all` included."""
    rows = R.mirror_rows(V.all_items(spark, sf_dir), _mirror_catalog(spark, sf_dir))
    return R.mirror_counts(rows)


@query(
    """
SELECT p_brand AS dataset, CASE WHEN max(p_size) >= 45 THEN 'override' ELSE 'base' END AS origin,
  count(*) FILTER (WHERE CASE WHEN big THEN p_size >= 45 ELSE true END) AS n
FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) >= 45 AS big FROM part) GROUP BY p_brand"""
)
def override_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset specifications where a later source replaces an earlier one."""
    part = V.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "dataset")
    base = part.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("base"))
    late = (
        part.filter(F.col("p_size") >= 45).groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("override"))
    )
    return R.override_specs(base, late).select("dataset", "origin", "n")


@query(
    sql(
        f"""
SELECT 1 AS schema_version, 'run-' || model AS run_id, 'mock' AS method_id,
  CASE WHEN model = 'm0' THEN 'mock' ELSE 'mock:' || model END AS system_id,
  CASE WHEN model = 'm0' THEN NULL ELSE model END AS model_id, dataset AS dataset_id,
  id AS sample_id, task AS primitive, CAST(gold_index AS INT) AS gold_index,
  CAST(predicted_index AS INT) AS predicted_index, {r9("latency_ms")},
  {r9("top_probability", "list_max(probabilities)")}
FROM preds WHERE task = 'score'"""
    )
)
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with their run's metadata in the common record shape."""
    predictions = V.predict(V.items_score(spark, sf_dir)).select(
        "*",
        F.concat_ws("/", F.lit("results"), "model", "dataset").alias("run_dir"),
        F.lit(None).cast("map<string,string>").alias("item_metadata"),
    )
    pairs = V.configured(spark, sf_dir).filter(F.col("task") == "score")
    runs = pairs.select(
        F.concat_ws("/", F.lit("results"), "model", "dataset").alias("run_dir"),
        F.lit(None).cast("int").alias("schema_version"),
        F.concat(F.lit("run-"), "model").alias("run_id"),
        "dataset",
        F.col("task").alias("task_type"),
        F.lit(None).cast("string").alias("dataset_revision"),
        F.struct(
            F.lit("mock").alias("scorer"), F.when(F.col("model") != "m0", F.col("model")).alias("model")
        ).alias("scorer"),
    )
    out = join_records(predictions.drop("model", "dataset", "task"), runs).select(
        "schema_version", "run_id", "method_id", "system_id", "model_id", "dataset_id", "sample_id",
        "primitive", "gold_index", "predicted_index", "latency_ms",
        F.array_max("probabilities").alias("top_probability"),
    )
    return V.rounded(out, "latency_ms", "top_probability")


def rubric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric rows from conversations: every user turn is a state to decide on."""
    turns = V.table(spark, sf_dir, "conversations").filter(F.col("role") == "user")

    def option(label: str, description: str | None) -> Column:
        return F.struct(
            F.lit(label).alias("label"), F.lit(description).cast("string").alias("description")
        )

    return turns.select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"),
        F.when(F.col("conv_id") % 2 == 0, "Japanese").otherwise("English").alias("lang"),
        F.when(F.col("conv_id") % 3 == 0, "choice").otherwise("noul").alias("question_type"),
        F.when(F.col("turn") % 7 != 3, F.col("text")).alias("state"),
        F.lit(" Is it the first turn? ").alias("instructions"),
        F.array(option("yes", "it is first"), option("no", "")).alias("options"),
        F.when(F.col("turn") == 0, "yes").otherwise("no").alias("expected"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"),
    )


_RUBRIC = f"""
SELECT 'c-' || conv_id || '-' || turn AS id, conv_id % 3 = 0 AS is_choice, conv_id % 2 = 0 AS ja,
  turn = 0 AS first_turn, CASE WHEN turn % 7 <> 3 THEN {strip("text")} ELSE '' END AS st
FROM conversations WHERE role = 'user'"""


@query(
    sql(
        f"""
SELECT id, task, sha256(lead || CASE WHEN task = 'noul' THEN {NL} || 'はい: it is first' || {NL} || 'いいえ: no'
                                ELSE '' END) AS question_hash,
  CASE WHEN task = 'noul' THEN 'いいえ|はい' ELSE 'it is first|no' END AS options,
  CAST(CASE WHEN task = 'noul' THEN first_turn ELSE NOT first_turn END AS INT) AS gold_index
FROM (SELECT *, CASE WHEN is_choice THEN 'choice' ELSE 'noul' END AS task,
        CASE WHEN st = '' THEN '' ELSE st || {NL} || {NL} END || 'Is it the first turn?' AS lead
      FROM rubric)
WHERE task = 'choice' OR ja""",
        rubric=_RUBRIC,
    )
)
def rubric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric corpus rows of two question types and languages as items."""
    rows = rubric_rows(spark, sf_dir)
    yes_no = K.load_corpus(rows, "noul", "rubric", "Japanese")
    choice = K.load_corpus(rows, "choice", "rubric", None)
    return yes_no.unionByName(choice).select(
        "id", "task", F.sha2("question", 256).alias("question_hash"),
        F.array_join("options", "|").alias("options"), "gold_index",
    )


_CRITERIA = "[p_name, p_brand, p_type]"


@query(
    f"""
SELECT 'p' || p_partkey AS id, 'solver_' || CASE WHEN p_partkey % 2 = 0 THEN 'choice' ELSE 'bool' END AS task,
  sha256(p_name) AS context_hash,
  CASE WHEN p_partkey % 2 = 0 THEN array_to_string({_CRITERIA}, '|') ELSE 'no|yes' END AS options,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 ELSE (p_size > 25)::INT END AS INT) AS gold_index
FROM part
UNION ALL
SELECT 'd' || doc_id, 'document_choice', sha256('doc ' || doc_id || {NL} || {NL} || text),
  lang || '|' || source || '|none', CAST(doc_id % 3 AS INT)
FROM documents"""
)
def criteria_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solver-verified and document-grounded rows as training examples, criteria in index order."""

    def criterion(id_: str, index: int, label: Column) -> Column:
        return F.struct(F.lit(id_).alias("id"), F.lit(index).alias("index"), label.alias("label"))

    part = V.table(spark, sf_dir, "part")
    even = F.col("p_partkey") % 2 == 0
    three = F.array(
        criterion("c2", 2, F.col("p_type")), criterion("c0", 0, F.col("p_name")),
        criterion("c1", 1, F.col("p_brand")),
    )
    two = F.array(criterion("true", 1, F.lit("yes")), criterion("false", 0, F.lit("no")))
    solved = part.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"),
        F.when(even, "choice").otherwise("bool").alias("primitive"),
        F.col("p_name").alias("state_text"),
        F.lit("pick").alias("instructions"),
        F.when(even, three).otherwise(two).alias("criteria"),
        (F.col("p_partkey") % 3).cast("int").alias("answer_index"),
        (F.col("p_size") > 25).alias("answer_bool"),
    )
    docs = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.concat(F.lit("doc "), "doc_id").alias("document_title"),
        F.col("text").alias("document_text"),
        F.lit("pick").alias("instructions"),
        F.lit("choice").alias("primitive"),
        F.to_json(
            F.array(
                criterion("b", 1, F.col("source")), criterion("c", 2, F.lit("none")),
                criterion("a", 0, F.col("lang")),
            )
        ).alias("criteria_json"),
        (F.col("doc_id") % 3).cast("int").alias("target_index"),
    )
    both = K.programmatic_examples(solved, "solver_").unionByName(
        K.document_examples(docs, "document_")
    )
    return both.select(
        "id", "task", F.sha2("context", 256).alias("context_hash"),
        F.array_join("options", "|").alias("options"), "gold_index",
    )


@query(
    sql(
        "SELECT dataset, id, CAST(ntile(5) OVER (PARTITION BY dataset ORDER BY sha256('7:' || id), id) - 1 AS INT) "
        "AS fold FROM items"
    )
)
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five near-equal folds of a seeded shuffle per dataset."""
    items = V.all_items(spark, sf_dir).select("dataset", "id")
    return O.kfold(items, 5, ["dataset"], seed=7).select("dataset", "id", "fold")


@query(
    sql(
        """
SELECT run_fold, CASE WHEN fold = run_fold THEN 'val' ELSE 'train' END AS split, count(*) AS n
FROM (SELECT ntile(4) OVER (ORDER BY sha256('42:' || id), id) - 1 AS fold FROM items_choice),
     (SELECT unnest([0, 1, 2, 3]) AS run_fold) GROUP BY ALL"""
    )
)
def fold_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation sizes of every fold run."""
    items = V.items_choice(spark, sf_dir).select("id")
    splits = O.fold_splits(O.kfold(items, 4), 4)
    return splits.groupBy("run_fold", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        """
SELECT dataset, id, CASE WHEN rn <= greatest(1, floor(n * 0.1)) AND n > 1 THEN 'val' ELSE 'train' END AS split
FROM (SELECT dataset, id, count(*) OVER (PARTITION BY dataset) AS n,
        row_number() OVER (PARTITION BY dataset ORDER BY sha256('42:' || id), id) AS rn FROM items)"""
    )
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of every dataset held out in seeded order."""
    items = V.all_items(spark, sf_dir).select("dataset", "id")
    return O.holdout(items, 0.1, ["dataset"]).select("dataset", "id", "split")


@query(
    """
SELECT task, split, count(*) AS n, max(id) AS last_id FROM (
  SELECT task, id, CASE WHEN rn <= greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT p_type AS task, p_partkey AS id, count(*) OVER (PARTITION BY p_type) AS n,
          row_number() OVER (PARTITION BY p_type ORDER BY sha256('0:' || p_partkey), p_partkey) AS rn
        FROM part)) GROUP BY ALL"""
)
def task_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in twenty examples per task held out, at least one."""
    part = V.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("task"), F.col("p_partkey").alias("id")
    )
    split = O.holdout(part, 0.05, ["task"], seed=0, keep_single=False)
    return split.groupBy("task", "split").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")
    )


@query(
    """
SELECT doc_id, sha256(text) AS text_hash FROM (
  SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) ORDER BY sha256('42:' || text) LIMIT 100"""
)
def prompt_dedupe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated prompts dropped, then a fixed-size sample in hash order (a sampling operator)."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = O.seeded_sample(docs, "text", 100, "doc_id")
    return sample.select("doc_id", F.sha2("text", 256).alias("text_hash"))
