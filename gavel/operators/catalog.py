"""Dataset catalogue: subsets, provenance rows, licence and integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.schemas import require

SUBSETS = ("noul", "choice", "score", "all")
# Licences that may be redistributed, and their hosts' address form.
MIRRORABLE = ("MIT", "Apache-2.0", "CC BY 4.0", "CC BY-SA 4.0")
HUB = "https://huggingface.co/datasets/"
VERSIONED_KINDS = ("git", "hf_dataset", "hf_snapshot", "hf_parquet")
REVISION = r"^[0-9a-f]{40}$"


def entries(manifest: DataFrame) -> DataFrame:
    """Catalogue entries with their position, listed ones first, then the gated ones."""
    listed = manifest.select(
        "repo_id", F.lit(False).alias("gated"), F.posexplode("datasets").alias("position", "e")
    )
    gated = manifest.select(
        "repo_id", F.lit(True).alias("gated"), F.posexplode("excluded").alias("position", "e")
    )
    return listed.unionByName(gated).select("repo_id", "gated", "position", "e.*").withColumnRenamed(
        "repo_id", "manifest_repo"
    )


def select_subset(
    catalog: DataFrame, members: DataFrame, subset: str, include_gated: bool = False
) -> DataFrame:
    """Entries of a subset in manifest order; gated ones of the task only when asked.

    `members` has subset, position, id.
    """
    if subset not in SUBSETS:
        raise ValueError(f"unknown subset: {subset}")
    chosen = members.filter(F.col("subset") == subset).select(
        "id", F.col("position").alias("turn")
    )
    listed = catalog.filter(~F.col("gated")).withColumn("__known", F.lit(True))
    message = F.concat(F.lit(f"subset {subset} names an unknown dataset: "), F.col("id"))
    open_ = require(chosen.join(listed, "id", "left"), F.col("__known"), message)
    open_ = open_.select(*catalog.columns, "turn", F.lit(0).alias("block"))
    if not include_gated:
        return open_
    wanted = F.lit(subset == "all") | F.array_contains("tasks", subset)
    gated = catalog.filter(F.col("gated") & wanted).withColumns(
        {"turn": F.col("position"), "block": F.lit(1)}
    )
    return open_.unionByName(gated)


def viewer_url(source: str = "source", repo: str = "manifest_repo") -> Column:
    """Where the rows can be browsed, by source kind."""

    def s(field: str) -> Column:
        return F.col(f"{source}.{field}")

    kind = s("kind")
    pages = F.concat(
        F.lit(HUB), s("repo_id"), F.lit("/viewer/"),
        F.coalesce(F.nullif(s("config"), F.lit("")), F.lit("default")), F.lit("/"), s("split"),
    )
    tree = F.concat(
        F.lit(HUB), s("repo_id"), F.lit("/tree/"),
        F.coalesce(F.nullif(s("revision"), F.lit("")), F.lit("main")),
    )
    own = F.concat(F.lit(HUB), F.col(repo), F.lit("/tree/main/"), s("path"))
    git = F.concat(F.regexp_replace(s("url"), r"\.git$", ""), F.lit("/tree/"), s("revision"))
    has_split = F.coalesce(s("split"), F.lit("")) != ""
    return (
        F.when(kind.isin("hf_dataset", "hf_parquet") & has_split, pages)
        .when(kind == "hf_snapshot", tree)
        .when(kind == "own", own)
        .otherwise(git)
    )


def catalog_rows(selected: DataFrame) -> DataFrame:
    """Routing table rows with provenance."""
    s = F.col("source")
    return selected.select(
        "id",
        "title",
        F.coalesce("distribution", F.lit("router")).alias("distribution"),
        F.array_join("tasks", ",").alias("tasks"),
        "rows",
        "license",
        s["kind"].alias("source_kind"),
        F.coalesce(
            F.nullif(s["repo_id"], F.lit("")), F.nullif(s["url"], F.lit("")), F.col("manifest_repo")
        ).alias("source_repo"),
        s["config"].alias("source_config"),
        s["split"].alias("source_split"),
        s["revision"].alias("revision"),
        viewer_url().alias("viewer_url"),
        F.coalesce("description", "reason").alias("description"),
    )


def router_entries(catalog: DataFrame) -> DataFrame:
    """Datasets that are not mirrored, the gated ones included."""
    return catalog.filter(F.col("gated") | (F.coalesce("distribution", F.lit("")) == "router"))


def violations(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """Broken integrity rules as (rule, id) rows; empty when the catalogue is sound."""
    listed = catalog.filter(~F.col("gated"))
    known = listed.select("id")

    def broken(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col("id"))

    unknown = members.select("id").distinct().join(known, "id", "left_anti")
    tasks = listed.select("id", F.explode("tasks").alias("subset"))
    in_task = members.filter(F.col("subset") != "all").select("id", "subset")
    unlisted = tasks.join(in_task, ["id", "subset"], "left_anti")
    unwanted = in_task.join(known, "id", "left_semi").join(tasks, ["id", "subset"], "left_anti")
    not_in_all = known.join(members.filter(F.col("subset") == "all").select("id"), "id", "left_anti")
    revision = F.coalesce("source.revision", F.lit(""))
    unpinned = listed.filter(
        F.col("source.kind").isin(*VERSIONED_KINDS) & ~revision.rlike(REVISION)
    )
    undocumented = catalog.filter(
        (F.coalesce("license", F.lit("")) == "")
        | ~F.coalesce(F.col("url"), F.lit("")).startswith("https://")
    )
    licence = catalog.filter(
        (F.col("distribution") == "mirror") & ~F.col("license").isin(*MIRRORABLE)
    )
    gated_default = listed.filter(F.col("access") != "open")
    parts = [
        broken(unknown, "unknown_subset_id"),
        broken(unlisted, "task_not_in_subset"),
        broken(unwanted, "subset_not_in_tasks"),
        broken(not_in_all, "missing_from_all"),
        broken(unpinned, "revision_not_pinned"),
        broken(undocumented, "origin_not_documented"),
        broken(licence, "licence_not_mirrorable"),
        broken(gated_default, "gated_by_default"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Model families by name part, in order of precedence.
FAMILIES = (
    ("qwen3-swallow", "Qwen3-Swallow"),
    ("qwen3.5", "Qwen3.5"),
    ("qwen2.5", "Qwen2.5"),
    ("qwen3", "Qwen3"),
    ("gemma", "Gemma 4"),
    ("sarashina", "Sarashina2.2"),
    ("llm-jp", "LLM-jp 4"),
)
# Families whose models think or not on request, and marks of single training stages.
HYBRID_FAMILIES = ("Qwen3", "Qwen3.5")
# Name parts that set a variant and its tags; the first that fits counts.
VARIANTS = (
    (("thinking",), "Thinking", ("Thinking",)),
    (("qat",), "Instruct · QAT", ("Instruct",)),
    (("instruct", "-it"), "Instruct", ("Instruct",)),
    (None, "Instruct + Thinking", ("Instruct", "Thinking")),  # a hybrid family without a mark of training
    (("-sft",), "SFT", ("other",)),
    (("-rl",), "RL", ("other",)),
    (("-cpt",), "CPT", ("other",)),
    ((), "Base", ("Base",)),
)
TRAINING_MARKS = ("-base", "-cpt", "-sft", "-rl")


def model_spec(model: Column) -> dict[str, Column]:
    """Family, size in billions, variant and tags read from a model id by the tables above."""
    key = F.lower(model)

    def holds(parts: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, parts)), lambda part: key.contains(part))

    family = F.coalesce(*[F.when(holds((part,)), name) for part, name in FAMILIES], F.lit("Other"))
    hybrid = family.isin(*HYBRID_FAMILIES) & ~holds(TRAINING_MARKS)
    rows = []
    for parts, name, tags in VARIANTS:
        row = F.struct(F.lit(name).alias("variant"), F.array(*map(F.lit, tags)).alias("tags"))
        rows.append(F.when(hybrid if parts is None else holds(parts), row) if parts != () else row)
    found = F.coalesce(*rows)
    # A part of the id that is a number of billions, `e` for effective before it.
    sizes = F.filter(F.split(key, "[-_]"), lambda part: part.rlike("^e?[0-9]+([.][0-9]+)?b$"))
    size = F.translate(F.get(sizes, F.lit(0)), "eb", "").try_cast("double")
    return {"family": family, "size": size, "variant": found["variant"], "tags": found["tags"]}
