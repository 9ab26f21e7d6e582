"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import (
    decontaminate, htmltext, infill, mixing, negatives, quality, secret_scan, simhash, tokens, topk, toxicity, urls, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate component."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    mixed = mixing.mix_table(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt outside the held-out fold."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACE = r"\x20\x09-\x0D"
_NAMES = rf"'([\p{{Ll}}\p{{N}},;:][{_SPACE}]+)(\p{{Lu}}\p{{Ll}}+)', '\1¤\2', 'g'"
_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
_FORM = (
    "list_transform(raw, lambda w, i: CASE WHEN w < ':' THEN '#n' WHEN starts_with(w, '¤') THEN {name} "
    "WHEN i > 1 AND w IN ({units}) AND raw[i - 1] < ':' THEN '#u' ELSE w END)"
)


def _template_sql(table_name: str, key: str, names: bool = True) -> str:
    """SELECT of key, text, pos, form and vals (slots) of every window."""
    form = _FORM.format(name="'#p'" if names else "substr(w, 2)", units=_UNITS)
    return rf"""
      SELECT {key}, text, pos, form[pos + 1:pos + 8] AS form, vals[pos + 1:pos + 8] AS vals FROM (
        SELECT *, unnest(range(0, len(form) - 7)) AS pos FROM (
          SELECT *, list_transform(form, lambda f, i: CASE WHEN starts_with(f, '#') THEN raw[i] ELSE '' END) AS vals FROM (
            SELECT *, {form} AS form FROM (
              SELECT {key}, text, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(
                text, {_NAMES}), {_NAMES}), '[^\p{{L}}\p{{M}}\p{{N}}¤{_SPACE}]+', '', 'g')), '[{_SPACE}]+'), lambda w: w <> '') AS raw
              FROM {table_name}) WHERE len(raw) >= 8)))"""


@query(f"""
    WITH wins AS ({_template_sql("documents", "doc_id")}),
    both_forms AS ({_template_sql("benchmark", "item_id")} UNION {_template_sql("benchmark", "item_id", names=False)}),
    known AS (SELECT *, count(DISTINCT pos) OVER (PARTITION BY item_id) AS windows FROM both_forms
      WHERE len(list_filter(form, lambda f: starts_with(f, '#'))) <= 3),
    met AS (SELECT w.doc_id, w.text, k.item_id, k.windows, k.pos AS place, w.pos - k.pos AS apart, k.vals AS was, w.vals AS now
      FROM wins w JOIN known k USING (form)),
    pairs AS (SELECT DISTINCT doc_id, text, item_id, apart, was[i] AS was, now[i] AS now FROM (
      SELECT *, unnest(range(1, 9)) AS i FROM met) WHERE was[i] <> ''),
    steady AS (SELECT doc_id, text, item_id, apart, count(*) = count(DISTINCT was) AS ok, max(was <> now) AS differs
      FROM pairs GROUP BY ALL),
    seen AS (SELECT doc_id, text, item_id, apart, count(DISTINCT place) AS matched, any_value(windows) AS windows
      FROM met GROUP BY doc_id, text, item_id, apart)
    SELECT s.doc_id, s.item_id, max(matched) AS matched, max(coalesce(differs, false)) AS reworded
    FROM seen s LEFT JOIN steady t ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.text = t.text
      AND s.item_id IS NOT DISTINCT FROM t.item_id AND s.apart = t.apart
    WHERE coalesce(ok, true) AND matched >= least(6, windows) GROUP BY s.doc_id, s.item_id""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules and, where none fits, by the model."""
    return urls.judge(table(spark, sf_dir, "pages"))


_PAYLOAD = "encode(coalesce(html, ''))"
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')"
)


@query(f"""
    WITH p AS (SELECT page_id, octet_length({_PAYLOAD}) AS n, sha1({_PAYLOAD}) AS hex,
      min(page_id) OVER (PARTITION BY sha1({_PAYLOAD})) AS first FROM pages)
    SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM p""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.section_counts(table(spark, sf_dir, "documents"))


@query("""
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 20""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("""
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    QUALIFY rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five best positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


_DRAW = "('0x' || substr(digest, {at}, 8))::BIGINT"


@query(f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
      FROM documents),
    c AS (SELECT *, least({_DRAW.format(at=1)} % (n + 1), {_DRAW.format(at=9)} % (n + 1)) AS i,
      greatest({_DRAW.format(at=1)} % (n + 1), {_DRAW.format(at=9)} % (n + 1)) AS j,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR {_DRAW.format(at=17)} % 100 >= 90 THEN 'plain'
        WHEN {_DRAW.format(at=25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substr(text, 1, i) AS pre, substr(text, i + 1, j - i) AS mid, substr(text, j + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM p""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form, and its text rebuilt from that form."""
    rows = infill.restored(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", F.col("restored_prefix").alias("prefix_chars"), F.col("restored_middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query()
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: what the rules find, and what the randomness tests add."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [F.size(F.filter(kinds, F.lit(kind).eqNullSafe)).cast("long") for kind in range(3)]
    return found.select(
        "doc_id", count[0].alias("n_assign"), count[1].alias("n_access"), count[2].alias("n_hex"),
        F.sha2(secret_scan.span_list("base"), 256).alias("base_sha256"), secret_scan.span_list("spans").alias("spans"),
    )
