"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
import check
import corpus_pipeline
from gavel.llm import decontaminate, mixing, neardup, quality, toxicity
from gavel.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_registry():
    assert {**QUERIES, "pipeline": corpus_pipeline.run}.items() <= entry_point.queries().items()
    assert SQL.items() <= entry_point.oracle_sql().items()
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "SQL", SQL)
    outcome = check.compare(spark, duck, name, SF_DIR)
    assert outcome.startswith("ok" if name in SQL else "rows-only"), outcome
    assert " 0 rows" not in outcome


def test_pipeline_against_its_operators(spark):
    """Every stage keeps exactly the rows that its operator's own table says."""
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == docs.columns
        if name == "quality classifier":
            want = ids(quality.quality(docs, labels).where("predicted = 1"))
        elif name == "toxicity":
            want = ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
        elif name == "benchmark decontamination":
            want = ids(docs.join(decontaminate.leaks(docs, read("benchmark")), "doc_id", "left_anti"))
        else:
            texts = {r.doc_id: r.text for r in docs.collect()}
            order, kept = sorted(texts), []
            for i in order:
                if not any(neardup.similarity(texts[i], texts[j]) >= 0.8 for j in kept):
                    kept.append(i)
            want = kept
        assert ids(got) == want, name
        docs = spark.createDataFrame(got.collect(), got.schema)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR)
    copies = {r.doc_id: r.copies for r in mixing.mix_table(docs).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    assert mixed.columns == [*docs.columns, "copy"]
