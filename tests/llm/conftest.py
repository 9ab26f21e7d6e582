import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with inner ones."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        extra = ("score", "digest", "same", "key", "fp", "rid", "size", "base", "cut", "pick", "text_hash", "item_id", "a", "b", "own_id")
        return df.selectExpr("*", *[f"'x' AS {name}" for name in extra])

    return make


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples of some columns."""

    def collect(df, *names):
        return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)

    return collect
