import pytest

from salesloom.llm.common import ship

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


def clashing(df):
    """The table with extra columns named like inner and outer ones of the operators."""
    for name in ("id", "key", "rank", "size", "score", "digest", "gid", "bucket", "target", "th"):
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def result(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))
