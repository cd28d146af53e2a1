import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text, source) rows, with an extra column."""

    def make(rows):
        rows = [(*r, *["src0"] * (3 - len(r)))[:3] for r in rows]
        kind = "doc_id long, text string, source string, size long, score string"
        return spark.createDataFrame([(*r, 7, "x") for r in rows], kind)

    return make
