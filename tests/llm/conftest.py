import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHING, KINDS, ODD_TEXTS


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, extra=True):
        """Documents from (doc_id, text) pairs, with columns whose names an operator could mix up with its own."""
        full = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, KINDS)
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if extra else df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "\n\n"), (5, "one two"), (5, "another text"), (None, "one two"), (None, None)]
    return make(rows)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
