import datetime

import pytest

#: Column names that an operator might use itself.
CLASHES = ["n", "key", "row", "kept", "words", "node", "gone", "id", "source", "spans"]


@pytest.fixture
def frame(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""

    def make(pairs, lang="en", source="s"):
        extra = [c for c in CLASHES if c != "source"]
        rows = [(i, t, lang, source, len(t or ""), datetime.date(2024, 1, 1), *["x"] * len(extra)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, day date, " + ", ".join(f"`{c}` string" for c in extra))

    return make
