import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators use themselves
            for i, c in enumerate(("__keys", "__new", "__lost", "__bad", "__score", "node", "component", "keys", "Kept", "hits", "tokens", "SCORE", "pattern", "Order", "whole", "rest", "ahead", "part", "before", "folder", "version", "alone", "further", "own", "block", "segment", "shard", "salt", "gone", "feature", "a.b", "tick`ed")):
                df = df.withColumn(c, df.doc_id * i)
        return df

    return make
