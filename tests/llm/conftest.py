import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names operators use inside themselves.
CLASHING = ["id", "hash", "rep", "key", "made", "score", "gone", "content", "bucket", "packed", "label", "node", "good", "target", "toxic", "held_out"]


@pytest.fixture
def docs_of(spark):
    """Frames like ``documents`` from (doc_id, text[, lang]) rows, with clashing further columns if asked."""
    def make(rows, clashing=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in CLASHING if clashing else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
