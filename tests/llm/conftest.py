import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=True):
    """Rows (doc_id, text) as documents, with columns of names that operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
    if extra:
        df = df.withColumns({"fp": F.lit("x"), "key": F.lit(1.5), "row": F.lit("r"), "statistics": F.lit(3), "score": F.lit(None).cast("double"), "n_tokens": F.lit("n"), "Component_ID": F.lit(1)})
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, extra=True: docs_frame(spark, rows, extra)


#: Nulls, empty and blank texts, one word, repeated rows, ties, a long text, odd characters.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (4, "word"), (5, "same text twice"), (5, "same text twice"), (5, "another text of one id"), (6, "é ü ß 日本 🙂 Σ İ\x1cx y"), (7, "long " * 60_000)]


@pytest.fixture
def odd():
    return list(ODD)
