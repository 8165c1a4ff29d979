import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long and repeated texts, equal ids, a null id, a clashing column."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c d e f g h"), (5, "a b c d e f g h"),
        (5, "other words under the same id as before"), (6, "A b C d e f g h"), (None, "text of a null id"),
        (7, "mail me: joe@example.com, +1 (555) 010-9999 or 4111 1111 1111 1111 at 10.0.0.255"),
        (8, "one"), (9, "one"), (10, "été über <|endoftext|>  x\n\ny"), (11, "x " * 80),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"n_tokens": F.lit("clash"), "k1": F.lit("clash"), "places": F.lit(1), "n": F.lit(2)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
