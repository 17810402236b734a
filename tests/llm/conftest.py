import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, "the cat sat on the mat and slept all day", "x"), (1, "the cat sat on the mat and slept all day", "x"), (2, "", None), (3, None, "y"),
            (4, "z" * 200_000, "z"), (5, " \n\t ", "z"), (6, "word " * 30_000, None), (None, "the cat sat on the mat and slept all day", "n"),
            (7, "mail me: a.b@c.org or +1 (243) 555-5526, card 4111 1111 1111 1111, ip 10.0.0.1.", "p"), (8, "é漢🙂 <|endoftext|>  x", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ["score", "predicted", "n_tokens", "ids", "base", "found", "rule", "Verdict", "_text", "_clean", "node", "a", "b", "kept", "a.b"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
