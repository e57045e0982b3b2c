import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sentence(rng, n):
    return " ".join("".join(rng.choices("abdeilnorst", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, one very long, repeated rows and equal texts."""
    rng = random.Random(5)
    text, long = sentence(rng, 80), sentence(rng, 30_000)
    return [
        (1, text, "en", "a", 1), (2, text, "en", "b", 1), (2, text, "en", "b", 1), (None, text, None, None, None),
        (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "b", 4),
        (6, "one", "en", "é", 3), (7, long, "en", "a", len(long)), (8, text + " more", "en", None, 9),
        (9, "\U0001f600  x  y", "en", "c", 3), (-4, sentence(rng, 200), "en", "a", 0),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def crowded(odd):
    """The same rows with further columns, named as the operators name their own."""
    names = ("doc", "row", "key", "at", "w", "size", "bucket", "slots", "source_size", "target", "tie", "kept", "id",
             "part", "shard", "component", "held_out", "k0", "windows", "score", "_flagged", "_dropped", "new", "nth")
    return odd.selectExpr("*", *(f"'x' as {n}" for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f g h i j k l m n"), (3, "too short")]
    return spark.createDataFrame(rows, "item_id long, text string")
