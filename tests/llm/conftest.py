import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, fp long, word string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    long = " ".join(f"word{i % 97} is{i}" for i in range(12_000))
    rows = [
        (0, "The cat sat on the mat and then the dog came in to see it all again today", "en", "a", 70, 1.0, 1, 1, "w", "l"),
        (1, "the cat SAT on the mat and then the dog came in to see it all again today", "en", "a", 70, None, None, None, None, None),
        (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 0.0, 0, 0, "", ""), (4, " \n\t ", "fr", "b", 4, 0.0, 0, 0, "", ""),
        (5, long, "en", "a", len(long), 0.5, 3, 7, "x", "y"), (6, "a b c", "de", None, 5, 0.5, 3, 7, "x", "y"), (6, "a b c", "de", None, 5, 0.5, 3, 7, "x", "y"),
        (None, "un texte sans identifiant mais avec des mots français été ça", "fr", "c", 60, 0.5, 3, 7, "x", "y"),
        (7, "日本語 🙂 ▁ <|endoftext|> \x00 é́ x", None, "c", 30, 0.5, 3, 7, "x", "y"), (8, "### $$$ %%% &&&", "en", "a", 15, 0.5, 3, 7, "x", "y"),
        (9, "line of the text here\nline of the text here\nother line\nline of the text here", "en", "a", 15, 0.5, 3, 7, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (3, 0, 0), (5, 1, 1), (6, None, None), (8, 0, 0), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
