import pytest

LONG = " ".join(f"w{(k * k) % 977}x{k}" for k in range(6000)) + "."


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text: nulls, empty, blank, ties, repeated rows, an id with two texts, very long texts."""
    shared = " ".join(f"shared{k}" for k in range(60)) + "."
    return [
        (1, "Alpha beta gamma delta. " + shared),
        (2, "Other words before it. " + shared + " And words behind it."),
        (2, "Other words before it. " + shared + " And words behind it."),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (None, "Alpha beta gamma delta. " + shared),
        (None, None),
        (6, "One."),
        (7, LONG),
        (8, LONG),
        (9, "first text of an id " + shared),
        (9, "second text of an id, quite different from the first one in all its words"),
        (10, "Ünïcödé ça ñandú ß 漢字 🙂 text with NUL \x00 and é."),
        (11, "A" * 3000),
        (12, "A" * 3000),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with extra columns whose names the operators use inside."""
    names = ["text_key", "fp", "start", "spans", "key", "doc", "nth", "runs", "n_words", "bucket", "order", "toxic", "score", "length", "block", "host", "path"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
