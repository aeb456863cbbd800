import pytest

#: A text far longer than any other, and what operators call their own columns.
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
CLASHING = ("score", "label", "fp", "key", "run", "size", "text_sha", "u", "t1", "t2", "copies", "terms", "bucket", "path", "license", "_keep", "_good", "found", "_times", "_copy", "_i", "_s", "_n", "tag", "row_tag", "good_id", "mix_id", "mix_times", "least", "open", "range")

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "a"),
    (2, "The quick brown fox jumps  over the lazy dog.\nIt was a fine day.", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\r\n\x0b\x0c ", "fr", None),
    (6, "Élan vital, ça et là: ½ naïve café — 日本語 text 🙂", "fr", "b"),
    (7, LONG, "en", "a"),
    (8, "Released under the MIT License.", "en", "b"),
    (8, "Released under the MIT License.", "en", "b"),
    (None, "A row without an id", "en", "b"),
    (9, "x", "en", "zz"),
    (10, "x", "en", "zz"),
    (11, "a<|endoftext|>b RIFF BM PK\x03\x04 %PDF-1.4 GIF89a", "en", "a"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, a null id, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, lang, s, None if t is None else len(t), *["clash"] * len(CLASHING)) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
