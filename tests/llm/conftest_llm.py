import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside, to clash with.
CLASHING = ["key", "row", "_row", "_key", "_text", "node", "kind", "value", "ids", "length", "hash", "score", "spans", "cell"]

WORDS = "the quick brown fox jumps over a lazy dog while seven large boxes of dark liquid stand near an old stone wall".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] for i in range(30_000))
SECRET = 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"'

ROWS = [
    (1, " ".join(WORDS), "en", "a"),
    (2, " ".join(WORDS), "en", "b"),  # a copy
    (3, " ".join(WORDS[:-1] + ["fence"]), "en", "a"),  # a near copy
    (4, None, "en", "a"),
    (5, "", "de", None),
    (6, " \t\n\x0b ", None, "a"),
    (7, "Hi.", "fr", "a"),
    (8, LONG, "en", "a"),
    (9, f"mail me at jo@mail.example.org or +49 30 1234567 from 10.0.0.1\n{SECRET}", "en", "a"),
    (10, "der die das und ist nicht mit von auf für ein eine\n" * 4, "de", "c"),
    (11, "1234 5678 !? \x01\x02 €é漢字😀 <|endoftext|>", None, None),
    (None, "a row without an id that still has more than ten words in it", "en", "a"),
    (12, "same id, one text", "en", "a"),
    (12, "same id, another text", "en", "a"),
    (13, "x" * 40_000, "en", "a"),
    (14, "x" * 40_000, "en", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, copies, repeated ids, and columns with clashing names."""
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s in ROWS]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHING:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
