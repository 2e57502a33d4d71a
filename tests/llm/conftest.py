import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet consectetur " * 6000
DOC = "Der Zug nach Bern fährt um zehn Uhr ab, und der Speisewagen bleibt heute leider geschlossen."


def edge_rows():
    """Null, empty, blank and very long texts, copies, ties, repeated rows, null
    ids, languages and sources."""
    texts = [
        (1, None, None, None),
        (2, "", "de", "a"),
        (3, " \n\t ", "de", None),
        (4, DOC, "de", "a"),
        (5, DOC.upper().replace("Ä", "ä"), "de", "b"),
        (6, DOC + "!", "de", "b"),
        (7, LONG, "la", "c"),
        (8, LONG + "x", "la", "c"),
        (9, "Écoutez, l'hôtel où naïveté çà et là — 東京 2024 \U0001f600 don't", "fr", "a"),
        (9, "another text under the same id", "en", "a"),
        (10, "repeated row", "en", "a"),
        (10, "repeated row", "en", "a"),
        (None, "no id at all, but text", "en", "a"),
        (None, "no id at all, but text", "en", "a"),
        (11, "12345 67890 --- !!!", "en", ""),
        (12, "a" * 3000 + " <|endoftext|> " + "b" * 700, "en", "hot"),
    ]
    texts += [(100 + i, f"short document number {i % 7} of the hot source", "en", "hot") for i in range(60)]
    return texts


CLASHING = ["kept", "slot", "mix", "fp", "key", "rank", "pos", "t", "doc", "mark", "part", "n", "__key", "__t", "h", "tree"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in CLASHING],
        ]
    )
    rows = [(i, t, lg, s, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, lg, s in edge_rows()]
    return spark.createDataFrame([Row(*r) for r in rows], schema).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id = -1")
