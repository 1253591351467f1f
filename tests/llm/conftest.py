import pytest

from tidegrid.session import ship_package

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds documents from texts: (id, text) pairs or texts alone, with a source by id."""
    ship_package(spark)

    def build(rows, sources=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, None, (sources or {}).get(i, "s1"), None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return build


#: Null and empty texts and ids, only spaces, ties, repeated rows, a very long text, letters of many bytes.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (None, "no id here"), (7, "same row"), (7, "same row"),
    (8, "long " * 60_000), (9, "Größe É x \U0001f600 naïve   ſecret"), (10, None), (-3, "negative id"), (None, None),
]


@pytest.fixture(scope="session")
def odd(corpus):
    return corpus(ODD)
