import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs_frame(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


EDGES = [
    (1, None, "en", "s1", 0), (2, "", "en", None, 0), (None, "the cat sat on the mat and looked at the dog", None, "s1", 44), (3, " \n\t ", "fr", "s2", 4),
    (4, "password = hunter22 token:abc AKIA" + "A1" * 10 + " deadbeef" * 4, "en", "s2", 60), (4, "password = hunter22 token:abc AKIA" + "A1" * 10 + " deadbeef" * 4, "en", "s2", 60),
    (5, "été <|endoftext|> 🙂 ΣΑΣ\r\nà la carte  x", "fr", "s3", 30), (6, "word " * 30_000, "de", "s3", 150_000), (7, "x" * 20_000, "de", "s3", 20_000), (8, "one", "es", "s1", 3), (9, "one", "es", "s1", 3),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [(*r, 7, "c", 1.5, b"z", 2) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, x string, n double, row binary, doc long")


@pytest.fixture(scope="session")
def edge_frame():
    return pd.DataFrame(EDGES, columns=["doc_id", "text", "lang", "source", "n_chars"])


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
