import pytest
from pyspark.sql import types as T

ROWS = [
    # doc_id, text, lang, source, n_chars, a column whose name an operator might use itself
    (1, "Alpha beta gamma delta epsilon", "en", "a", 1, 0.5),
    (2, "alpha BETA gamma delta epsilon", "en", "a", 1, None),
    (3, "alpha beta gamma delta epsilon", None, "b", 1, 0.1),
    (4, "", "en", "b", 0, 0.1),
    (5, None, "en", None, None, 0.1),
    (6, " \t\n ", "fr", "", 3, 0.1),
    (7, "eins zwei drei vier fünf. Größe, ÄPFEL!", "de", "b", 1, 0.1),
    (7, "eins zwei drei vier fünf. Größe, ÄPFEL!", "de", "b", 1, 0.1),
    (None, "no id here <|endoftext|> at all", "en", "c", 1, 0.1),
    (None, "no id here <|endoftext|> at all", "en", "c", 1, 0.1),
    (8, " ".join(f"w{k % 37}" for k in range(6000)), "en", "a", 1, 0.1),
    (9, "x y\x1cz one\x0btwo\x0cthree\rfour", "en", "a", 1, 0.1),
    (10, "q" * 5000, "en", "c", 1, 0.1),
]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, FIELDS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables with odd rows among ordinary ones, as a data folder."""
    base = tmp_path_factory.mktemp("tables")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = spark.createDataFrame([(r[0] and r[0] + 10_000, *r[1:5]) for r in ROWS], docs.schema)
    docs.unionByName(odd).write.parquet(f"{base}/documents.parquet")
    for name in ("labels", "pages", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    return str(base)
