"""Columns of the caller whose names an operator uses itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdictlake.llm import catalog, exact_dedup, mixing, near_copies, packing, rows, simhash, toxicity

NAMES = ("_rid", "_text", "_bytes", "_toxicity", "_id", "_row", "_copy", "_gone", "_t", "_len", "_full", "copies", "fp", "key", "caller_rid")


def clashing(df):
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES])


def ordered(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, k % 2) for k in range(1, 9)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "deduplicate": lambda docs, labels: exact_dedup.deduplicate(docs), "mixed": lambda docs, labels: mixing.mixed_documents(docs),
    "near_copies": lambda docs, labels: near_copies.keep_one_of_each(docs), "simhash": lambda docs, labels: simhash.keep_one_of_each(docs),
    "toxicity": lambda docs, labels: toxicity.drop_toxic(docs, labels)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_callers_columns_come_back(odd_docs, labels, name):
    docs = rows.write_through(odd_docs)
    got, plain = OPERATORS[name](rows.write_through(clashing(docs)), labels), OPERATORS[name](docs, labels)
    assert got.columns == clashing(docs).columns
    # Rows are named by their file, so which of two equal ids is kept may differ; ids and texts do not.
    assert ordered(got, ["doc_id", "text"]) == ordered(plain, ["doc_id", "text"])
    for r in got.collect():
        assert all(r[n] == f"{n}:{'' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)


def test_packing_leaves_callers_columns_out(odd_docs):
    assert ordered(packing.packed_documents(clashing(odd_docs)), ["doc_id", "start", "length"]) == ordered(
        packing.packed_documents(odd_docs), ["doc_id", "start", "length"])


@pytest.mark.parametrize("name", ["op1_language_id", "op4_mixing", "op9_simhash", "op10_exact_dedup", "op12_fill_in_middle", "op13_filter_audit"])
def test_queries_on_tables_with_clashing_names(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "pages"):
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        own = df.columns[0]
        df.select("*", *[F.lit(n).alias(n) for n in NAMES if n != own]).write.parquet(f"{tmp_path}/{t}.parquet")
    build = catalog.QUERIES[name]
    got, plain = build(spark, str(tmp_path)), build(spark, folder)
    assert got.columns == plain.columns and ordered(got, got.columns) == ordered(plain, plain.columns)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
