"""Word maps are built inside their rows; Python workers get batches of bounded bytes."""

import pandas as pd
from pyspark.sql import functions as F

from verdictlake.operators import papers as P
from verdictlake.scale import apply_settings


def test_word_positions(spark):
    rows = [(1, ["b a  b\nc"]), (2, ["a b", "b a"]), (3, [" \t "]), (4, []), (5, [" ".join(f"w{k % 50}" for k in range(3000))])]
    df = spark.createDataFrame(rows, "doc_id bigint, texts array<string>")
    out = P.word_positions(df, "texts", "m")
    got = {r["doc_id"]: {w: sorted(ps) for w, ps in r["m"].items()} for r in out.collect()}
    assert got.pop(5) == {f"w{k}": list(range(k, 3000, 50)) for k in range(50)}
    assert got == {1: {"b": [0, 2], "a": [1], "c": [3]}, 2: {"a": [0, 1], "b": [0, 1]}}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "posexplode" not in text
    back = {r["doc_id"]: r["t"] for r in out.select("doc_id", P.rebuild_abstract("m").alias("t")).collect()}
    assert back[1] == "b a b c" and back[5].split() == [f"w{k % 50}" for k in range(3000)]


def test_batches_are_bounded_by_bytes(spark):
    apply_settings(spark)

    @F.pandas_udf("bigint")
    def rows_in_batch(pages: pd.Series) -> pd.Series:
        return pd.Series([len(pages)] * len(pages))

    pages = spark.range(0, 48, numPartitions=1).select(F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), 200_000).alias("html"))
    found = [r["n"] for r in pages.select(rows_in_batch("html").alias("n")).collect()]
    assert len(found) == 48
    assert max(found) <= 30


def test_packing_holds_bounded_texts_and_one_thread(spark, monkeypatch):
    import os

    import pyarrow as pa

    import corpus_pipeline
    from verdictlake.llm import ngram_join, packing

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 30))
    docs = spark.createDataFrame([(k, "some words " * 50) for k in range(20)], "doc_id bigint, text string")
    corpus_pipeline.packed(spark, docs, "")
    assert int(spark.conf.get(key)) <= 8 << 20
    spark.conf.set(key, before)
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    packing.WordIds(packing.vocabulary())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["x" * 1000] * 39 + ["y" * 9000]})
    cut = list(ngram_join.slices(iter([batch]), "text", 4000, 1000))
    assert pa.Table.from_batches(cut) == pa.Table.from_batches([batch]) and max(b.num_rows for b in cut) == 4
