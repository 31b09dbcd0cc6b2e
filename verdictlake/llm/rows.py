"""Helpers the training-data operators share: row identity, whole-word splitting, joins by checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.scale import write_through

WORD = r"[^\x20\x09-\x0D]+"
RID = "_rid"
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table without columns whose names begin with an underscore: those names are the operators' own."""
    return without_own_names(spark.read.parquet(f"{folder}/{name}.parquet"))


def without_own_names(df: DataFrame) -> DataFrame:
    taken = [c for c in df.columns if c.startswith("_")]
    return df.drop(*taken) if taken else df


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator that gives back the columns of its first table use names with a leading underscore.

    The caller's columns of such names have others meanwhile and get theirs back.
    """
    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside = {}
        for c in docs.columns:
            if c.startswith("_"):
                name = f"caller{c}"
                while name in docs.columns or name in aside.values():
                    name = f"caller_{name}"
                aside[c] = name

        def moved(value):
            return aside.get(value, value) if isinstance(value, str) else value

        if not aside:
            return operator(docs, *args, **options)
        out = operator(docs.withColumnsRenamed(aside), *map(moved, args), **{k: moved(v) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run


def identified(df: DataFrame) -> DataFrame:
    """`df` plus `_rid`, a struct naming each row the same way in every pass over the table.

    A plain file scan names rows by file and position. Anything else is written to the
    shared folder first, since a recomputed plan may deal its rows out anew.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        return df.select("*", F.struct(
            F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(RID))
    held = write_through(df.withColumn(RID, F.struct(
        F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("i"))))
    return held


def lowered(text: Column) -> Column:
    """Text with only A-Z lower-cased; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but space and \\t to \\r); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def join_narrow(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, width: int | Column) -> DataFrame:
    """Join a wide table to a narrow written one of `width` bytes a row (a number or a column).

    The narrow side is broadcast only if its counted size is within BROADCAST_BYTES;
    beyond that both sides are shuffled, and adaptive execution splits skewed keys.
    """
    if (small.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, list(on), how)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch: index of each word's form, the distinct forms, and where each text begins.

    Words are cut at space and \\t to \\r only; a null text has none.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    offsets -= offsets[0]
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        kept = index != blank
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        index = index[kept]
    return index, coded.dictionary, offsets


def as_batches(columns: dict[str, pa.Array | np.ndarray], schema: pa.Schema, rows: int = 50_000) -> Iterable[pa.RecordBatch]:
    """Columns as record batches of bounded length."""
    whole = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from whole.to_batches(max_chunksize=rows)
