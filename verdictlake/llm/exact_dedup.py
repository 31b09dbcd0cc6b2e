"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Built of DataFrame operations only. One scan takes each row's byte length and the hash of
its first characters. Lengths that occur once are settled by that; of the rest, so are
(length, prefix) pairs that occur once. Only texts of the remaining groups are hashed whole.
Groups are counted with map-side combining, so a group of a third of all rows is a counter.
Texts themselves are never shuffled for the grouping while the surviving keys fit a checked
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import RID, identified, join_narrow, lowered, own_names, table
from verdictlake.scale import write_through

PREFIX = 256


def copy_groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Members of every group of two or more equal texts: _rid, keep_id, group_size, kept.

    `rows` come from `identified`. Texts are equal when identical after lower-casing A-Z; a
    null text equals an empty one. The row with the largest id stays; null ids rank below
    all others, and among rows of the same id the last by row identity stays, so exactly one
    row of a group is kept. An empty table has no members.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    traits = rows.select(
        RID, F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"),
        F.xxhash64(lowered(F.substring(text, 1, PREFIX))).alias("_prefix"))
    # Counted per pair first, so that a hot length joins as few rows as it has prefixes.
    pairs = write_through(traits.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")))
    lengths = pairs.groupBy("_len").agg(F.sum("_n").alias("_all")).filter("_all > 1").select("_len")
    starts = write_through(pairs.join(lengths, "_len", "left_semi").filter("_n > 1").select("_len", "_prefix"))
    surviving = join_narrow(traits, starts, ["_len", "_prefix"], "left_semi", 16)
    hashed = write_through(surviving.select(RID, "_id", F.sha2(lowered(F.col("_text")), 256).alias("_full")))
    groups = hashed.groupBy("_full").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_id", RID)).alias("_top")).filter("group_size > 1")
    return hashed.join(groups, "_full").select(
        RID, F.col("_top._id").alias("keep_id"), "group_size", (F.col(f"_top.{RID}") == F.col(RID)).alias("kept"))


@own_names
def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns; see `copy_groups` for the rules."""
    rows = identified(docs)
    dropped = write_through(copy_groups(rows, id_col, text_col).filter(~F.col("kept")).select(RID))
    return join_narrow(rows, dropped, [RID], "left_anti", 24).select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = identified(table(spark, folder, "documents"))
    members = write_through(copy_groups(rows))
    every = rows.select(RID, "doc_id", F.sha2(lowered(F.col("text")), 256).alias("text_sha256"))
    return every.join(members, RID, "left").select(
        "doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"), "text_sha256")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
