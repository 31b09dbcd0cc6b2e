"""Turn operators over flat messages (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.labels import BLANKS
from verdictlake.scale import position_in_group, previous_in_group

NUMBERINGS = ("message_index", "assistant_ordinal", "stored")
# Shortest texts worth processing.
MIN_ASSISTANT_CHARS = 20
MIN_GUIDELINE_CHARS = 50
MIN_PAGE_CHARS = 100
MIN_BLOCK_CHARS = 20
MIN_ABSTRACT_CHARS = 200


def assistant_turns(df: DataFrame, numbering: str = "message_index") -> DataFrame:
    """Assistant messages with `turn_number` in one of three schemes.

    message_index: 0-based over all messages; assistant_ordinal: 1-based over
    assistant messages; stored: the stored turn value.
    """
    if numbering not in NUMBERINGS:
        raise ValueError(f"numbering is one of {NUMBERINGS}")
    is_assistant = F.col("role") == "assistant"
    if numbering == "stored":
        return df.filter(is_assistant).withColumn("turn_number", F.col("turn").cast("bigint"))
    if numbering == "assistant_ordinal":
        return position_in_group(df.filter(is_assistant), ["conv_id"], "turn", "turn_number")
    placed = position_in_group(df, ["conv_id"], "turn", "turn_number")
    return placed.withColumn("turn_number", F.col("turn_number") - 1).filter(is_assistant)


def with_previous(df: DataFrame, out: str = "user_question") -> DataFrame:
    """Add the text of the message before, blank for the first."""
    return previous_in_group(df, ["conv_id"], "turn", "text", out, F.lit(""))


def min_length(df: DataFrame, column: str, n: int, strict: bool = False, strip: bool = True) -> DataFrame:
    """Rows whose text has at least n characters (more than n when strict), white space stripped."""
    size = F.length(F.btrim(column, F.lit(BLANKS)) if strip else F.col(column))
    return df.filter(size > n if strict else size >= n)


def prefix_references(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_messages): a prefix named by its conversation and its number of messages."""
    return position_in_group(df.select("conv_id", "turn", "role"), ["conv_id"], "turn", "n_messages")


def stored_conversations(df: DataFrame, suffix: str | None = None) -> DataFrame:
    """(conv_id, messages): each conversation once, its messages in order; `suffix` is appended to user messages."""
    content = F.col("text")
    if suffix is not None:
        content = F.when(F.col("role") == "user", F.concat(content, F.lit(suffix))).otherwise(content)
    message = F.struct("turn", "role", content.alias("content"))
    whole = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("_all"))
    return whole.select("conv_id", F.transform("_all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def conversation_prefix(
    df: DataFrame, system: str | None = None, suffix: str | None = None, out: str = "prefix", asked: DataFrame | None = None
) -> DataFrame:
    """Messages up to and including each turn, as an ordered array of role and content.

    Prefixes travel as references beside the conversation stored once; their messages are cut
    out last, for the references in `asked` (all by default), so what is shuffled follows the
    conversations and not the square of their lengths. `system` puts a system message first.
    """
    refs = prefix_references(df) if asked is None else asked
    prefix = F.slice("messages", F.lit(1), F.col("n_messages").cast("int"))
    if system is not None:
        prefix = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), prefix)
    return refs.join(stored_conversations(df, suffix), "conv_id").select("conv_id", "turn", "role", prefix.alias(out))


def prefix_text(prefix: Column | str) -> Column:
    """Prefix array as `User: …` / `Assistant: …` lines."""
    return F.array_join(
        F.transform(
            prefix,
            lambda m: F.concat(
                F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), m["content"]
            ),
        ),
        "\n",
    )


def drop_blocked(df: DataFrame, marker: str) -> DataFrame:
    """Conversations whose first message or any assistant message holds the marker are left out."""
    hit = F.col("text").contains(marker)
    first = F.min_by(hit, "turn")
    blocked = (
        df.groupBy("conv_id")
        .agg(first.alias("_first"), F.bool_or(hit & (F.col("role") == "assistant")).alias("_any"))
        .filter("_first OR _any")
        .select("conv_id")
    )
    return df.join(blocked, "conv_id", "left_anti")
