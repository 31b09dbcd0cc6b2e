"""Readers and writers of the stored records.

Line-oriented JSON is the interchange form, parquet the working form. Nothing
reads a whole file into one row: line files are split, and order inside a file
is taken from the split offset and the row index in the split.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from verdictlake import schemas
from verdictlake.operators.ranking import first_n
from verdictlake.scale import latest_per_key, shared_folder, write_through


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- conversations -------------------------------------------------------------------------


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation records; the record's own values overwrite the same metadata keys."""
    raw = spark.read.schema(schemas.CONVERSATION).json(path)
    lifted = ("task_name", "model_name", "system_prompt_name", "conversation_id", "timestamp")
    metadata = F.col("metadata")
    for name in lifted:
        metadata = metadata.withField(name, F.coalesce(F.col(name), F.col(f"metadata.{name}")))
    return raw.withColumn(
        "metadata", F.when(F.col("metadata").isNull(), _record_metadata(lifted)).otherwise(metadata)
    )


def _record_metadata(lifted: tuple[str, ...]):
    fields = _parse_datatype_string("m " + schemas.METADATA)["m"].dataType.fields
    return F.struct(*[
        (F.col(f.name) if f.name in lifted else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def nest_turns(turns: DataFrame) -> DataFrame:
    """Flat turns to one row per conversation, messages in order.

    The record format holds a conversation in one line, so this is for writing
    that format; analysis stays on the flat form.
    """
    message = F.struct(
        F.col("turn").alias("turn_index"), "role", F.col("text").alias("content")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("t")).select(
        F.col("conv_id").alias("conversation_id"),
        F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                            m["turn_index"].alias("turn_index"))).alias("turns"),
    )


def flatten_turns(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn (stored index, else position), role, text."""
    return conversations.select(
        F.col("conversation_id").alias("conv_id"), F.posexplode("turns").alias("pos", "t")
    ).select(
        "conv_id", F.coalesce("t.turn_index", F.col("pos").cast("bigint")).alias("turn"),
        F.col("t.role").alias("role"), F.col("t.content").alias("text"),
    )


def write_conversations(
    conversations: DataFrame, path: str, mode: str = "overwrite",
    task_name: str | None = None, model_name: str | None = None,
) -> None:
    """Write conversation records; ids are the caller's, so appending never repeats them."""
    out = conversations
    for name, value in (("task_name", task_name), ("model_name", model_name)):
        if value is not None:
            out = out.withColumn(name, F.lit(value))
    out.write.mode(mode).json(path)


def attach_metadata(conversations: DataFrame, metadata: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Give every conversation its metadata row; the two must match one to one."""
    left, right = conversations.select(key), metadata.select(key)
    counts = (
        left.select(key, F.lit(1).alias("c"), F.lit(0).alias("m"))
        .unionByName(right.select(key, F.lit(0).alias("c"), F.lit(1).alias("m")))
        .groupBy(key).agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
        .filter("c <> 1 OR m <> 1")
    )
    if not counts.isEmpty():
        raise ValueError("metadata must have exactly one row per conversation")
    return conversations.join(metadata, key)


# ---- evaluations, claims -------------------------------------------------------------------


def read_evaluations(
    spark: SparkSession, path: str, strict: bool = True, tagged_only: bool = True
) -> DataFrame:
    """Evaluation records. Not strict: malformed lines and rows without keys are left out."""
    if strict:
        rows = spark.read.schema(schemas.EVALUATION).option("mode", "FAILFAST").json(path)
    else:
        rows = (
            spark.read.schema(schemas.EVALUATION + ", _corrupt_record STRING")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
            .filter("_corrupt_record IS NULL AND conversation_id IS NOT NULL AND score IS NOT NULL")
            .drop("_corrupt_record")
        )
    return rows.filter("_type = 'evaluation_result'") if tagged_only else rows


def write_evaluations(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = ()
) -> None:
    """Partition by task and model where a table holds several, so a report reads only its own files."""
    writer = df.withColumn("_type", F.lit("evaluation_result")).write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def nest_evaluations(conversations: DataFrame, judgments: DataFrame) -> DataFrame:
    """One evaluation record per conversation: score, counts and its judged claims in (turn, claim_idx) order.

    A conversation without claims scores 1 and has an empty list. Columns of `judgments` that
    the record has no field for are left out; a record holds all claims of its conversation.
    """
    known = schemas.judgment_fields()
    own = [c for c in judgments.columns if c in known]
    of_claim = [F.col(c).cast("string").alias(c) for c in judgments.columns if c in schemas.CLAIM_FIELDS]
    item = F.struct(*own, F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_idx"),
                    F.struct(*of_claim, F.col("turn").alias("turn_number")).alias("claim"))
    flags = [c for c in ("input_use_fallback", "judge_used_websearch_fallback", "snippets_only") if c in own]
    listed = F.sort_array(F.collect_list(F.struct("turn", "claim_idx", item.alias("item"))))
    per_conv = judgments.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(F.lower("hallucination") == "yes").alias("hallucinations"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in flags], F.transform(listed, lambda x: x["item"]).alias("claim_evaluations"))
    joined = conversations.select("conv_id").distinct().join(per_conv, "conv_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ["total_claims", "hallucinations", *[f"{c}_count" for c in flags]]}
    details = F.struct(*[v.alias(c) for c, v in counts.items()], F.coalesce("claim_evaluations", F.array()).alias("claim_evaluations"))
    bad, total = counts["hallucinations"], counts["total_claims"]
    return joined.select(
        F.col("conv_id").alias("conversation_id"), F.when(total > 0, 1.0 - bad / total).otherwise(F.lit(1.0)).alias("score"),
        F.when(total > 0, F.format_string("Found %d/%d hallucinated claims", bad, total)).otherwise(
            F.lit("No claims")).alias("reasoning"), details.alias("details"))


def claims_of_evaluations(evaluations: DataFrame) -> DataFrame:
    """One row per judged claim of the records: from `facts` where a record has them, else `claim_evaluations`.

    A missing turn falls back to the claim's own and then to 0, a missing reference name to the
    claim's, a missing language to the conversation's. `claim_key` is the claim id, or, without one, turn,
    package or authors, and code or year.
    """
    listed = F.coalesce("details.facts", "details.claim_evaluations")
    rows = evaluations.select(
        F.col("conversation_id").alias("conv_id"), F.col("metadata.language").alias("_language"), F.posexplode(listed).alias("claim_idx", "e"))
    shared = {"reference_name", "language"}
    turn = F.coalesce("e.turn_idx", "e.claim.turn_number", F.lit(0)).cast("bigint")

    def filled(*names: str):
        return F.coalesce(*[F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names], F.lit(""))

    pieces = F.concat_ws("|", turn.cast("string"), filled("claim.package_name", "claim.claimed_authors"),
                         filled("claim.code_snippet", "claim.claimed_year"))
    return rows.select(
        "conv_id", turn.alias("turn"), F.col("claim_idx").cast("bigint").alias("claim_idx"),
        F.coalesce(F.nullif("e.claim_id", F.lit("")), pieces).alias("claim_key"),
        *[F.col(f"e.{c}").alias(c) for c in schemas.judgment_fields() if c not in shared],
        F.coalesce("e.reference_name", "e.claim.reference_name").alias("reference_name"),
        F.coalesce("e.claim.language", "_language").alias("language"),
        *[F.col(f"e.claim.{c}").alias(c) for c in schemas.CLAIM_FIELDS if c not in shared])


def write_extractions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    df.withColumn("_type", F.lit("extraction_result")).write.mode(mode).format(fmt).save(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLAIM).json(path)


def write_claims(claims: DataFrame, path: str, mode: str = "append") -> None:
    claims.write.mode(mode).json(path)


# ---- line files ----------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with `file`, and `at`, a value that orders lines inside their file."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("at"),
    )


def read_valid_prefix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of each JSON line file up to its first corrupt line (an interrupted write)."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    first_bad = (
        lines.filter(F.try_parse_json("value").isNull()).groupBy("file").agg(F.min("at").alias("bad_at"))
    )
    kept = lines.join(first_bad, "file", "left").filter("bad_at IS NULL OR at < bad_at")
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; blank lines and # comments are left out."""
    return clean_lines(spark.read.text(path))


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    trimmed = F.btrim(column, F.lit(" \t\r\n"))
    return lines.withColumn(column, trimmed).filter((F.col(column) != "") & ~F.col(column).startswith("#"))


def write_study_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True).csv(path)


def read_study_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, whose quoted fields may hold line breaks; a file is read by many tasks.

    A line begins a record if an even number of quotes stands before it in its file. Quotes are
    counted per split, and the parity before each split follows from the splits before it (one
    row per split). Lines that are a record by themselves stay where they are; only records of
    several lines, cut at a split's edge or not, are joined. Columns stand in the schema's order.
    """
    split = ["_file", "_block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value", (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("_quotes"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy(*split).agg(F.sum("_quotes").alias("_sum")).select(
        *split, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy(*split).orderBy("_line")
    before = F.coalesce(F.sum("_quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per split of the input: a few bytes for each 128 MB.
    opened = lines.join(F.broadcast(offsets), split).withColumn("_opens", (F.col("_before") + before) % 2 == 0)
    marked = write_through(opened.select(
        *split, "_line", "value", (F.col("_block") == 0) & (F.row_number().over(order) == 1),
        F.col("_opens") & F.coalesce(F.lead("_opens").over(order), F.lit(False)),
        F.last(F.when(F.col("_opens"), F.col("_line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).toDF(
            *split, "_line", "value", "_header", "_alone", "_start"))
    ends = marked.groupBy(*split).agg(F.max("_start").alias("_last"))
    handed = ends.select(*split, F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
    joined = marked.filter("NOT _alone").join(F.broadcast(handed), split).groupBy("_file", F.coalesce("_start", "_handed").alias("_at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))), lambda r: r["value"]), "\n").alias("value"),
        F.bool_or("_header").alias("_header"))
    records = marked.filter("_alone").select("value", "_header").unionByName(joined.select("value", "_header"))
    whole = F.regexp_replace("value", r"\r\z", "")
    return records.filter(~F.col("_header")).filter(whole != "").select(
        F.from_csv(whole, F.lit(schema), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank rows, size and modification time of every line file, newest first."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"), "value",
        )
        .groupBy("file", "name", "size", "modified")
        .agg(F.count_if(F.trim("value") != "").alias("entries"))
        .orderBy(F.desc("modified"), "name")
    )


def latest_snapshot(spark: SparkSession, pattern: str, schema: str = schemas.CONVERSATION) -> DataFrame:
    """All rows of the newest snapshot matching the pattern, by time, then name.

    A snapshot is a file or a folder of part files whose path the pattern matches. Only the
    file list is read to choose it.
    """
    name = re.escape(pattern.rstrip("/").split(":", 1)[-1].lstrip("/")).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    files = spark.read.format("binaryFile").load(pattern).select(
        F.regexp_extract("path", f"^(.*?/{name})(?:/[^/]*)*$", 1).alias("snapshot"), "modificationTime")
    newest = files.groupBy("snapshot").agg(F.max("modificationTime").alias("at")).agg(
        F.max(F.struct("at", "snapshot")).alias("n")).first()["n"]
    return spark.read.schema(schema).json(newest["snapshot"])


def skip_covered(items: DataFrame, covered: DataFrame, position: str) -> DataFrame:
    """Items whose 0-based input position lies past what the snapshot already covers."""
    done = covered.agg(F.count(F.lit(1))).scalar()
    return items.filter(F.col(position) >= done)


# ---- record conversions --------------------------------------------------------------------


def normalize_extractions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy extraction rows to one claim per row, plus one row of counts.

    Rows that already hold one claim pass through; rows of neither form are counted as skipped.
    """
    is_legacy = F.coalesce(
        (F.col("_type") == "extraction_result") & F.col("extracted_claims").isNotNull(), F.lit(False)
    )
    is_claim = ~is_legacy & F.col("claim_id").isNotNull() & F.col("data").isNotNull()
    marked = df.withColumn("_legacy", is_legacy).withColumn("_claim", is_claim)

    human = ("human_reference_grounding", "human_content_grounding", "human_comment")
    exploded = marked.filter("_legacy").select(
        F.coalesce("conversation_id", "conv_idx", F.lit(0)).cast("bigint").alias("conversation_id"),
        F.coalesce("turn_number", F.lit(1)).cast("bigint").alias("turn_number"),
        F.coalesce("original_statement", F.lit("")).alias("original_statement"),
        F.posexplode("extracted_claims").alias("pos", "c"), "metadata",
    )
    data = F.struct(*[
        F.coalesce(F.col(f"c.{f}"), F.lit("")).alias(f) if f in schemas.LEGACY_FIELDS and f not in human
        else F.col(f"c.{f}").alias(f) if f in human
        else F.col("original_statement").alias(f) if f == "original_statement"
        else F.lit(None).cast("string").alias(f)
        for f in schemas.CLAIM_FIELDS
    ], F.col("c.not_a_claim").alias("not_a_claim"))
    new_id = F.md5(F.concat_ws(":", "conversation_id", "turn_number", "pos", "c.claimed_content"))
    legacy = exploded.select(
        new_id.alias("claim_id"), "conversation_id", "turn_number", data.alias("data"), "metadata"
    )
    through = marked.filter("_claim").select("claim_id", "conversation_id", "turn_number", "data", "metadata")
    claims = legacy.unionByName(through).orderBy("conversation_id", "turn_number", "claim_id")

    def annotated(row) -> F.Column:
        return row[human[0]].isNotNull() | row[human[1]].isNotNull() | row[human[2]].isNotNull()

    stats = marked.agg(
        F.count(F.lit(1)).alias("input_lines"),
        F.count_if("_legacy").alias("extraction_results"),
        F.coalesce(F.sum(F.when(F.col("_legacy"), F.size("extracted_claims"))
                         .when(F.col("_claim"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("claims_converted"),
        F.count_if(~F.col("_legacy") & ~F.col("_claim")).alias("skipped_lines"),
        F.coalesce(F.sum(F.when(F.col("_legacy"), F.size(F.filter("extracted_claims", annotated)))
                         .when(F.col("_claim") & annotated(F.col("data")), 1).otherwise(0)),
                   F.lit(0)).cast("bigint").alias("human_annotations_preserved"),
    )
    return claims, stats


def latest_annotations(log: DataFrame, order: str = "seq") -> DataFrame:
    """Current state of an append-only annotation log: the last row of a turn wins, empty deletes."""
    return latest_per_key(log, ["conv_idx", "turn_number"], [order]).filter(F.size("extracted_claims") > 0)


def load_questions(
    sources: dict[str, DataFrame], order: str, categories: list[str] | None = None,
    n_per_source: int | None = None,
) -> DataFrame:
    """Questions of several sources: category filter, first n of each, in one table."""
    parts = []
    for name, source in sources.items():
        part = source.filter(F.col("question_category").isin(categories)) if categories else source
        part = first_n(part, [order], n_per_source) if n_per_source is not None else part
        parts.append(part.withColumn("origin", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("question_category", F.coalesce("question_category", F.lit("Unknown")))


def extract_report_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Claims shown in HTML reports: title, claim text, badges and reasoning of each item.

    A page is cut at every item's opening mark, and each field is read by its own element;
    items that lack one of the four are left out.
    """
    # The markup of a report item.
    opening = '<div class="result-item">'
    elements = {"fact_id": "<h4>", "claim_text": '<div class="claim-text">', "badges": '<div class="status-badges">',
                "reasoning": '<div class="reasoning">'}
    badge = '<span class="badge'

    def after(whole, mark: str, end: str) -> F.Column:
        rest = F.split_part(whole, F.lit(mark), F.lit(2))
        return F.split_part(rest, F.lit(end), F.lit(1))

    def bare(c) -> F.Column:
        return F.btrim(F.regexp_replace(c, "<[^>]+>", ""), F.lit(" \t\r\n"))

    def badge_text(part) -> F.Column:
        inside = F.split_part(part, F.lit("</span>"), F.lit(1))
        return bare(F.substr(inside, F.locate(">", inside) + F.lit(1)))

    cut = F.split(html, opening, -1)
    items = pages.select(key, F.posexplode(F.filter(
        F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))),
        lambda i: reduce(lambda a, b: a & b, [F.contains(i, F.lit(m)) for m in elements.values()]))).alias("pos", "i"))
    fields = {n: after(F.col("i"), m, "</h4>" if m == "<h4>" else "</div>") for n, m in elements.items()}
    badges = F.split(fields["badges"], badge, -1)
    return items.select(
        key, F.col("pos").cast("bigint").alias("item_idx"),
        F.btrim(fields["fact_id"], F.lit(" \t\r\n")).alias("fact_id"),
        bare(fields["claim_text"]).alias("claim_text"),
        F.transform(F.slice(badges, F.lit(2), F.greatest(F.size(badges) - 1, F.lit(0))), badge_text).alias("badges"),
        bare(fields["reasoning"]).alias("reasoning"))
