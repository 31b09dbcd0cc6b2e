"""Work lists: what is cached, judged, complete, annotated; and lookups along the way."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions.claims import fill_template
from verdictlake.operators.text import has_version, package_key


def restrict_claims(claims: DataFrame, convs: DataFrame) -> DataFrame:
    """Cached claims of the current conversations."""
    return claims.join(convs.select("conv_id"), "conv_id", "left_semi")


def unjudged(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """Claims without a judgment. Claim ids are whole 128-bit digests, so they name a claim alone."""
    return claims.join(judgments.select("claim_id"), "claim_id", "left_anti")


def unextracted(convs: DataFrame, claims: DataFrame) -> DataFrame:
    """Conversations without any cached claim."""
    return convs.join(claims.select("conv_id"), "conv_id", "left_anti")


def incomplete(
    convs: DataFrame, claims: DataFrame, judgments: DataFrame, evaluated: DataFrame | None = None
) -> DataFrame:
    """Conversations with no judgment, or with fewer judgments than extracted claims.

    `evaluated` names conversations that have a result; one without claims is complete then.
    """
    expected = claims.groupBy("conv_id").agg(F.count("*").alias("expected"))
    judged = judgments.groupBy("conv_id").agg(F.count("*").alias("judged"))
    counted = convs.join(expected, "conv_id", "left").join(judged, "conv_id", "left")
    counted = counted.withColumns({
        "expected": F.coalesce("expected", F.lit(0)).cast("bigint"),
        "judged": F.coalesce("judged", F.lit(0)).cast("bigint")})
    short = F.expr("expected > 0 AND judged < expected")
    if evaluated is None:
        return counted.filter((F.col("judged") == 0) | short)
    has_result = evaluated.select("conv_id").distinct().withColumn("_result", F.lit(True))
    marked = counted.join(has_result, "conv_id", "left")
    return marked.filter(F.col("_result").isNull() | short).drop("_result")


def attach_pdfs(content: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page contents with the claim's converted PDFs appended, and per claim whether all PDFs came.

    `content` has one row per source (claim_id, source_idx, title, url, content) and `expected`;
    `pdfs` one row per result (claim_id, pdf_idx, url, content, success). Failed or empty PDFs add no row.
    """
    expected = content.groupBy("claim_id").agg(F.max("expected").alias("expected"),
                                               F.max("source_idx").alias("_last"))
    received = pdfs.groupBy("claim_id").agg(F.count("*").alias("received"))
    status = expected.join(received, "claim_id", "left").select(
        "claim_id", "expected", F.coalesce("received", F.lit(0)).cast("bigint").alias("received"), "_last"
    ).withColumn("complete", F.col("received") >= F.col("expected"))
    usable = pdfs.filter(F.col("success") & (F.coalesce("content", F.lit("")) != ""))
    added = usable.join(status.select("claim_id", "_last"), "claim_id").select(
        "claim_id", (F.col("_last") + 1 + F.col("pdf_idx")).cast("bigint").alias("source_idx"),
        F.lit("PDF").alias("title"), "url", "content")
    rows = content.select("claim_id", F.col("source_idx").cast("bigint").alias("source_idx"), "title", "url", "content")
    return rows.unionByName(added), status.drop("_last")


# ---- known packages ------------------------------------------------------------------------


def python_stdlib(spark: SparkSession) -> DataFrame:
    """Standard library modules of the running Python, as importable names."""
    names = sorted(n for n in sys.stdlib_module_names if not n.startswith("_"))
    return package_table(spark, [(n, False, "Python") for n in names])


def package_table(spark: SparkSession, rows: Sequence[tuple[str, bool, str]]) -> DataFrame:
    """Caller-listed packages as (package, installable, language)."""
    frame = pd.DataFrame(rows, columns=["package", "installable", "language"])
    # Through Arrow this stays a local relation, so counting and broadcasting it starts no Python.
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark.createDataFrame(frame, "package STRING, installable BOOLEAN, language STRING")


def match_known_packages(claims: DataFrame, whitelist: DataFrame, by_language: bool = False) -> DataFrame:
    """Add `package_key` and `known`: the claim's package is on the list for its element type.

    Installs match installable packages only and never when a version is asked for;
    imports match every listed package, whatever the language unless `by_language`.
    """
    keys = ["package_key"] + (["language"] if by_language else [])
    listed = whitelist.select(package_key("package").alias("package_key"), "installable", *keys[1:]).groupBy(*keys).agg(
        F.bool_or("installable").alias("_installable"))
    keyed = claims.withColumn("package_key", package_key("package_name"))
    joined = keyed.join(listed, keys, "left")
    kind = F.col("element_type")
    known = F.when(kind == "import", F.col("_installable").isNotNull()).when(
        kind == "install", F.coalesce("_installable", F.lit(False)) & ~has_version("code_snippet")).otherwise(False)
    return joined.withColumn("known", known).select(*claims.columns, "package_key", "known")


# ---- prompts -------------------------------------------------------------------------------


def prompt_grid(
    tasks: DataFrame, languages: Sequence[str], templates: Sequence[str], task: str = "task"
) -> DataFrame:
    """Every task in every language and template. The two lists are parameters, so this is a map over tasks."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(lang).alias("language"), F.lit(k).cast("bigint").alias("template_id"), F.lit(t).alias("prompt_template"))
        for lang in languages for k, t in enumerate(templates)]))
    return tasks.withColumn("_cell", cells).select(*tasks.columns, "_cell.*").withColumn(
        "prompt", fill_template("prompt_template", {"language": F.col("language"), "task": F.col(task)}))


# ---- names and progress --------------------------------------------------------------------


def author_matches(df: DataFrame) -> DataFrame:
    """One row per predicted name, with whether it was matched and the match rate of its conversation."""
    n_pred = F.coalesce("predicted_count", F.size("predicted_names"))
    n_match = F.coalesce("matches", F.size("matched_names"))
    share = F.when(n_pred > 0, n_match / n_pred).otherwise(F.lit(0.0))
    unsure = F.exists("matched_names", lambda n: n.isNull())
    named = df.select("conv_id", F.col("matched_names").isNotNull().alias("_told"), unsure.alias("_unsure"), share.alias("match_rate"),
                      F.explode("predicted_names").alias("name"))
    # One lookup by (conversation, name) instead of a scan of all matches for every name.
    found = df.select("conv_id", F.explode("matched_names").alias("name")).filter("name IS NOT NULL").distinct().withColumn("_found", F.lit(True))
    matched = F.when(~F.col("_told") | F.col("name").isNull(), F.lit(None)).when(F.col("_found"), True).when(F.col("_unsure"), F.lit(None)).otherwise(False)
    return named.join(found, ["conv_id", "name"], "left").select("conv_id", "name", matched.alias("matched"), "match_rate")


def next_unannotated(turns: DataFrame, state: DataFrame, keys: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """First turn in order that has no claims yet; one row, or a row of nulls when all are done."""
    open_turns = turns.select(*keys).join(state.select(*keys), list(keys), "left_anti")
    first: Column = F.min(F.struct(*keys))
    return open_turns.agg(first.alias("f"), F.count("*").alias("remaining")).select("f.*", "remaining")
