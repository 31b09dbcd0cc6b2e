"""A directly judged run from raw answers to its report: parsed, scored, listed as claims, stored as records, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.functions.parse import parse_turn_verdicts
from verdictlake.operators import metrics as M
from verdictlake.operators.setops import verdicts_to_claims
from verdictlake.scale import write_through
from verdictlake.sources import files

KINDS = ("import", "install", "function")


def direct_records(convs: DataFrame, answers: DataFrame, response: str = "response") -> DataFrame:
    """One evaluation record per conversation from the judge's raw answer to each turn.

    Answers are parsed once and written; scores and sentence come from the turns, the listed
    claims from their items, so a turn that is found wrong without an item counts as a turn
    only. A conversation without answers has a record without claims.
    """
    verdicts = write_through(parse_turn_verdicts(answers, response))
    scored = M.direct_reasoning(M.score_direct(convs.select("conv_id").distinct(), verdicts))
    # A turn's items stand in one row, so a turn's claims are bounded by one answer.
    place = Window.partitionBy("conv_id", "turn").orderBy("element_type", "package_name", "function_name", "claim_id")
    claims = verdicts_to_claims(verdicts).withColumn("claim_idx", (F.row_number().over(place) - 1).cast("bigint"))
    nested = files.nest_evaluations(convs, claims).select("conversation_id", "details")
    turns = scored.select(F.col("conv_id").alias("conversation_id"), "score", "reasoning", F.struct(
        "total_turns", F.col("total_turns").alias("total_responses"), F.col("turns_with_hallucinations").alias("overall_hallucinated_responses"),
        *[F.col(f"{k}_hallucinations").alias(f"{k}_hallucinated_responses") for k in KINDS]).alias("_t"))
    fields = ["total_turns", "total_responses", "overall_hallucinated_responses", *[f"{k}_hallucinated_responses" for k in KINDS]]
    joined = nested.join(turns, "conversation_id")
    return joined.select("conversation_id", "score", "reasoning", F.struct(
        "details.total_claims", "details.hallucinations", *[F.col(f"_t.{f}").alias(f) for f in fields], "details.claim_evaluations").alias("details"))


def run_direct(spark: SparkSession, convs: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """Judge a run directly, store its records as JSON lines at `path` and give them back as read."""
    files.write_evaluations(direct_records(convs, answers), path, "json")
    return files.read_evaluations(spark, path)


def direct_report(records: DataFrame) -> DataFrame:
    """Totals and rates of stored records in one row: responses from the turns, claims from the list, conversations by kind."""
    names = ("overall", *KINDS)
    claims = F.col("details.claim_evaluations")
    per = records.select(
        "score", F.col("details.total_responses").alias("total_responses"), *[F.col(f"details.{k}_hallucinated_responses").alias(k) for k in names],
        F.size(claims).cast("bigint").alias("_claims"), F.size(F.filter(claims, lambda c: F.lower(c["hallucination"]) == "yes")).cast("bigint").alias("_bad"))

    def total(c) -> F.Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    out = per.agg(
        F.count(F.lit(1)).alias("total_conversations"), total("total_responses").alias("total_responses"),
        *[total(k).alias(f"{k}_hallucinated_responses") for k in names], *[F.count_if(F.col(k) > 0).alias(f"conversations_with_{k}") for k in KINDS],
        total("_claims").alias("total_claims"), total("_bad").alias("hallucinated_claims"), F.coalesce(F.avg("score"), F.lit(1.0)).alias("mean_score"))
    for k in names:
        out = out.withColumn(f"{k}_hallucination_rate", L.rate(F.col(f"{k}_hallucinated_responses"), F.col("total_responses")))
    return out.withColumn("claim_level_hallucination_rate", L.rate(F.col("hallucinated_claims"), F.col("total_claims")))
