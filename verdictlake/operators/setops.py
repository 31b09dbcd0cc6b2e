"""Unions and reshaping of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.labels import text
from verdictlake.operators.metrics import score_conversations


def merge_judgments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cached and new judgments, one per claim; a new one replaces the cached one."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    keys = ["conv_id", "claim_id"]
    rest = [c for c in both.columns if c not in (*keys, "_age")]
    # One side may hold a claim twice; then the content decides, the same way in every run.
    order = F.struct("_age", F.xxhash64(F.to_json(F.struct(*rest))))
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return latest.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*old.columns)


def merge_results(convs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Conversation scores over cached and new judgments together, so no conversation appears twice."""
    return score_conversations(convs, merge_judgments(old, new))


def append_conversations(existing: DataFrame, generated: DataFrame) -> DataFrame:
    return existing.unionByName(generated, allowMissingColumns=True)


def verdicts_to_claims(verdicts: DataFrame) -> DataFrame:
    """Turn verdicts as claim rows: one per hallucinated item, or one verified row for a clean turn."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    name = "turn-"

    def items(column: str, kind: str, tag: str) -> Column:
        def row(e: Column) -> Column:
            package = F.coalesce(e["package"], F.lit("unknown"))
            function = F.coalesce(e["function"], F.lit("unknown"))
            tail = [F.lit("-"), function] if kind == "function_call" else []
            return F.struct(
                F.concat(F.lit(name), conv, F.lit("-"), turn, F.lit(f"-{tag}-"), package, *tail).alias("claim_id"),
                F.lit("Yes").alias("hallucination"), F.lit(kind).alias("element_type"), package.alias("package_name"),
                (function if kind == "function_call" else F.lit(None).cast("string")).alias("function_name"),
                text(e["code"]).alias("code_snippet"), F.coalesce(e["reason"], text("reasoning")).alias("reason"))
        return F.transform(F.coalesce(F.col(column), F.array()), row)

    found = F.concat(
        items("hallucinated_imports", "import", "import"), items("hallucinated_installs", "install", "install"),
        items("hallucinated_function_calls", "function_call", "function"))
    none = F.lit(None).cast("string")
    verified = F.array(F.struct(
        F.concat(F.lit(name), conv, F.lit("-"), turn, F.lit("-verified")).alias("claim_id"),
        F.lit("No").alias("hallucination"), F.lit("unknown").alias("element_type"), none.alias("package_name"),
        none.alias("function_name"), none.alias("code_snippet"),
        F.coalesce("reasoning", F.lit("All packages and API calls verified")).alias("reason")))
    rows = F.when(F.coalesce("has_hallucination", F.lit(False)), found).otherwise(verified)
    out = verdicts.select("conv_id", "turn", F.explode(rows).alias("r")).select("conv_id", "turn", "r.*")
    kind = F.col("element_type")
    return out.withColumns({
        "hallucinated_import_detected": kind == "import", "hallucinated_install_detected": kind == "install",
        "hallucinated_function_usage_detected": kind == "function_call"})
