"""Scores and report rates.

Everything is one or two grouped aggregations with conditional counts, so rows
are reduced map-side before any shuffle. Judgment columns are named as stored:
conv_id, turn, hallucination, abstention, verification_error, grounding texts
and the boolean flags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.functions.claims import ELEMENT_TYPES
from verdictlake.scale import first_n_by

IMPORT, INSTALL, FUNCTION = (
    "hallucinated_import_detected", "hallucinated_install_detected", "hallucinated_function_usage_detected",
)
FALLBACKS = ("input_use_fallback", "judge_used_websearch_fallback", "snippets_only")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _any_flag() -> Column:
    return _flag(IMPORT) | _flag(INSTALL) | _flag(FUNCTION)


def _bigint(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


# ---- conversation scores -------------------------------------------------------------------


def score_conversations(convs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Score per conversation; conversations without judged claims score 1.

    Failed verifications and skipped claims stay in the denominator here.
    """
    per = judgments.groupBy("conv_id").agg(
        F.count("*").alias("total_claims"),
        L.count_true(F.lower("hallucination") == "yes").alias("hallucinations"),
        *[L.count_true(_flag(f)).alias(f"{f}_count") for f in FALLBACKS],
    )
    counts = ["total_claims", "hallucinations", *[f"{f}_count" for f in FALLBACKS]]
    out = convs.join(per, "conv_id", "left")
    for name in counts:
        out = out.withColumn(name, _bigint(F.col(name)))
    return out.withColumn("score", F.lit(1.0) - L.rate(F.col("hallucinations"), F.col("total_claims"))).withColumn(
        "reasoning",
        F.when(F.col("total_claims") == 0, "No verifiable claims found").otherwise(
            F.concat(F.lit("Found "), F.col("hallucinations").cast("string"), F.lit("/"),
                     F.col("total_claims").cast("string"), F.lit(" hallucinated claims"))),
    )


KINDS = ("overall", "import", "install", "function")


def _turn_flags(judgments: DataFrame, by: Sequence[str]) -> DataFrame:
    return judgments.groupBy(*by).agg(
        F.bool_or(_flag(IMPORT)).alias("import"), F.bool_or(_flag(INSTALL)).alias("install"),
        F.bool_or(_flag(FUNCTION)).alias("function"), F.bool_or(_any_flag()).alias("overall"),
    )


def score_coding(convs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Response-level rates per conversation: flags are or-ed per turn, then turns are counted."""
    per = _turn_flags(judgments, ["conv_id", "turn"]).groupBy("conv_id").agg(
        F.count("*").alias("total_responses"),
        *[L.count_true(F.col(k)).alias(f"{k}_hallucinated_responses") for k in KINDS],
    )
    out = convs.join(per, "conv_id", "left").withColumn("total_responses", _bigint(F.col("total_responses")))
    for kind in KINDS:
        count = f"{kind}_hallucinated_responses"
        out = out.withColumn(count, _bigint(F.col(count)))
        out = out.withColumn(f"{kind}_hallucination_rate", L.rate(F.col(count), F.col("total_responses")))
    return out.withColumn("score", F.lit(1.0) - F.col("overall_hallucination_rate"))


def coding_reasoning(scored: DataFrame) -> DataFrame:
    """Add the sentence that states the response rates of a conversation."""
    def part(kind: str) -> Column:
        count = F.col(f"{kind}_hallucinated_responses")
        return F.when(count > 0, F.concat(
            F.lit(f"{kind.capitalize()}: "), count.cast("string"), F.lit("/"),
            F.col("total_responses").cast("string"), F.lit(" ("),
            _percent(F.col(f"{kind}_hallucination_rate")), F.lit(")")))
    rates = F.concat(F.lit("Response hallucination rates - "), F.concat_ws("; ", *[part(k) for k in KINDS]))
    clean = F.concat(F.lit("No hallucinations detected in "), F.col("total_responses").cast("string"),
                     F.lit(" responses"))
    return scored.withColumn(
        "reasoning", F.when(F.col("overall_hallucinated_responses") > 0, rates).otherwise(clean))


def score_coding_legacy(convs: DataFrame, turn_results: DataFrame) -> DataFrame:
    """One row per judged turn in; counts, rates and the list of kinds found per conversation."""
    per = turn_results.groupBy("conv_id").agg(
        F.count("*").alias("total_responses"),
        L.count_true(_any_flag()).alias("overall_hallucinated_count"),
        L.count_true(_flag(IMPORT)).alias("import_hallucinated_count"),
        L.count_true(_flag(INSTALL)).alias("install_hallucinated_count"),
        L.count_true(_flag(FUNCTION)).alias("function_hallucinated_count"),
    )
    out = convs.join(per, "conv_id", "left").withColumn("total_responses", _bigint(F.col("total_responses")))
    for kind in KINDS:
        count = f"{kind}_hallucinated_count"
        out = out.withColumn(count, _bigint(F.col(count)))
        out = out.withColumn(f"{kind}_hallucination_rate", L.rate(F.col(count), F.col("total_responses")))
    named = (("import", "import"), ("install", "install"), ("function", "function_usage"))
    types = F.array_compact(F.array(*[
        F.when(F.col(f"{kind}_hallucinated_count") > 0, F.lit(label)) for kind, label in named]))
    return (
        out.withColumn("hallucination_types", types)
        .withColumn("num_hallucination_types", F.size("hallucination_types").cast("bigint"))
        .withColumn("score", F.lit(1.0) - F.col("overall_hallucination_rate"))
    )


def legacy_reasoning(scored: DataFrame) -> DataFrame:
    """Add the sentence that states the rates of `score_coding_legacy`."""
    def part(kind: str) -> Column:
        return F.concat(
            F.lit(f"{kind.capitalize()}: "), F.col(f"{kind}_hallucinated_count").cast("string"), F.lit("/"),
            F.col("total_responses").cast("string"), F.lit(" ("), _percent(F.col(f"{kind}_hallucination_rate")), F.lit(")"))
    return scored.withColumn(
        "reasoning",
        F.when(F.col("total_responses") == 0, "No responses to evaluate")
        .when(F.col("overall_hallucinated_count") == 0, "No hallucinations detected")
        .otherwise(F.concat_ws(" | ", *[part(k) for k in KINDS])))


def score_direct(convs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Turn-level verdicts to conversation scores with a short list of issues.

    Issues: at most two of each kind per turn; the first three of the conversation
    are named and the rest counted. Only three are ever carried per conversation.
    """
    kinds = (
        ("hallucinated_imports", lambda e: F.concat(_named(e["package"]), F.lit(" import"))),
        ("hallucinated_installs", lambda e: F.concat(_named(e["package"]), F.lit(" install"))),
        ("hallucinated_function_calls",
         lambda e: F.concat(_named(e["package"]), F.lit("."), _named(e["function"]), F.lit("()"))),
    )
    has = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c, _ in kinds}
    issues = F.flatten(F.array(*[
        F.transform(F.slice(F.coalesce(F.col(c), F.array()), 1, 2), show) for c, show in kinds]))
    turned = verdicts.select(
        "conv_id", "turn", F.coalesce("has_hallucination", F.lit(False)).alias("_has"),
        *[has[c].alias(f"_{k}") for k, (c, _) in enumerate(kinds)], issues.alias("_issues"),
    )
    per = turned.groupBy("conv_id").agg(
        F.count("*").alias("total_turns"), L.count_true(F.col("_has")).alias("turns_with_hallucinations"),
        L.count_true(F.col("_0")).alias("import_hallucinations"),
        L.count_true(F.col("_1")).alias("install_hallucinations"),
        L.count_true(F.col("_2")).alias("function_hallucinations"),
        F.sum(F.size("_issues")).alias("_n_issues"),
    )
    # A turn gives at least one issue, so the first three issues lie in the first three such turns.
    leading = first_n_by(turned.filter(F.size("_issues") > 0), ["conv_id"], ["turn"], 3)
    shown = leading.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "_issues"))).alias("_lead")
    ).select("conv_id", F.slice(F.flatten(F.transform("_lead", lambda t: t["_issues"])), 1, 3).alias("_shown"))
    out = convs.join(per, "conv_id", "left").join(shown, "conv_id", "left")
    for name in ("total_turns", "turns_with_hallucinations", "import_hallucinations", "install_hallucinations",
                 "function_hallucinations"):
        out = out.withColumn(name, _bigint(F.col(name)))
    more = F.when(F.col("_n_issues") > 3,
                  F.concat(F.lit(" (+"), (F.col("_n_issues") - 3).cast("string"), F.lit(" more)")))
    listed = F.concat(F.array_join("_shown", ", "), F.coalesce(more, F.lit("")))
    return (
        out.withColumn("issues", F.coalesce(listed, F.lit("")))
        .withColumn("score", F.lit(1.0) - L.rate(F.col("turns_with_hallucinations"), F.col("total_turns")))
        .drop("_n_issues", "_shown")
    )


def _named(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def direct_reasoning(scored: DataFrame) -> DataFrame:
    """Add the sentence summary of a directly judged conversation."""
    kinds = F.concat(
        F.lit(" ("), F.col("import_hallucinations").cast("string"), F.lit(" import, "),
        F.col("install_hallucinations").cast("string"), F.lit(" install, "),
        F.col("function_hallucinations").cast("string"), F.lit(" function)"))
    total = F.col("import_hallucinations") + F.col("install_hallucinations") + F.col("function_hallucinations")

    def counted(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    found = F.concat(counted(total, "hallucination"), kinds)
    verified = F.lit("All packages and API calls verified against official documentation")
    last = F.when(total == 0, verified).otherwise(
        F.when(F.col("issues") != "", F.concat(F.lit("Issues: "), F.col("issues"))))
    text = F.concat(
        F.concat_ws(". ", F.concat(F.lit("Evaluated "), counted(F.col("total_turns"), "turn")), found, last),
        F.lit("."))
    return scored.withColumn(
        "reasoning", F.when(F.col("total_turns") == 0, "No assistant turns found").otherwise(text))


# ---- grounding reports ---------------------------------------------------------------------


def _error() -> Column:
    return L.is_verification_error("verification_error")


def _failure_counts(valid: Column | None = None) -> list[Column]:
    ok = F.lit(True) if valid is None else valid
    return [
        L.count_true(ok & L.is_yes("hallucination")).alias("hallucinated_facts"),
        L.count_true(ok & L.reference_failed("reference_grounding")).alias("reference_failures"),
        L.count_true(ok & L.content_failed("content_grounding")).alias("content_failures"),
        L.count_true(ok & L.is_yes("abstention")).alias("abstentions"),
    ]


def _failure_rates(df: DataFrame) -> DataFrame:
    for out, part in (("hallucination_rate", "hallucinated_facts"), ("reference_failure_rate", "reference_failures"),
                      ("content_failure_rate", "content_failures"), ("abstention_rate", "abstentions")):
        df = df.withColumn(out, L.rate(F.col(part), F.col("total_facts")))
    return df


def grounding_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and rates over claims that were verified; failed verifications only counted."""
    ok = ~_error()
    out = df.groupBy(*by).agg(
        F.count("*").alias("total_facts"), L.count_true(_error()).alias("verification_errors"),
        L.count_true(ok).alias("valid_facts"),
        L.count_true(ok & L.is_yes("hallucination")).alias("hallucinated_facts"),
        *[L.count_true(ok & L.is_yes(f, numeric=True)).alias(f"{f}_count") for f in FALLBACKS],
    )
    valid = F.col("valid_facts")
    out = out.withColumn("hallucination_rate", L.rate(F.col("hallucinated_facts"), valid))
    for f in FALLBACKS:
        out = out.withColumn(f"{f}_rate", L.rate(F.col(f"{f}_count"), valid))
    return out


def grounding_by_turn(df: DataFrame, turn: str = "turn") -> DataFrame:
    """Failure counts and rates per turn over verified claims; a missing turn counts as 0."""
    verified = df.filter(~_error())
    grouped = verified.groupBy(F.coalesce(turn, F.lit(0)).cast("bigint").alias("turn"))
    return _failure_rates(grouped.agg(F.count("*").alias("total_facts"), *_failure_counts()))


def grounding_by_citations(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Failure counts per citation bucket; papers are counted from the conversations, with or without claims."""
    paper = F.coalesce("paper_title", F.col("conv_id").cast("string"))
    bucketed = meta.select("conv_id", L.citation_bucket("cited_by_count").alias("bucket"), paper.alias("_paper"))
    bucketed = bucketed.filter("bucket IS NOT NULL")
    papers = bucketed.groupBy("bucket").agg(F.count_distinct("_paper").alias("paper_count"))
    ok = ~_error()
    # Counted per conversation first, so a conversation with very many claims joins as one row.
    per_conv = df.groupBy("conv_id").agg(
        L.count_true(ok).alias("total_facts"), L.count_true(_error()).alias("verification_errors"),
        *_failure_counts(ok))
    counts = [c for c in per_conv.columns if c != "conv_id"]
    facts = per_conv.join(bucketed.select("conv_id", "bucket"), "conv_id").groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in counts])
    # Both buckets are always reported; at most one row per bucket on every side.
    names = F.explode(F.array(F.lit("low_citations"), F.lit("high_citations"))).alias("bucket")
    out = df.sparkSession.range(1).select(names).join(papers, "bucket", "left").join(facts, "bucket", "left")
    for name in ("paper_count", "total_facts", "verification_errors", "hallucinated_facts", "reference_failures",
                 "content_failures", "abstentions"):
        out = out.withColumn(name, _bigint(F.col(name)))
    return _failure_rates(out)


def author_totals(df: DataFrame) -> DataFrame:
    """Mean score and summed matches over author predictions, one row per category and one in all.

    `level` is 0 for a category row and 1 for the overall row.
    """
    predicted = F.coalesce("predicted_count", F.size("predicted_names")).cast("bigint")
    matched = F.coalesce("matches", F.size("matched_names")).cast("bigint")
    rows = df.select(F.coalesce("category", F.lit("Unknown")).alias("category"), "score",
                     predicted.alias("_p"), matched.alias("_m"))
    return rows.rollup("category").agg(
        F.grouping("category").cast("bigint").alias("level"), F.count("*").alias("conversations"),
        F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.sum("_m").alias("matches"),
        F.sum("_p").alias("predicted_count"),
    )


def author_names(df: DataFrame) -> DataFrame:
    """All predicted and matched names in order, one row per name; nothing is gathered in one row."""
    names = F.array(
        F.struct(F.lit("predicted").alias("kind"), F.col("predicted_names").alias("names")),
        F.struct(F.lit("matched").alias("kind"), F.col("matched_names").alias("names")))
    return df.select("conv_id", F.explode(names).alias("s")).select(
        "conv_id", "s.kind", F.posexplode("s.names").alias("pos", "name"))


# ---- coding reports ------------------------------------------------------------------------


def coding_facts(judgments: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Add `element_type` and `is_hallucinated` as the reports count them, and the language."""
    flags = (_flag(IMPORT), _flag(INSTALL), _flag(FUNCTION))
    out = judgments.withColumn("element_type", L.infer_element_type("element_type", *flags)).withColumn(
        "is_hallucinated", L.resolve_verdict("hallucination", *flags))
    if meta is not None:
        out = out.drop("language").join(meta.select("conv_id", "language"), "conv_id", "left").withColumn(
            "language", F.coalesce("language", F.lit("Unknown")))
    return out


def coding_totals(convs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Response-, claim- and conversation-level totals of the code task in one row."""
    scored = score_coding(convs, judgments)
    facts = coding_facts(judgments)
    per_conv = facts.groupBy("conv_id").agg(
        F.count("*").alias("_claims"), L.count_true(F.col("is_hallucinated")).alias("_bad"),
        L.count_true(F.lower("hallucination") == "skipped").alias("_skipped"),
    )
    both = scored.join(per_conv, "conv_id", "left")
    out = both.agg(
        F.count("*").alias("total_conversations"), F.sum("total_responses").alias("total_responses"),
        *[F.sum(f"{k}_hallucinated_responses").alias(f"{k}_hallucinated_responses") for k in KINDS],
        *[L.count_true(F.col(f"{k}_hallucinated_responses") > 0).alias(f"conversations_with_{k}")
          for k in KINDS[1:]],
        _bigint(F.sum("_claims")).alias("total_claims"), _bigint(F.sum("_bad")).alias("hallucinated_claims"),
        _bigint(F.sum("_skipped")).alias("skipped_claims"),
    )
    for kind in KINDS:
        out = out.withColumn(f"{kind}_hallucination_rate",
                             L.rate(F.col(f"{kind}_hallucinated_responses"), F.col("total_responses")))
    return out.withColumn(
        "claim_level_hallucination_rate", L.rate(F.col("hallucinated_claims"), F.col("total_claims"))
    ).withColumn("score", F.lit(1.0) - F.col("overall_hallucination_rate"))


def by_element_type(facts: DataFrame) -> DataFrame:
    """Claims, hallucinated claims and rate of each known element type, absent types as zero."""
    pairs = []
    for kind in ELEMENT_TYPES:
        pairs += [L.count_true(F.col("element_type") == kind).alias(f"{kind}_t"),
                  L.count_true((F.col("element_type") == kind) & F.col("is_hallucinated")).alias(f"{kind}_h")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("element_type"), F.col(f"{k}_t").alias("total"),
                 F.col(f"{k}_h").alias("hallucinated")) for k in ELEMENT_TYPES]))
    return facts.agg(*pairs).select(rows.alias("r")).select("r.*").withColumn(
        "hallucination_rate", L.rate(F.col("hallucinated"), F.col("total")))


def by_language(convs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Response totals and rates per language; `convs` carries conv_id and language."""
    scored = score_coding(convs, judgments)
    out = scored.groupBy(F.coalesce("language", F.lit("Unknown")).alias("language")).agg(
        F.sum("total_responses").alias("total_responses"),
        *[F.sum(f"{k}_hallucinated_responses").alias(f"{k}_hallucinated_responses") for k in KINDS])
    for kind in KINDS:
        out = out.withColumn(f"{kind}_hallucination_rate",
                             L.rate(F.col(f"{kind}_hallucinated_responses"), F.col("total_responses")))
    return out


def coding_by_turn(facts: DataFrame) -> DataFrame:
    """Per turn number: how many (conversation, turn) pairs hold a hallucination, by element type."""
    def hit(kind: str) -> Column:
        return F.bool_or(F.col("is_hallucinated") & (F.col("element_type") == kind))

    pairs = facts.groupBy("conv_id", F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn")).agg(
        F.bool_or("is_hallucinated").alias("overall"), hit("import").alias("import"),
        hit("install").alias("install"), hit("function_call").alias("function"))
    out = pairs.groupBy("turn").agg(
        F.count("*").alias("total_turns"), *[L.count_true(F.col(k)).alias(f"{k}_turns") for k in KINDS])
    for kind in KINDS:
        out = out.withColumn(f"{kind}_rate", L.rate(F.col(f"{kind}_turns"), F.col("total_turns")))
    return out


def hallucinated_segments(facts: DataFrame, by: str | None = None) -> DataFrame:
    """Hallucinated claims, one row each; with `by`, their count per group.

    The groups are not gathered into rows: filter or partition the segment table by the column.
    """
    found = facts.filter("is_hallucinated")
    if by is None:
        return found
    return found.groupBy(by).agg(F.count("*").alias("n_segments"))


# ---- summaries -----------------------------------------------------------------------------

USAGE_KEYS = ("input_tokens", "output_tokens", "total_tokens", "cached_tokens", "reasoning_tokens")


def usage_totals(df: DataFrame, by: Sequence[str], usage: str = "token_usage") -> DataFrame:
    """Sums of the known token counters of a usage map; other keys are ignored."""
    return df.groupBy(*by).agg(*[
        _bigint(F.sum(F.try_element_at(F.col(usage), F.lit(k)).cast("bigint"))).alias(k) for k in USAGE_KEYS])


def run_summary(scored: DataFrame) -> DataFrame:
    """Totals of a run over scored conversations."""
    out = scored.agg(F.count("*").alias("conversations"), _bigint(F.sum("total_claims")).alias("claims"),
                     _bigint(F.sum("hallucinations")).alias("hallucinations"))
    return out.withColumn("accuracy", F.lit(1.0) - F.col("hallucinations") / F.greatest("claims", F.lit(1)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def leaderboard(judgments: DataFrame, meta: DataFrame) -> DataFrame:
    """Grounding totals per model within task, ranked, with a rollup row per task and in all.

    `meta` carries conv_id, task and model_name. `level` is 0 for a model, 1 for a task, 3 for everything.
    """
    ok = ~_error()
    # Counted per conversation before the join: judgments shuffle as one row per conversation.
    per_conv = judgments.groupBy("conv_id").agg(
        F.count("*").alias("_n"), L.count_true(ok).alias("_v"),
        L.count_true(ok & L.is_yes("hallucination")).alias("_h"))
    named = per_conv.join(meta.select("conv_id", "task", "model_name"), "conv_id")
    out = named.rollup("task", "model_name").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("_n").alias("total_facts"),
        F.sum("_v").alias("valid_facts"), F.sum("_h").alias("hallucinated_facts"))
    out = out.withColumn("hallucination_rate", L.rate(F.col("hallucinated_facts"), F.col("valid_facts")))
    # Ranked rows are one per (task, model): small whatever the number of judgments.
    place = F.rank().over(Window.partitionBy("level", "task").orderBy("hallucination_rate"))
    return out.withColumn("place", F.when(F.col("level") == 0, place).cast("bigint"))


def leaderboard_coding(convs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Response-level totals of the code task per model, ranked; `convs` carries model_name."""
    scored = score_coding(convs, judgments)
    out = scored.groupBy("model_name").agg(
        F.count("*").alias("conversations"), F.sum("total_responses").alias("total_responses"),
        F.sum("overall_hallucinated_responses").alias("hallucinated_responses"))
    out = out.withColumn("hallucination_rate", L.rate(F.col("hallucinated_responses"), F.col("total_responses")))
    # One row per model.
    return out.withColumn("place", F.rank().over(Window.orderBy("hallucination_rate")).cast("bigint"))


def order_by_rate(df: DataFrame, rate: str, name: str) -> DataFrame:
    return df.orderBy(F.desc(rate), name)
