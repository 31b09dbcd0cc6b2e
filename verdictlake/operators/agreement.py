"""Judge against judge and judge against human: joins, confusion counts, kappa, cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.scale import latest_per_key, position_in_group


def judged_labels(judgments: DataFrame) -> DataFrame:
    """Normalised labels of a judge, as the comparisons read them."""
    return judgments.withColumns({
        "ref_grounding": L.parse_grounding("reference_grounding"),
        "content_label": L.parse_grounding("content_grounding"),
        "hallucination": L.clean("hallucination"),
        "abstention": L.clean("abstention"),
        "verification_error": L.clean("verification_error"),
    })


def merge_judges(
    baseline: DataFrame, compare: DataFrame, columns: Sequence[str], key: str = "claim_key"
) -> DataFrame:
    """Inner join of two judges on the claim key; compared columns become baseline_* and compare_*."""
    left = baseline.withColumnsRenamed({c: f"baseline_{c}" for c in columns})
    right = compare.select(key, *[F.col(c).alias(f"compare_{c}") for c in columns])
    return left.join(right, key)


def comparable_claims(merged: DataFrame, human: Sequence[str] = ()) -> DataFrame:
    """Rows both judges could verify; with `human`, also carrying at least one human label."""
    out = merged
    for side in ("baseline", "compare"):
        name = f"{side}_verification_error"
        if name in merged.columns:
            out = out.filter(L.clean(name).startswith("no"))
    if human:
        labelled = F.lit(False)
        for name in human:
            labelled = labelled | (L.clean(name) != "")
        out = out.filter(labelled)
    return out


def _counts(truth: str, pred: str, by: Sequence[str], df: DataFrame) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    both = F.coalesce(t.isin("yes", "no") & p.isin("yes", "no"), F.lit(False))
    return df.groupBy(*by).agg(
        L.count_true(both).alias("n_samples"), L.count_true(~both).alias("n_excluded"),
        L.count_true((t == "yes") & (p == "yes")).alias("tp"), L.count_true((t == "no") & (p == "yes")).alias("fp"),
        L.count_true((t == "yes") & (p == "no")).alias("fn"), L.count_true((t == "no") & (p == "no")).alias("tn"),
    )


def classification_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1 for the label yes.

    Rows where either label is not yes or no are excluded; zero denominators give 0.
    """
    out = _counts(truth, pred, by, df)
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n_samples")
    return out.withColumns({
        "accuracy": L.rate(tp + F.col("tn"), n), "precision": L.rate(tp, tp + fp),
        "recall": L.rate(tp, tp + fn), "f1": L.rate(2 * tp, 2 * tp + fp + fn),
        "error": F.when(n == 0, "No valid predictions to evaluate"),
    })


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed agreement and Cohen's kappa over rows where both labels are yes or no.

    Fewer than two rows give an error and null figures; kappa is NaN when chance agreement is 1.
    """
    out = _counts(a, b, by, df)
    n = F.col("n_samples").cast("double")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    enough = F.col("n_samples") >= 2
    observed = (tp + tn) / n
    # Chance agreement times n squared stays in whole numbers, so "equals 1" is exact.
    chance_n2 = (tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)
    kappa = F.when(chance_n2 == n * n, F.lit(float("nan"))).otherwise(
        (observed - chance_n2 / (n * n)) / (F.lit(1.0) - chance_n2 / (n * n)))
    return out.withColumns({
        "agreement": F.when(enough, observed), "cohen_kappa": F.when(enough, kappa),
        "error": F.when(~enough, "Not enough valid samples for agreement metrics"),
    }).withColumn("band", kappa_band(F.col("cohen_kappa")))


def kappa_band(kappa: Column) -> Column:
    return (
        F.when(kappa.isNull() | F.isnan(kappa), F.lit(None))
        .when(kappa < 0, "Less than chance agreement")
        .when(kappa < 0.2, "Slight agreement")
        .when(kappa < 0.4, "Fair agreement")
        .when(kappa < 0.6, "Moderate agreement")
        .when(kappa < 0.8, "Substantial agreement")
        .otherwise("Almost perfect agreement")
    )


def metrics_by_type(merged: DataFrame, truth: str, pred: str, by: str = "element_type") -> DataFrame:
    """Classification figures and kappa per element type that has valid rows."""
    figures = classification_metrics(merged, truth, pred, [by]).filter("n_samples > 0").drop("error")
    kappas = agreement(merged, truth, pred, [by]).select(by, "cohen_kappa")
    # Both sides hold one row per element type.
    return figures.join(kappas, by)


def agreement_by_language(merged: DataFrame, a: str, b: str, min_n: int = 5) -> DataFrame:
    out = agreement(merged.filter("language IS NOT NULL"), a, b, ["language"]).filter(F.col("n_samples") >= min_n)
    return out.withColumn("status", L.agreement_class(F.col("agreement")))


def outcome_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of what a judge decided."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("total"), *[
            L.count_true(F.col(column) == value).alias(name) for name, column, value in (
                ("hallucination_yes", "hallucination", "yes"), ("hallucination_no", "hallucination", "no"),
                ("abstentions", "abstention", "yes"), ("errors", "verification_error", "yes"),
                ("reference_yes", "ref_grounding", "yes"), ("reference_no", "ref_grounding", "no"),
                ("content_yes", "content_label", "yes"), ("content_no", "content_label", "no"))])
    return out.withColumns({
        f"{c}_share": L.rate(F.col(c), F.col("total"))
        for c in ("hallucination_yes", "hallucination_no", "abstentions", "errors")})


def match_rate(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with equal labels, unknown and na included."""
    same = F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(same), F.lit(0.0)).alias("match_rate"))


def top_disagreements(df: DataFrame, a: str, b: str, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows with different labels."""
    return df.filter(F.col(a) != F.col(b)).orderBy(*order).limit(n)


# ---- human study ---------------------------------------------------------------------------

AXES = ("ref", "content")


def attach_judges(
    df: DataFrame, judges: dict[str, DataFrame], order: Sequence[str] = ("conv_id", "turn", "claim_idx")
) -> DataFrame:
    """Left join the labels of several judges by conversation and claim id; of repeated claims the last counts."""
    keys = ["conv_id", "claim_id"]
    fields = {"ref_grounding": "reference_grounding", "content_grounding": "content_grounding",
              "hallucination": "hallucination", "verification_error": "verification_error"}
    for name, judge in judges.items():
        wanted = judge.select("claim_id", *fields.values(), *dict.fromkeys(["conv_id", *order]))
        last = latest_per_key(wanted, keys, [c for c in order if c not in keys] or keys).select(
            *keys, *[F.col(src).alias(f"judge_{name}_{dst}") for dst, src in fields.items()])
        df = df.join(last, keys, "left")
    return df


def align_annotators(
    a: DataFrame, b: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched claims of two annotators, and what only one of them has.

    `pairs` names matches as 0-based positions (a_pos, b_pos) inside a (conv_id, turn).
    Matches with any blank label are dropped from the first table but still count as matched.
    """
    key = ["conv_id", "turn"]
    placed_a = _placed(a, "a_pos")
    placed_b = _placed(b, "b_pos")
    side_a = placed_a.select(*key, "a_pos", "claim_id", F.col("ref").alias("human1_ref"),
                             F.col("content").alias("human1_content"))
    side_b = placed_b.select(*key, "b_pos", F.col("claim_id").alias("claim_id2"), F.col("ref").alias("human2_ref"),
                             F.col("content").alias("human2_content"))
    joined = pairs.join(side_a, [*key, "a_pos"]).join(side_b, [*key, "b_pos"])
    filled = F.lit(True)
    for c in ("human1_ref", "human2_ref", "human1_content", "human2_content"):
        filled = filled & (L.text(c) != "")
    matched = joined.filter(filled)
    a_only = placed_a.join(pairs, [*key, "a_pos"], "left_anti")
    b_only = placed_b.join(pairs, [*key, "b_pos"], "left_anti")
    return matched, a_only, b_only


def _placed(side: DataFrame, out: str) -> DataFrame:
    return position_in_group(side, ["conv_id", "turn"], "claim_idx", out).withColumn(out, F.col(out) - 1)


def annotated_turns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(conv_id, turn) seen by either annotator, with the claim counts of both."""
    marked = a.select("conv_id", "turn", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        b.select("conv_id", "turn", F.lit(0).alias("x"), F.lit(1).alias("y")))
    return marked.groupBy("conv_id", "turn").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))


def annotator_disagreements(matched: DataFrame) -> DataFrame:
    return matched.filter("human1_ref <> human2_ref OR human1_content <> human2_content")


def study_flags(df: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Boolean labels per judge and axis; rows where any judge failed to verify are left out."""
    for judge in judges:
        df = df.filter(F.coalesce(F.col(f"judge_{judge}_verification_error"), F.lit("")) != "Yes")
    flags = {
        f"{judge}_{axis}": F.coalesce(L.clean(f"judge_{judge}_{axis}_grounding").startswith("yes"), F.lit(False))
        for judge in judges for axis in AXES}
    return df.withColumns(flags)


def unpivot_judges(df: DataFrame, ids: Sequence[str], judges: Sequence[str]) -> DataFrame:
    """One row per claim, judge and axis, read from the wide flags in one pass."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(j).alias("judge"), F.lit(x).alias("axis"), F.col(f"{j}_{x}").alias("grounded"))
        for j in judges for x in AXES]))
    return df.select(*ids, cells.alias("cell")).select(*ids, "cell.*")


def pivot_judges(long: DataFrame, ids: Sequence[str], judges: Sequence[str]) -> DataFrame:
    """Back to one row per claim."""
    return long.groupBy(*ids).agg(*[
        F.max(F.when((F.col("judge") == j) & (F.col("axis") == x), F.col("grounded"))).alias(f"{j}_{x}")
        for j in judges for x in AXES])


def study_agreement(df: DataFrame, judges: Sequence[str], axis: str, compat: bool = False) -> DataFrame:
    """Human-human agreement on an axis, and each judge's agreement where the humans agree.

    `compat` reads the content flag in the disagreeing half of the reference axis,
    as the published study did.
    """
    h1, h2 = F.col(f"human1_{axis}"), F.col(f"human2_{axis}")
    humans = h1 == h2
    parts = [F.count("*").alias("n"), L.count_true(humans).alias("humans_agree")]
    for judge in judges:
        yes = F.col(f"{judge}_{axis}")
        no = F.col(f"{judge}_content") if compat else yes
        agrees = (yes & (h1 == "yes")) | (~no & (h1 != "yes"))
        parts.append(L.count_true(humans & agrees).alias(f"agree_{judge}"))
    totals = df.agg(*parts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(j).alias("judge"), F.col(f"agree_{j}").alias("judge_agrees")) for j in judges]))
    return totals.select("n", "humans_agree", rows.alias("r")).select(
        F.lit(axis).alias("axis"), "r.judge", "n", "humans_agree", "r.judge_agrees",
        L.rate(F.col("humans_agree"), F.col("n")).alias("human_share"),
        L.rate(F.col("r.judge_agrees"), F.col("humans_agree")).alias("judge_share"))


def disagreement_cohorts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows where judge A agrees with the first human and judge B does not, tagged by cohort.

    Take counts with a groupBy on axis, agrees, disagrees.
    """
    cells = []
    for axis in AXES:
        human = L.clean(f"human1_{axis}").startswith("yes")
        for a, b in pairs:
            hit = (F.col(f"{a}_{axis}") == human) & (F.col(f"{b}_{axis}") != human)
            cells.append(F.when(hit, F.struct(
                F.lit(axis).alias("axis"), F.lit(a).alias("agrees"), F.lit(b).alias("disagrees"))))
    return df.withColumn("_c", F.explode(F.array_compact(F.array(*cells)))).select(
        *df.columns, "_c.axis", "_c.agrees", "_c.disagrees")
