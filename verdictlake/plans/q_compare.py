"""Queries: answer parsing, judge-to-judge and judge-to-human comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import claims as C
from verdictlake.functions import parse as R
from verdictlake.operators import agreement as A
from verdictlake.plans.fixtures import Inputs, turn_answers, with_views
from verdictlake.plans.q_reports import IMP, INS, FUN, PARSE, _rate
from verdictlake.plans.registry import query, rounded

# ---- parsing -------------------------------------------------------------------------------

BODY_SQL = """, s AS (SELECT *, trim(CASE WHEN contains(response, '```json') THEN string_split(string_split(response, '```json')[2], '```')[1]
  WHEN contains(response, '```') THEN string_split(response, '```')[2] ELSE response END, E' \\n') AS body FROM raw_fx)"""


@query("parsed_judgments", "C1", with_views("raw_fx", BODY_SQL + """
SELECT claim_id, model_name, json_extract_string(body, '$.reference_name') AS reference_name, json_extract_string(body, '$.reference_grounding') AS reference_grounding,
  'Unknown' AS content_grounding, json_extract_string(body, '$.hallucination') AS hallucination, 'Unknown' AS abstention, 'No' AS verification_error,
  m % 4 = 0 AS hallucinated_import_detected, json_extract_string(body, '$.reason') AS reason
FROM s WHERE json_valid(body)"""))
def parsed_judgments(i: Inputs):
    raw = i.raw_responses().select("claim_id", "model_name", "authority", "response")
    good, _ = R.parse_judgments(raw)
    return good.select("claim_id", "model_name", "reference_name", "reference_grounding", "content_grounding",
                       "hallucination", "abstention", "verification_error", "hallucinated_import_detected", "reason")


@query("quarantined_judgments", "C1", with_views("raw_fx", BODY_SQL + """
SELECT claim_id, authority AS reference_name, 'Error - Failed to evaluate' AS reference_grounding, 'Yes' AS verification_error, 'Unknown' AS hallucination
FROM s WHERE NOT json_valid(body)"""))
def quarantined_judgments(i: Inputs):
    raw = i.raw_responses().select("claim_id", "model_name", "authority", "response")
    _, bad = R.parse_judgments(raw)
    return bad.select("claim_id", "reference_name", "reference_grounding", "verification_error", "hallucination")


@query("repaired_judgments", "C1", with_views("raw_fx", """
SELECT claim_id, concat('ref ', CAST(m % 7 AS VARCHAR)) AS reference_name, hallucination,
  CASE WHEN h % 14 = 3 THEN concat('seen ', chr(92), '(t', chr(92), ')') ELSE 'seen x' END AS reason
FROM raw_fx WHERE h % 31 <> 5"""))
def repaired_judgments(i: Inputs):
    raw = i.raw_responses().select("claim_id", "response")
    good, _ = R.parse_judgments(raw, repair=True)
    return good.select("claim_id", "reference_name", "hallucination", "reason")


@query("parse_rate_per_model", "C1", with_views("raw_fx", BODY_SQL + """
SELECT model_name, count(*) AS n, round(avg(json_valid(body)::INT), 6) AS parse_rate FROM s GROUP BY 1"""))
def parse_rate_per_model(i: Inputs):
    raw = i.raw_responses().select("claim_id", "model_name", "response")
    return rounded(R.parse_rate(*R.parse_judgments(raw)))


@query("parsed_turn_verdicts", "C2", with_views("verdicts_fx", """
SELECT conv_id, turn, q % 4 <> 3 AS parsed, CASE WHEN q % 4 = 3 THEN FALSE ELSE has_hallucination END AS has_hallucination,
  CASE WHEN q % 4 IN (1, 3) THEN 0 ELSE len(imports) END AS n_imports, CASE WHEN q % 4 IN (1, 3) THEN '' ELSE coalesce(functions[1], '') END AS first_function,
  CASE q % 4 WHEN 3 THEN concat('Failed to parse response: no verdict {', CAST(q AS VARCHAR)) ELSE 'checked' END AS reasoning
FROM verdicts_fx"""))
def parsed_turn_verdicts(i: Inputs):
    out = R.parse_turn_verdicts(turn_answers(i))
    return out.select(
        "conv_id", "turn", "parsed", "has_hallucination", F.size("hallucinated_imports").cast("bigint").alias("n_imports"),
        F.coalesce(F.get("hallucinated_function_calls", F.lit(0))["package"], F.lit("")).alias("first_function"), "reasoning")


@query("parsed_claims", "C3", with_views("payload_fx", """
, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) - 1 AS pos FROM payload_fx)
SELECT conv_id, turn, pos AS claim_idx, md5(concat_ws(':', conv_id, turn, pos)) AS claim_id, claimed_content, authority, 'S' AS original_statement
FROM p WHERE claimed_content NOT IN ('', 'Unknown') AND authority <> 'Unknown'"""))
def parsed_claims(i: Inputs):
    item = F.struct("claim_idx", F.struct("claimed_content", "authority", "claimed_url").alias("c"))
    raw = i.payload().groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(item)).alias("x")).select(
        "conv_id", "turn", F.lit("S").alias("text"),
        F.concat(F.lit("```json\n"), F.to_json(F.transform("x", lambda e: e["c"])), F.lit("\n```")).alias("response"))
    return R.parse_claims(raw, "medical_guidelines").select(
        "conv_id", "turn", "claim_idx", "claim_id", "claimed_content", "authority", "original_statement")


@query("parsed_search_plans", "C4", with_views("claims_fx", """
SELECT claim_id, h % 4 IN (0, 2) AS continue_searching, CASE h % 4 WHEN 0 THEN concat('find ', claim_id) WHEN 2 THEN concat('about ', claim_id) END AS search_query,
  CASE WHEN h % 4 = 1 THEN '[1.1],https://ex.org/1' ELSE '' END AS refs FROM claims_fx"""))
def parsed_search_plans(i: Inputs):
    response = F.expr("""CASE h % 4
      WHEN 0 THEN concat('{"continue_searching": true, "search_query": "find ', claim_id, '"}')
      WHEN 1 THEN '```json {"continue_searching": false, "relevant_urls": ["[1.1]", "https://ex.org/1"]} ```'
      WHEN 2 THEN concat('try ```text\n about ', claim_id, ' ``` please')
      ELSE 'nothing more to do' END""")
    out = R.parse_search_plan(i.claims().select("claim_id", response.alias("response")))
    return out.select("claim_id", "continue_searching", "search_query", F.array_join("relevant_urls", ",").alias("refs"))


def _pairs(i: Inputs):
    """A matcher's answer per turn: equal positions, one pair past the end, one at position 0."""
    turns = A.annotated_turns(i.annotator(1), i.annotator(2))
    listed = F.array_join(F.transform(
        F.expr("CASE WHEN least(n_a, n_b) > 0 THEN sequence(1L, least(n_a, n_b)) ELSE array() END"),
        lambda k: F.concat(F.lit("("), k.cast("string"), F.lit(", "), k.cast("string"), F.lit(")"))), "\n")
    raw = turns.withColumn("response", F.concat(F.lit("Matches:\n"), listed, F.lit("\n(9999, 1)\n(0, 1)")))
    return R.parse_match_pairs(raw)


PLACED_SQL = """, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) - 1 AS a_pos FROM annotator1_fx),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) - 1 AS b_pos FROM annotator2_fx),
m AS (SELECT a.conv_id, a.turn, a_pos, b_pos, a.claim_id, b.claim_id AS claim_id2, a.ref AS human1_ref, a.content AS human1_content, b.ref AS human2_ref, b.content AS human2_content
  FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a_pos = b_pos)"""


@query("match_pairs", "C5", with_views("annotator1_fx annotator2_fx", PLACED_SQL + """
SELECT conv_id, turn, a_pos, b_pos FROM m"""))
def match_pairs(i: Inputs):
    return _pairs(i)


TASKS_SQL = """, t AS (SELECT item_id, text AS task, l.language, (item_id * 7 + length(l.language)) % 5 AS k FROM benchmark,
  (SELECT unnest(['Python', 'Scala', 'Elixir', 'R']) AS language) l)"""


def _answers(i: Inputs):
    langs = F.explode(F.array(*[F.lit(x) for x in ("Python", "Scala", "Elixir", "R")]))
    return i.table("benchmark").select("item_id", F.col("text").alias("task"), langs.alias("language")).withColumn(
        "answer", F.expr("""CASE (item_id * 7 + length(language)) % 5 WHEN 0 THEN ' valid.' WHEN 1 THEN concat('INVALID: use ', language, ': ok')
          WHEN 2 THEN 'Invalid:  ' WHEN 3 THEN 'hard to say' ELSE 'VALID' END"""))


@query("validated_tasks", "C6", "WITH " + TASKS_SQL[2:] + """
SELECT item_id, language, CASE WHEN k = 1 THEN concat('use ', language, ': ok') ELSE task END AS task, CASE WHEN k = 1 THEN 'replaced' ELSE 'kept' END AS status
FROM t WHERE k <> 2""")
def validated_tasks(i: Inputs):
    return R.apply_task_validation(_answers(i))[0].select("item_id", "language", "task", "status")


@query("validated_task_counts", "C6", "WITH " + TASKS_SQL[2:] + """
SELECT language, count(*) FILTER (WHERE k NOT IN (1, 2)) AS kept, count(*) FILTER (WHERE k = 1) AS replaced, count(*) FILTER (WHERE k = 2) AS skipped
FROM t GROUP BY 1""")
def validated_task_counts(i: Inputs):
    return R.apply_task_validation(_answers(i))[1]


# ---- judge against judge -------------------------------------------------------------------


def _keyed(i: Inputs, second: bool):
    j = A.judged_labels(i.judgments(second))
    blanks = {c: F.lit("") for c in ("package_name", "claimed_authors", "code_snippet", "claimed_year")}
    return j.withColumns(blanks).withColumn("claim_key", C.claim_key())


def _merged(i: Inputs):
    columns = ["ref_grounding", "content_label", "hallucination", "abstention", "verification_error"]
    base = _keyed(i, False).select("claim_key", "conv_id", "turn", "claim_idx", "claim_id", "element_type", *columns)
    return A.merge_judges(base, _keyed(i, True), columns)


def _labels_sql(view: str, side: str) -> str:
    return f"""SELECT conv_id AS {side}_conv, claim_id AS {side}_id, {PARSE.format('lower(reference_grounding)')} AS {side}_ref_grounding,
  {PARSE.format('lower(content_grounding)')} AS {side}_content_label, lower(hallucination) AS {side}_hallucination,
  lower(abstention) AS {side}_abstention, lower(verification_error) AS {side}_verification_error, turn AS {side}_turn, claim_idx AS {side}_claim_idx,
  element_type AS {side}_type FROM {view}"""


MERGED_SQL = f""", b AS ({_labels_sql('judgments_fx', 'baseline')}), c AS ({_labels_sql('judgments2_fx', 'compare')}),
mg AS (SELECT baseline_conv AS conv_id, baseline_turn AS turn, baseline_claim_idx AS claim_idx, baseline_id AS claim_id, baseline_type AS element_type, b.*, c.*
  FROM b JOIN c ON baseline_conv = compare_conv AND baseline_id = compare_id),
ok AS (SELECT * FROM mg WHERE baseline_verification_error LIKE 'no%' AND compare_verification_error LIKE 'no%')"""
BOTH = "judgments_fx judgments2_fx"


@query("merged_judges", "D1", with_views(BOTH, MERGED_SQL + """
SELECT claim_id, element_type, baseline_ref_grounding, compare_ref_grounding, baseline_content_label, compare_content_label,
  baseline_hallucination, compare_hallucination, baseline_verification_error, compare_verification_error FROM mg"""))
def merged_judges(i: Inputs):
    return _merged(i).select(
        "claim_id", "element_type", *[f"{s}_{c}" for c in ("ref_grounding", "content_label", "hallucination",
                                                           "verification_error") for s in ("baseline", "compare")])


@query("comparable_claims", "E19", with_views(BOTH, MERGED_SQL + "SELECT claim_id FROM ok"))
def comparable_claims(i: Inputs):
    return A.comparable_claims(_merged(i)).select("claim_id")


def confusion_sql(source: str, a: str, b: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}count(*) FILTER (WHERE {a} IN ('yes','no') AND {b} IN ('yes','no')) AS n_samples,
  count(*) FILTER (WHERE NOT ({a} IN ('yes','no') AND {b} IN ('yes','no'))) AS n_excluded,
  count(*) FILTER (WHERE {a} = 'yes' AND {b} = 'yes') AS tp, count(*) FILTER (WHERE {a} = 'no' AND {b} = 'yes') AS fp,
  count(*) FILTER (WHERE {a} = 'yes' AND {b} = 'no') AS fn, count(*) FILTER (WHERE {a} = 'no' AND {b} = 'no') AS tn FROM {source} {group}"""


METRICS_SQL = f"""{_rate('(tp + tn)', 'n_samples')} AS accuracy, {_rate('tp', '(tp + fp)')} AS precision, {_rate('tp', '(tp + fn)')} AS recall,
  {_rate('2 * tp', '(2 * tp + fp + fn)')} AS f1"""
KAPPA_SQL = """(po - pe) / (1 - pe)"""
AGREE_SQL = """, k AS (SELECT *, (tp + tn) / CAST(n_samples AS DOUBLE) AS po,
  ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (CAST(n_samples AS DOUBLE) * n_samples) AS pe FROM q)"""
BAND_SQL = f"""CASE WHEN {KAPPA_SQL} < 0 THEN 'Less than chance agreement' WHEN {KAPPA_SQL} < 0.2 THEN 'Slight agreement' WHEN {KAPPA_SQL} < 0.4 THEN 'Fair agreement'
  WHEN {KAPPA_SQL} < 0.6 THEN 'Moderate agreement' WHEN {KAPPA_SQL} < 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END"""


@query("judge_metrics", "E14 I5", with_views(BOTH, f"""{MERGED_SQL}, q AS ({confusion_sql('ok', 'baseline_hallucination', 'compare_hallucination')})
SELECT *, {METRICS_SQL}, CASE WHEN n_samples = 0 THEN 'No valid predictions to evaluate' END AS error FROM q"""))
def judge_metrics(i: Inputs):
    ok = A.comparable_claims(_merged(i))
    return rounded(A.classification_metrics(ok, "baseline_hallucination", "compare_hallucination"))


@query("judge_agreement_by_turn", "E15", with_views(BOTH, f"""{MERGED_SQL}, q AS ({confusion_sql('ok', 'baseline_hallucination', 'compare_hallucination', 'turn')}) {AGREE_SQL}
SELECT turn, n_samples, n_excluded, round(po, 6) AS agreement, round({KAPPA_SQL}, 6) AS cohen_kappa, {BAND_SQL} AS band FROM k"""))
def judge_agreement_by_turn(i: Inputs):
    out = A.agreement(A.comparable_claims(_merged(i)), "baseline_hallucination", "compare_hallucination", ["turn"])
    return rounded(out.select("turn", "n_samples", "n_excluded", "agreement", "cohen_kappa", "band"))


@query("judge_metrics_by_type", "E16", with_views(BOTH, f"""{MERGED_SQL}, q AS ({confusion_sql('ok', 'baseline_hallucination', 'compare_hallucination', 'element_type')}) {AGREE_SQL}
SELECT element_type, n_samples, n_excluded, tp, fp, fn, tn, {METRICS_SQL}, round({KAPPA_SQL}, 6) AS cohen_kappa FROM k"""))
def judge_metrics_by_type(i: Inputs):
    ok = A.comparable_claims(_merged(i))
    return rounded(A.metrics_by_type(ok, "baseline_hallucination", "compare_hallucination"))


@query("judge_agreement_by_language", "E16", with_views(BOTH + " meta_fx", f"""{MERGED_SQL}, l AS (SELECT ok.*, language FROM ok JOIN meta_fx USING (conv_id)),
q AS ({confusion_sql('l', 'baseline_hallucination', 'compare_hallucination', 'language')}) {AGREE_SQL}
SELECT language, n_samples, round(po, 6) AS agreement, round({KAPPA_SQL}, 6) AS cohen_kappa,
  CASE WHEN po > 0.8 THEN 'good' WHEN po > 0.6 THEN 'warning' ELSE 'danger' END AS status FROM k WHERE n_samples >= 5"""))
def judge_agreement_by_language(i: Inputs):
    ok = A.comparable_claims(_merged(i)).join(i.meta().select("conv_id", "language"), "conv_id")
    out = A.agreement_by_language(ok, "baseline_hallucination", "compare_hallucination")
    return rounded(out.select("language", "n_samples", "agreement", "cohen_kappa", "status"))


@query("outcomes_per_judge", "E17", with_views(BOTH, f"""
, u AS (SELECT 'first' AS judge, * FROM judgments_fx UNION ALL SELECT 'second', * FROM judgments2_fx),
g AS (SELECT judge, count(*) AS total, count(*) FILTER (WHERE hallucination = 'Yes') AS hallucination_yes, count(*) FILTER (WHERE hallucination = 'No') AS hallucination_no,
  count(*) FILTER (WHERE abstention = 'Yes') AS abstentions, count(*) FILTER (WHERE verification_error = 'Yes') AS errors,
  count(*) FILTER (WHERE reference_grounding LIKE 'Yes%') AS reference_yes, count(*) FILTER (WHERE reference_grounding LIKE 'No%' OR reference_grounding = 'Unknown') AS reference_no,
  count(*) FILTER (WHERE content_grounding LIKE 'Yes%') AS content_yes, count(*) FILTER (WHERE content_grounding LIKE 'No%') AS content_no FROM u GROUP BY 1)
SELECT *, {_rate('hallucination_yes', 'total')} AS hallucination_yes_share, {_rate('hallucination_no', 'total')} AS hallucination_no_share,
  {_rate('abstentions', 'total')} AS abstentions_share, {_rate('errors', 'total')} AS errors_share FROM g"""))
def outcomes_per_judge(i: Inputs):
    both = i.judgments().withColumn("judge", F.lit("first")).unionByName(
        i.judgments(True).withColumn("judge", F.lit("second")))
    return rounded(A.outcome_distribution(A.judged_labels(both), ["judge"]))


@query("label_match_rates", "E18", with_views(BOTH, MERGED_SQL + """
SELECT element_type, count(*) AS n, round(avg((baseline_ref_grounding = compare_ref_grounding)::INT), 6) AS match_rate FROM ok GROUP BY 1"""))
def label_match_rates(i: Inputs):
    ok = A.comparable_claims(_merged(i))
    return rounded(A.match_rate(ok, "baseline_ref_grounding", "compare_ref_grounding", ["element_type"]))


@query("top_disagreements", "F17", with_views(BOTH, MERGED_SQL + """
SELECT claim_id, baseline_hallucination, compare_hallucination FROM ok WHERE baseline_hallucination <> compare_hallucination
ORDER BY conv_id, turn, claim_idx LIMIT 20"""))
def top_disagreements(i: Inputs):
    ok = A.comparable_claims(_merged(i))
    out = A.top_disagreements(ok, "baseline_hallucination", "compare_hallucination", 20, ["conv_id", "turn", "claim_idx"])
    return out.select("claim_id", "baseline_hallucination", "compare_hallucination")


# ---- judge against human -------------------------------------------------------------------


@query("human_judge_metrics", "E14 E19 B11", with_views("judgments_fx annotator1_fx", f"""
, q0 AS (SELECT lower(hallucination) AS judge, lower(verification_error) AS ve, CASE WHEN ref = 'no' OR content = 'no' THEN 'yes' WHEN ref = 'yes' AND content = 'yes' THEN 'no'
  WHEN ref = '' AND content = 'yes' THEN 'no' ELSE 'unknown' END AS human, ref, content FROM judgments_fx JOIN annotator1_fx USING (claim_id)),
h AS (SELECT * FROM q0 WHERE ve LIKE 'no%' AND (ref <> '' OR content <> '')), q AS ({confusion_sql('h', 'human', 'judge')}) {AGREE_SQL}
SELECT n_samples, n_excluded, tp, fp, fn, tn, {METRICS_SQL}, round(po, 6) AS agreement, round({KAPPA_SQL}, 6) AS cohen_kappa FROM k"""))
def human_judge_metrics(i: Inputs):
    from verdictlake.functions.labels import human_hallucination

    human = i.annotator(1).select("claim_id", "ref", "content", human_hallucination("ref", "content").alias("human"))
    judge = A.judged_labels(i.judgments()).select(
        "claim_id", F.col("hallucination").alias("judge"), F.col("verification_error").alias("baseline_verification_error"))
    ok = A.comparable_claims(judge.join(human, "claim_id"), ["ref", "content"])
    figures = A.classification_metrics(ok, "human", "judge").drop("error")
    kappa = A.agreement(ok, "human", "judge").select("n_samples", "agreement", "cohen_kappa")
    return rounded(figures.join(kappa, "n_samples"))


@query("aligned_annotators", "D3", with_views("annotator1_fx annotator2_fx", PLACED_SQL + """
SELECT claim_id, claim_id2, human1_ref, human1_content, human2_ref, human2_content FROM m
WHERE human1_ref <> '' AND human1_content <> '' AND human2_ref <> '' AND human2_content <> ''"""))
def aligned_annotators(i: Inputs):
    matched, _, _ = A.align_annotators(i.annotator(1), i.annotator(2), _pairs(i))
    return matched.select("claim_id", "claim_id2", "human1_ref", "human1_content", "human2_ref", "human2_content")


@query("unmatched_annotations", "D3 G4", with_views("annotator1_fx annotator2_fx", PLACED_SQL + """
SELECT 'first' AS side, claim_id FROM a WHERE (conv_id, turn, a_pos) NOT IN (SELECT conv_id, turn, a_pos FROM m)
UNION ALL SELECT 'second', claim_id FROM b WHERE (conv_id, turn, b_pos) NOT IN (SELECT conv_id, turn, b_pos FROM m)"""))
def unmatched_annotations(i: Inputs):
    _, a_only, b_only = A.align_annotators(i.annotator(1), i.annotator(2), _pairs(i))
    return a_only.select(F.lit("first").alias("side"), "claim_id").union(
        b_only.select(F.lit("second").alias("side"), "claim_id"))


@query("annotated_turns", "G3", with_views("annotator1_fx annotator2_fx", """
SELECT conv_id, turn, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b
FROM (SELECT conv_id, turn, 1 AS x, 0 AS y FROM annotator1_fx UNION ALL SELECT conv_id, turn, 0, 1 FROM annotator2_fx) t GROUP BY 1, 2"""))
def annotated_turns(i: Inputs):
    return A.annotated_turns(i.annotator(1), i.annotator(2))


@query("annotator_disagreements", "E22", with_views("annotator1_fx annotator2_fx", PLACED_SQL + """
SELECT claim_id FROM m WHERE human1_ref <> '' AND human1_content <> '' AND human2_ref <> '' AND human2_content <> ''
  AND (human1_ref <> human2_ref OR human1_content <> human2_content)"""))
def annotator_disagreements(i: Inputs):
    matched, _, _ = A.align_annotators(i.annotator(1), i.annotator(2), _pairs(i))
    return A.annotator_disagreements(matched).select("claim_id")


JUDGES = ("web", "search", "own")


def _study(i: Inputs):
    """Both annotators by claim id, with three judges: two complete, one that judged only part."""
    a = i.annotator(1).select("claim_id", "conv_id", "turn", F.col("ref").alias("human1_ref"), F.col("content").alias("human1_content"))
    b = i.annotator(2).select("claim_id", F.col("ref").alias("human2_ref"), F.col("content").alias("human2_content"))
    return A.attach_judges(a.join(b, "claim_id"), {"web": i.judgments(), "search": i.judgments(True), "own": i.judged()})


STUDY_VIEWS = "judgments_fx judgments2_fx judged_fx annotator1_fx annotator2_fx"
STUDY_SQL = """, st AS (SELECT a.claim_id, a.ref AS human1_ref, a.content AS human1_content, b.ref AS human2_ref, b.content AS human2_content,
  j.reference_grounding AS web_r, j.content_grounding AS web_c, j.verification_error AS web_e, k.reference_grounding AS search_r, k.content_grounding AS search_c, k.verification_error AS search_e,
  o.reference_grounding AS own_r, o.content_grounding AS own_c, o.verification_error AS own_e
  FROM annotator1_fx a JOIN annotator2_fx b USING (claim_id) LEFT JOIN judgments_fx j USING (claim_id) LEFT JOIN judgments2_fx k USING (claim_id) LEFT JOIN judged_fx o USING (claim_id)),
fl AS (SELECT claim_id, human1_ref, human1_content, human2_ref, human2_content, coalesce(web_r LIKE 'Yes%', FALSE) AS web_ref, coalesce(web_c LIKE 'Yes%', FALSE) AS web_content,
  coalesce(search_r LIKE 'Yes%', FALSE) AS search_ref, coalesce(search_c LIKE 'Yes%', FALSE) AS search_content, coalesce(own_r LIKE 'Yes%', FALSE) AS own_ref, coalesce(own_c LIKE 'Yes%', FALSE) AS own_content
  FROM st WHERE coalesce(web_e, '') <> 'Yes' AND coalesce(search_e, '') <> 'Yes' AND coalesce(own_e, '') <> 'Yes')"""


@query("study_with_judges", "D2", with_views(STUDY_VIEWS, STUDY_SQL + """
SELECT claim_id, human1_ref, human2_content, web_r AS judge_web_ref_grounding, search_c AS judge_search_content_grounding, own_e AS judge_own_verification_error FROM st"""))
def study_with_judges(i: Inputs):
    return _study(i).select("claim_id", "human1_ref", "human2_content", "judge_web_ref_grounding",
                            "judge_search_content_grounding", "judge_own_verification_error")


@query("study_flags", "E23", with_views(STUDY_VIEWS, STUDY_SQL + """
SELECT claim_id, web_ref, web_content, search_ref, search_content, own_ref, own_content FROM fl"""))
def study_flags(i: Inputs):
    return A.study_flags(_study(i), JUDGES).select("claim_id", *[f"{j}_{x}" for j in JUDGES for x in A.AXES])


def _study_agreement_sql(axis: str, compat: bool) -> str:
    rows = []
    for j in JUDGES:
        no = f"{j}_content" if compat else f"{j}_{axis}"
        rows.append(f"""SELECT '{axis}' AS axis, '{j}' AS judge, count(*) AS n, count(*) FILTER (WHERE human1_{axis} = human2_{axis}) AS humans_agree,
  count(*) FILTER (WHERE human1_{axis} = human2_{axis} AND ((human1_{axis} = 'yes' AND {j}_{axis}) OR (human1_{axis} <> 'yes' AND NOT {no}))) AS judge_agrees FROM fl""")
    return " UNION ALL ".join(rows)


@query("study_agreement", "E20", with_views(STUDY_VIEWS, f"""{STUDY_SQL}, r AS ({_study_agreement_sql('ref', False)} UNION ALL {_study_agreement_sql('content', False)})
SELECT *, {_rate('humans_agree', 'n')} AS human_share, {_rate('judge_agrees', 'humans_agree')} AS judge_share FROM r"""))
def study_agreement(i: Inputs):
    flags = A.study_flags(_study(i), JUDGES)
    return rounded(A.study_agreement(flags, JUDGES, "ref").union(A.study_agreement(flags, JUDGES, "content")))


@query("study_agreement_published", "E20", with_views(STUDY_VIEWS, f"""{STUDY_SQL}, r AS ({_study_agreement_sql('ref', True)})
SELECT *, {_rate('humans_agree', 'n')} AS human_share, {_rate('judge_agrees', 'humans_agree')} AS judge_share FROM r"""))
def study_agreement_published(i: Inputs):
    return rounded(A.study_agreement(A.study_flags(_study(i), JUDGES), JUDGES, "ref", compat=True))


@query("disagreement_cohorts", "E21", with_views(STUDY_VIEWS, STUDY_SQL + " " + " UNION ALL ".join(
    f"""SELECT '{x}' AS axis, '{a}' AS agrees, '{b}' AS disagrees, count(*) AS n FROM fl
WHERE {a}_{x} = (human1_{x} LIKE 'yes%') AND {b}_{x} <> (human1_{x} LIKE 'yes%') GROUP BY 1, 2, 3"""
    for x in A.AXES for a, b in (("web", "own"), ("own", "web"), ("own", "search")))))
def disagreement_cohorts(i: Inputs):
    flags = A.study_flags(_study(i), JUDGES)
    rows = A.disagreement_cohorts(flags, [("web", "own"), ("own", "web"), ("own", "search")])
    return rows.groupBy("axis", "agrees", "disagrees").agg(F.count("*").alias("n"))


@query("unpivoted_judges", "G6", with_views(STUDY_VIEWS, STUDY_SQL + " " + " UNION ALL ".join(
    f"SELECT claim_id, '{j}' AS judge, '{x}' AS axis, {j}_{x} AS grounded FROM fl" for j in JUDGES for x in A.AXES)))
def unpivoted_judges(i: Inputs):
    return A.unpivot_judges(A.study_flags(_study(i), JUDGES), ["claim_id"], JUDGES)


@query("pivoted_judges", "G6", with_views(STUDY_VIEWS, STUDY_SQL + """
SELECT claim_id, web_ref, web_content, search_ref, search_content, own_ref, own_content FROM fl"""))
def pivoted_judges(i: Inputs):
    long = A.unpivot_judges(A.study_flags(_study(i), JUDGES), ["claim_id"], JUDGES)
    return A.pivot_judges(long, ["claim_id"], JUDGES)
