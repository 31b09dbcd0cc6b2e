"""Queries: labels, scores and report rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.operators import direct as D
from verdictlake.operators import metrics as M
from verdictlake.operators import papers as P
from verdictlake.plans.fixtures import Inputs, turn_answers, with_views
from verdictlake.plans.registry import ORACLES, query, rounded
from verdictlake.sources import files

CONVS = "convs AS (SELECT DISTINCT conv_id FROM conversations)"
ERR = "lower(verification_error) IN ('yes', 'true', 'unknown')"
REF_FAIL = "(lower(reference_grounding) LIKE 'no%' OR lower(reference_grounding) IN ('unknown', 'not found', 'false'))"
CON_FAIL = "(lower(content_grounding) LIKE 'no%' OR lower(content_grounding) IN ('unknown', 'not grounded', 'false'))"
IMP, INS, FUN = (f"hallucinated_{k}_detected" for k in ("import", "install", "function_usage"))


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / CAST({whole} AS DOUBLE), 6) ELSE 0.0::DOUBLE END"


def _convs(i: Inputs):
    return i.table("conversations").select("conv_id").distinct()


# ---- labels --------------------------------------------------------------------------------

PARSE = """CASE WHEN {0} LIKE 'yes%' THEN 'yes' WHEN {0} LIKE 'no%' THEN 'no'
  WHEN {0} LIKE 'n/a%' OR contains({0}, 'could not') OR contains({0}, 'cannot verify') THEN 'na'
  WHEN contains(substr({0}, 1, 50), 'yes') THEN 'yes' WHEN contains(substr({0}, 1, 50), 'no') THEN 'no' ELSE 'unknown' END"""
VARIED = """CASE h % 9 WHEN 0 THEN '  YES, found ' WHEN 1 THEN 'We could not open it' WHEN 2 THEN 'I cannot verify this'
  WHEN 3 THEN 'Partly: yes for the title' WHEN 4 THEN 'Unknown' WHEN 5 THEN '' WHEN 6 THEN 'Partial'
  WHEN 7 THEN concat('It is very very very very very very very long until a ', 'no') ELSE reference_grounding END"""


@query("parsed_grounding", "B8", with_views("judgments_fx", f"""
, t AS (SELECT claim_id, reference_grounding, content_grounding, {VARIED} AS varied FROM judgments_fx)
SELECT claim_id, {PARSE.format('lower(trim(varied))')} AS varied_label,
  {PARSE.format('lower(reference_grounding)')} AS ref_label, {PARSE.format('lower(content_grounding)')} AS content_label FROM t"""))
def parsed_grounding(i: Inputs):
    return i.judgments().withColumn("varied", F.expr(VARIED)).select(
        "claim_id", L.parse_grounding("varied").alias("varied_label"),
        L.parse_grounding("reference_grounding").alias("ref_label"),
        L.parse_grounding("content_grounding").alias("content_label"))


@query("label_flags", "B9 B10 B12 B13 B26", with_views("judgments_fx", f"""
SELECT claim_id, lower(hallucination) IN ('yes', 'true') AS is_yes, {ERR} AS is_error,
  {REF_FAIL} AS ref_failed, {CON_FAIL} AS content_failed,
  CASE WHEN m % 2 = 0 THEN element_type WHEN {IMP} THEN 'import' WHEN {INS} THEN 'install' WHEN {FUN} THEN 'function_call' ELSE 'unknown' END AS kind,
  CASE WHEN hallucination = 'Unknown' THEN {IMP} OR {INS} OR {FUN} ELSE hallucination = 'Yes' END AS verdict,
  CASE WHEN abstention = 'Yes' THEN 'Abstention' WHEN hallucination = 'Yes' THEN 'Hallucination' ELSE 'Valid' END AS badge
FROM judgments_fx"""))
def label_flags(i: Inputs):
    flags = (F.col(IMP), F.col(INS), F.col(FUN))
    declared = F.when(F.col("m") % 2 == 0, F.col("element_type"))
    return i.judgments().select(
        "claim_id", L.is_yes("hallucination").alias("is_yes"),
        L.is_verification_error("verification_error").alias("is_error"),
        L.reference_failed("reference_grounding").alias("ref_failed"),
        L.content_failed("content_grounding").alias("content_failed"),
        L.infer_element_type(declared, *flags).alias("kind"),
        L.resolve_verdict("hallucination", *flags).alias("verdict"),
        L.result_badge(L.is_yes("abstention"), L.is_yes("hallucination")).alias("badge"))


@query("human_labels", "B11", with_views("annotator1_fx", """
SELECT claim_id, CASE WHEN ref = 'no' OR content = 'no' THEN 'yes' WHEN ref = 'yes' AND content = 'yes' THEN 'no'
  WHEN ref = '' AND content = 'yes' THEN 'no' ELSE 'unknown' END AS label FROM annotator1_fx"""))
def human_labels(i: Inputs):
    return i.annotator(1).select("claim_id", L.human_hallucination("ref", "content").alias("label"))


@query("citation_buckets", "B14", with_views("meta_fx", """
SELECT conv_id, CASE WHEN cited_by_count < 50 THEN 'low_citations' WHEN cited_by_count >= 1000 THEN 'high_citations' END AS bucket FROM meta_fx"""))
def citation_buckets(i: Inputs):
    return i.meta().select("conv_id", L.citation_bucket("cited_by_count").alias("bucket"))


@query("filtered_papers", "B17", with_views("papers_fx", """
SELECT doc_id FROM papers_fx WHERE publication_year >= 2000 AND cited_by_count > 100 AND cited_by_count <= 1500
  AND len(string_split_regex(trim(title), '\\s+')) >= 3 AND doi IS NOT NULL AND length(abstract) > 200"""))
def filtered_papers(i: Inputs):
    return P.filter_papers(i.papers(), cited_by_min=100, cited_by_max=1500, min_title_words=3).select("doc_id")


@query("detected_task", "B18", with_views("judgments_fx", """
SELECT 'with_elements' AS kind, CASE WHEN bool_or(element_type IN ('import', 'install', 'function_call')) THEN 'coding' ELSE 'grounding' END AS task FROM judgments_fx
UNION ALL SELECT 'plain', CASE WHEN count(*) >= 0 THEN 'grounding' END FROM judgments_fx
UNION ALL SELECT 'named', CASE WHEN count(*) >= 0 THEN 'legal_cases' END FROM judgments_fx"""))
def detected_task(i: Inputs):
    j = i.judgments()
    plain = j.select("conv_id", "claim_id", "hallucination")
    parts = [_detect(j, None, "with_elements"), _detect(plain, None, "plain"), _detect(j, "legal_cases", "named")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _detect(df, task, kind):
    return P.detect_task(df, task).withColumn("kind", F.lit(kind))


@query("status_classes", "B25", with_views("judgments_fx", f"""
, r AS (SELECT turn, count(*) FILTER (WHERE hallucination = 'Yes') / CAST(count(*) AS DOUBLE) AS rate FROM judgments_fx GROUP BY turn)
SELECT turn, CASE WHEN rate > 0.5 THEN 'highlight' WHEN rate < 0.2 THEN 'good' ELSE '' END AS grounding_class,
  CASE WHEN rate > 0.3 THEN 'highlight' WHEN rate < 0.1 THEN 'good' ELSE '' END AS coding_class,
  CASE WHEN 1 - rate > 0.8 THEN 'good' WHEN 1 - rate > 0.6 THEN 'warning' ELSE 'danger' END AS agreement_class FROM r"""))
def status_classes(i: Inputs):
    rates = i.judgments().groupBy("turn").agg(
        L.rate(F.count_if(F.col("hallucination") == "Yes"), F.count(F.lit(1))).alias("rate"))
    return rates.select(
        "turn", L.status_class(F.col("rate"), 0.5, 0.2).alias("grounding_class"),
        L.status_class(F.col("rate"), 0.3, 0.1).alias("coding_class"),
        L.agreement_class(1 - F.col("rate")).alias("agreement_class"))


# ---- conversation scores -------------------------------------------------------------------


@query("conversation_scores", "E1 D7", with_views("judged_fx", f"""
, {CONVS}, j AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE hallucination = 'Yes') AS y,
  count(*) FILTER (WHERE input_use_fallback) AS f1, count(*) FILTER (WHERE judge_used_websearch_fallback) AS f2,
  count(*) FILTER (WHERE snippets_only) AS f3 FROM judged_fx GROUP BY conv_id)
SELECT conv_id, coalesce(n, 0) AS total_claims, coalesce(y, 0) AS hallucinations, coalesce(f1, 0) AS input_use_fallback_count,
  coalesce(f2, 0) AS judge_used_websearch_fallback_count, coalesce(f3, 0) AS snippets_only_count,
  round(CASE WHEN n > 0 THEN 1.0 - y / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS score,
  CASE WHEN n > 0 THEN concat('Found ', y, '/', n, ' hallucinated claims') ELSE 'No verifiable claims found' END AS reasoning
FROM convs LEFT JOIN j USING (conv_id)"""))
def conversation_scores(i: Inputs):
    return rounded(M.score_conversations(_convs(i), i.judged()))


KIND_SQL = """, t AS (SELECT conv_id, turn, bool_or(%s) AS i, bool_or(%s) AS s, bool_or(%s) AS f FROM {src} GROUP BY 1, 2),
p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE i OR s OR f) AS o, count(*) FILTER (WHERE i) AS i,
  count(*) FILTER (WHERE s) AS s, count(*) FILTER (WHERE f) AS f FROM t GROUP BY 1)""" % (IMP, INS, FUN)


@query("coding_scores", "E2", with_views("judged_fx", f"""
, {CONVS} {KIND_SQL.format(src='judged_fx')},
x AS (SELECT conv_id, coalesce(n, 0) AS n, coalesce(o, 0) AS o, coalesce(i, 0) AS i, coalesce(s, 0) AS s, coalesce(f, 0) AS f FROM convs LEFT JOIN p USING (conv_id))
SELECT conv_id, n AS total_responses, o AS overall_hallucinated_responses, i AS import_hallucinated_responses,
  s AS install_hallucinated_responses, f AS function_hallucinated_responses,
  {_rate('o', 'n')} AS overall_hallucination_rate, {_rate('i', 'n')} AS import_hallucination_rate,
  {_rate('s', 'n')} AS install_hallucination_rate, {_rate('f', 'n')} AS function_hallucination_rate,
  round(1.0 - CASE WHEN n > 0 THEN o / CAST(n AS DOUBLE) ELSE 0 END, 6) AS score,
  CASE WHEN o > 0 THEN concat('Response hallucination rates - ', concat_ws('; ',
    concat('Overall: ', o, '/', n, ' (', printf('%.1f', 100.0 * o / n), '%)'),
    CASE WHEN i > 0 THEN concat('Import: ', i, '/', n, ' (', printf('%.1f', 100.0 * i / n), '%)') END,
    CASE WHEN s > 0 THEN concat('Install: ', s, '/', n, ' (', printf('%.1f', 100.0 * s / n), '%)') END,
    CASE WHEN f > 0 THEN concat('Function: ', f, '/', n, ' (', printf('%.1f', 100.0 * f / n), '%)') END))
  ELSE concat('No hallucinations detected in ', n, ' responses') END AS reasoning
FROM x"""))
def coding_scores(i: Inputs):
    return rounded(M.coding_reasoning(M.score_coding(_convs(i), i.judged())))


DIRECT_SQL = f""", {CONVS}, o AS (SELECT *, list_concat(list_concat(list_transform(imports[:2], lambda x: concat(x, ' import')),
   list_transform(installs[:2], lambda x: concat(x, ' install'))),
   list_transform(functions[:2], lambda x, k: concat(x, '.fn', CAST(k AS VARCHAR), '()'))) AS iss FROM verdicts_fx),
p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE has_hallucination) AS y, count(*) FILTER (WHERE len(imports) > 0) AS a,
   count(*) FILTER (WHERE len(installs) > 0) AS b, count(*) FILTER (WHERE len(functions) > 0) AS c,
   flatten(list(iss ORDER BY turn)) AS l FROM o GROUP BY 1),
x AS (SELECT conv_id, coalesce(n, 0) AS n, coalesce(y, 0) AS y, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c,
   coalesce(concat(array_to_string(l[:3], ', '), CASE WHEN len(l) > 3 THEN concat(' (+', len(l) - 3, ' more)') ELSE '' END), '') AS issues
   FROM convs LEFT JOIN p USING (conv_id))
SELECT conv_id, n AS total_turns, y AS turns_with_hallucinations, a AS import_hallucinations, b AS install_hallucinations,
  c AS function_hallucinations, issues, round(CASE WHEN n > 0 THEN 1.0 - y / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS score,
  CASE WHEN n = 0 THEN 'No assistant turns found' ELSE concat('Evaluated ', n, ' turn', CASE WHEN n = 1 THEN '' ELSE 's' END, '. ',
    a + b + c, ' hallucination', CASE WHEN a + b + c = 1 THEN '' ELSE 's' END, ' (', a, ' import, ', b, ' install, ', c, ' function). ',
    CASE WHEN a + b + c = 0 THEN 'All packages and API calls verified against official documentation' ELSE concat('Issues: ', issues) END, '.') END AS reasoning
FROM x"""


@query("direct_scores", "E3", with_views("verdicts_fx", "\n" + DIRECT_SQL))
def direct_scores(i: Inputs):
    return rounded(M.direct_reasoning(M.score_direct(_convs(i), i.verdicts())))


# What the four kinds of answers of `_answers` say once parsed.
ANSWERS_SQL = """, v AS (SELECT conv_id, turn, has_hallucination AND q % 4 <> 3 AS has_hallucination, CASE WHEN q % 4 IN (1, 3) THEN [] ELSE imports END AS imports,
  CASE WHEN q % 4 IN (1, 3) THEN [] ELSE installs END AS installs, CASE WHEN q % 4 IN (1, 3) THEN [] ELSE functions END AS functions FROM verdicts_fx),
k AS (SELECT conv_id, sum(CASE WHEN has_hallucination THEN len(imports) + len(installs) + len(functions) ELSE 1 END) AS claims,
  sum(CASE WHEN has_hallucination THEN len(imports) + len(installs) + len(functions) ELSE 0 END) AS bad FROM v GROUP BY 1)"""
RUN_SQL = ANSWERS_SQL + DIRECT_SQL.replace("FROM verdicts_fx", "FROM v").replace("SELECT conv_id, n AS total_turns", """, d AS (
SELECT conv_id, n AS total_turns""") + """)"""


def _direct_run(i: Inputs):
    answers = turn_answers(i)
    return D.run_direct(i.spark, i.table("conversations"), answers, files.scratch(i.spark, "direct"))


@query("direct_run_records", "A3 A5 C2 E3 G2", with_views("verdicts_fx", RUN_SQL + """
SELECT conv_id AS conversation_id, score, reasoning, CAST(coalesce(claims, 0) AS BIGINT) AS total_claims, CAST(coalesce(bad, 0) AS BIGINT) AS hallucinations,
  total_turns, turns_with_hallucinations, import_hallucinations, install_hallucinations, function_hallucinations FROM d LEFT JOIN k USING (conv_id)"""))
def direct_run_records(i: Inputs):
    """Raw answers of every assistant turn to stored evaluation records, read back."""
    d = "details."
    return rounded(_direct_run(i).select(
        "conversation_id", "score", "reasoning", d + "total_claims", d + "hallucinations", d + "total_turns",
        F.col(d + "overall_hallucinated_responses").alias("turns_with_hallucinations"),
        *[F.col(f"{d}{k}_hallucinated_responses").alias(f"{k}_hallucinations") for k in D.KINDS]))


@query("direct_run_report", "E3 E9", with_views("verdicts_fx", RUN_SQL + """
, t AS (SELECT count(*) AS total_conversations, CAST(sum(total_turns) AS BIGINT) AS total_responses, CAST(sum(turns_with_hallucinations) AS BIGINT) AS y, CAST(sum(import_hallucinations) AS BIGINT) AS a,
  CAST(sum(install_hallucinations) AS BIGINT) AS b, CAST(sum(function_hallucinations) AS BIGINT) AS c, count(*) FILTER (WHERE import_hallucinations > 0) AS ca, count(*) FILTER (WHERE install_hallucinations > 0) AS cb,
  count(*) FILTER (WHERE function_hallucinations > 0) AS cc, CAST(sum(claims) AS BIGINT) AS total_claims, CAST(sum(bad) AS BIGINT) AS hallucinated_claims,
  avg(CASE WHEN total_turns > 0 THEN 1.0 - turns_with_hallucinations / CAST(total_turns AS DOUBLE) ELSE 1.0 END) AS s FROM d LEFT JOIN k USING (conv_id))
SELECT total_conversations, total_responses, y AS overall_hallucinated_responses, a AS import_hallucinated_responses, b AS install_hallucinated_responses, c AS function_hallucinated_responses,
  ca AS conversations_with_import, cb AS conversations_with_install, cc AS conversations_with_function, total_claims, hallucinated_claims, round(s, 6) AS mean_score,
  round(y / CAST(total_responses AS DOUBLE), 6) AS overall_hallucination_rate, round(a / CAST(total_responses AS DOUBLE), 6) AS import_hallucination_rate,
  round(b / CAST(total_responses AS DOUBLE), 6) AS install_hallucination_rate, round(c / CAST(total_responses AS DOUBLE), 6) AS function_hallucination_rate,
  round(hallucinated_claims / CAST(total_claims AS DOUBLE), 6) AS claim_level_hallucination_rate FROM t"""))
def direct_run_report(i: Inputs):
    """The report of a directly judged run, from its stored records."""
    return rounded(D.direct_report(_direct_run(i)))


@query("coding_scores_legacy", "E4", with_views("verdicts_fx", f"""
, {CONVS}, p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE len(imports) + len(installs) + len(functions) > 0) AS o,
  count(*) FILTER (WHERE len(imports) > 0) AS i, count(*) FILTER (WHERE len(installs) > 0) AS s, count(*) FILTER (WHERE len(functions) > 0) AS f
  FROM verdicts_fx GROUP BY 1),
x AS (SELECT conv_id, coalesce(n, 0) AS n, coalesce(o, 0) AS o, coalesce(i, 0) AS i, coalesce(s, 0) AS s, coalesce(f, 0) AS f FROM convs LEFT JOIN p USING (conv_id))
SELECT conv_id, n AS total_responses, o AS overall_hallucinated_count, i AS import_hallucinated_count, s AS install_hallucinated_count,
  f AS function_hallucinated_count, {_rate('o', 'n')} AS overall_hallucination_rate, {_rate('i', 'n')} AS import_hallucination_rate,
  {_rate('s', 'n')} AS install_hallucination_rate, {_rate('f', 'n')} AS function_hallucination_rate,
  concat_ws(',', CASE WHEN i > 0 THEN 'import' END, CASE WHEN s > 0 THEN 'install' END, CASE WHEN f > 0 THEN 'function_usage' END) AS hallucination_types,
  CAST((i > 0)::INT + (s > 0)::INT + (f > 0)::INT AS BIGINT) AS num_hallucination_types,
  round(1.0 - CASE WHEN n > 0 THEN o / CAST(n AS DOUBLE) ELSE 0 END, 6) AS score,
  CASE WHEN n = 0 THEN 'No responses to evaluate' WHEN o = 0 THEN 'No hallucinations detected' ELSE concat('Overall: ', o, '/', n, ' (', printf('%.1f', 100.0 * o / n), '%) | Import: ', i, '/', n, ' (', printf('%.1f', 100.0 * i / n),
    '%) | Install: ', s, '/', n, ' (', printf('%.1f', 100.0 * s / n), '%) | Function: ', f, '/', n, ' (', printf('%.1f', 100.0 * f / n), '%)') END AS reasoning FROM x"""))
def coding_scores_legacy(i: Inputs):
    turns = i.verdicts().select(
        "conv_id", "turn", (F.size("hallucinated_imports") > 0).alias(IMP),
        (F.size("hallucinated_installs") > 0).alias(INS), (F.size("hallucinated_function_calls") > 0).alias(FUN))
    out = M.legacy_reasoning(M.score_coding_legacy(_convs(i), turns))
    return rounded(out.withColumn("hallucination_types", F.array_join("hallucination_types", ",")))


# ---- grounding reports ---------------------------------------------------------------------

TOTALS_SQL = f"""count(*) AS total_facts, count(*) FILTER (WHERE {ERR}) AS verification_errors, count(*) FILTER (WHERE NOT {ERR}) AS valid_facts,
  count(*) FILTER (WHERE NOT {ERR} AND hallucination = 'Yes') AS hallucinated_facts,
  count(*) FILTER (WHERE NOT {ERR} AND input_use_fallback) AS input_use_fallback_count,
  count(*) FILTER (WHERE NOT {ERR} AND judge_used_websearch_fallback) AS judge_used_websearch_fallback_count,
  count(*) FILTER (WHERE NOT {ERR} AND snippets_only) AS snippets_only_count"""
TOTALS_RATES = f"""{_rate('hallucinated_facts', 'valid_facts')} AS hallucination_rate,
  {_rate('input_use_fallback_count', 'valid_facts')} AS input_use_fallback_rate,
  {_rate('judge_used_websearch_fallback_count', 'valid_facts')} AS judge_used_websearch_fallback_rate,
  {_rate('snippets_only_count', 'valid_facts')} AS snippets_only_rate"""


@query("grounding_totals", "E5", with_views("judgments_fx", f"""
SELECT *, {TOTALS_RATES} FROM (SELECT {TOTALS_SQL} FROM judgments_fx) t"""))
def grounding_totals(i: Inputs):
    return rounded(M.grounding_totals(i.judgments()))


@query("grounding_totals_by_type", "E5", with_views("judgments_fx", f"""
SELECT *, {TOTALS_RATES} FROM (SELECT element_type, {TOTALS_SQL} FROM judgments_fx GROUP BY 1) t"""))
def grounding_totals_by_type(i: Inputs):
    return rounded(M.grounding_totals(i.judgments(), ["element_type"]))


FAIL_SQL = f"""count(*) FILTER (WHERE NOT {ERR}) AS total_facts,
  count(*) FILTER (WHERE NOT {ERR} AND hallucination = 'Yes') AS hallucinated_facts,
  count(*) FILTER (WHERE NOT {ERR} AND {REF_FAIL}) AS reference_failures,
  count(*) FILTER (WHERE NOT {ERR} AND {CON_FAIL}) AS content_failures,
  count(*) FILTER (WHERE NOT {ERR} AND abstention = 'Yes') AS abstentions"""
FAIL_RATES = f"""{_rate('hallucinated_facts', 'total_facts')} AS hallucination_rate,
  {_rate('reference_failures', 'total_facts')} AS reference_failure_rate,
  {_rate('content_failures', 'total_facts')} AS content_failure_rate, {_rate('abstentions', 'total_facts')} AS abstention_rate"""


@query("grounding_by_turn", "E6", with_views("judgments_fx", f"""
SELECT *, {FAIL_RATES} FROM (SELECT turn, {FAIL_SQL} FROM judgments_fx WHERE NOT {ERR} GROUP BY turn) t"""))
def grounding_by_turn(i: Inputs):
    return rounded(M.grounding_by_turn(i.judgments()))


@query("grounding_by_citations", "E7", with_views("judged_fx meta_fx", f"""
, b AS (SELECT conv_id, paper_title, CASE WHEN cited_by_count < 50 THEN 'low_citations' WHEN cited_by_count >= 1000 THEN 'high_citations' END AS bucket FROM meta_fx),
s AS (SELECT bucket, {FAIL_SQL}, count(*) FILTER (WHERE {ERR}) AS verification_errors FROM judged_fx JOIN b USING (conv_id) WHERE bucket IS NOT NULL GROUP BY 1)
SELECT bucket, coalesce(paper_count, 0) AS paper_count, coalesce(total_facts, 0) AS total_facts, coalesce(hallucinated_facts, 0) AS hallucinated_facts,
  coalesce(reference_failures, 0) AS reference_failures, coalesce(content_failures, 0) AS content_failures, coalesce(abstentions, 0) AS abstentions,
  coalesce(verification_errors, 0) AS verification_errors, {FAIL_RATES}
FROM (SELECT unnest(['low_citations', 'high_citations']) AS bucket) v LEFT JOIN (SELECT bucket, count(DISTINCT paper_title) AS paper_count FROM b WHERE bucket IS NOT NULL GROUP BY 1) p USING (bucket) LEFT JOIN s USING (bucket)"""))
def grounding_by_citations(i: Inputs):
    return rounded(M.grounding_by_citations(i.judged(), i.meta()))


AUTHORS_SQL = """, a AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('cat ', CAST(conv_id % 3 AS VARCHAR)) END AS category,
  count(*) AS predicted, count(*) FILTER (WHERE content_grounding LIKE 'Yes%') AS matched FROM judgments_fx GROUP BY conv_id)"""


def _authors(i: Inputs):
    """Predicted names: the claim ids of a conversation; matched: those with supported content."""
    j = i.judgments()
    return j.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("claim_id")).alias("predicted_names"),
        F.sort_array(F.collect_list(F.when(F.col("content_grounding").startswith("Yes"), F.col("claim_id")))
                     ).alias("matched_names"),
    ).select(
        "conv_id", "predicted_names", "matched_names",
        F.expr("CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('cat ', CAST(conv_id % 3 AS STRING)) END").alias("category"),
        L.rate(F.size("matched_names"), F.size("predicted_names")).alias("score"),
        F.lit(None).cast("bigint").alias("predicted_count"), F.lit(None).cast("bigint").alias("matches"))


@query("author_totals", "E8", with_views("judgments_fx", AUTHORS_SQL + """
SELECT coalesce(category, 'Unknown') AS category, 0::BIGINT AS level, count(*) AS conversations, round(avg(matched / CAST(predicted AS DOUBLE)), 6) AS score,
  CAST(sum(matched) AS BIGINT) AS matches, CAST(sum(predicted) AS BIGINT) AS predicted_count FROM a GROUP BY 1
UNION ALL SELECT NULL, 1, count(*), round(avg(matched / CAST(predicted AS DOUBLE)), 6), CAST(sum(matched) AS BIGINT), CAST(sum(predicted) AS BIGINT) FROM a"""))
def author_totals(i: Inputs):
    return rounded(M.author_totals(_authors(i)))


@query("author_names", "E8", with_views("judgments_fx", """
SELECT conv_id, 'predicted' AS kind, claim_id AS name FROM judgments_fx
UNION ALL SELECT conv_id, 'matched', claim_id FROM judgments_fx WHERE content_grounding LIKE 'Yes%'"""))
def author_names(i: Inputs):
    return M.author_names(_authors(i)).select("conv_id", "kind", "name")


# ---- coding reports ------------------------------------------------------------------------

FACTS_SQL = f""", facts AS (SELECT j.*, language, CASE WHEN hallucination = 'Unknown' THEN {IMP} OR {INS} OR {FUN} ELSE hallucination = 'Yes' END AS bad
  FROM judgments_fx j JOIN meta_fx USING (conv_id))"""


def _facts(i: Inputs):
    return M.coding_facts(i.judgments(), i.meta())


@query("coding_totals", "E9", with_views("judgments_fx meta_fx", f"""
{FACTS_SQL} {KIND_SQL.format(src='judgments_fx')},
c AS (SELECT DISTINCT conv_id FROM conversations), x AS (SELECT c.conv_id, n, o, i, s, f FROM c LEFT JOIN p USING (conv_id))
SELECT *, {_rate('overall_hallucinated_responses', 'total_responses')} AS overall_hallucination_rate,
  {_rate('import_hallucinated_responses', 'total_responses')} AS import_hallucination_rate,
  {_rate('install_hallucinated_responses', 'total_responses')} AS install_hallucination_rate,
  {_rate('function_hallucinated_responses', 'total_responses')} AS function_hallucination_rate,
  {_rate('hallucinated_claims', 'total_claims')} AS claim_level_hallucination_rate,
  round(1.0 - overall_hallucinated_responses / CAST(total_responses AS DOUBLE), 6) AS score
FROM (SELECT count(*) AS total_conversations, CAST(sum(n) AS BIGINT) AS total_responses, CAST(sum(o) AS BIGINT) AS overall_hallucinated_responses,
  CAST(sum(i) AS BIGINT) AS import_hallucinated_responses, CAST(sum(s) AS BIGINT) AS install_hallucinated_responses,
  CAST(sum(f) AS BIGINT) AS function_hallucinated_responses, count(*) FILTER (WHERE i > 0) AS conversations_with_import,
  count(*) FILTER (WHERE s > 0) AS conversations_with_install, count(*) FILTER (WHERE f > 0) AS conversations_with_function FROM x) r,
  (SELECT count(*) AS total_claims, count(*) FILTER (WHERE bad) AS hallucinated_claims, count(*) FILTER (WHERE hallucination = 'Skipped') AS skipped_claims FROM facts) q"""))
def coding_totals(i: Inputs):
    return rounded(M.coding_totals(_convs(i), i.judgments()))


@query("coding_by_element_type", "E10", with_views("judgments_fx meta_fx", f"""{FACTS_SQL}
SELECT element_type, count(*) AS total, count(*) FILTER (WHERE bad) AS hallucinated,
  round(count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE), 6) AS hallucination_rate FROM facts GROUP BY 1"""))
def coding_by_element_type(i: Inputs):
    return rounded(M.by_element_type(M.coding_facts(i.judgments())))


LANGUAGE_SQL = f"""SELECT *, {_rate('overall_hallucinated_responses', 'total_responses')} AS overall_hallucination_rate,
  {_rate('import_hallucinated_responses', 'total_responses')} AS import_hallucination_rate,
  {_rate('install_hallucinated_responses', 'total_responses')} AS install_hallucination_rate,
  {_rate('function_hallucinated_responses', 'total_responses')} AS function_hallucination_rate
FROM (SELECT language, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_responses, CAST(sum(coalesce(o, 0)) AS BIGINT) AS overall_hallucinated_responses,
  CAST(sum(coalesce(i, 0)) AS BIGINT) AS import_hallucinated_responses, CAST(sum(coalesce(s, 0)) AS BIGINT) AS install_hallucinated_responses,
  CAST(sum(coalesce(f, 0)) AS BIGINT) AS function_hallucinated_responses FROM meta_fx LEFT JOIN p USING (conv_id) GROUP BY 1) t"""


@query("coding_by_language", "E11 F16", with_views("judgments_fx meta_fx", f"{KIND_SQL.format(src='judgments_fx')} {LANGUAGE_SQL}"))
def coding_by_language(i: Inputs):
    out = M.by_language(i.meta().select("conv_id", "language"), i.judgments())
    return M.order_by_rate(rounded(out), "overall_hallucination_rate", "language")


@query("coding_by_turn", "E12", with_views("judgments_fx meta_fx", f"""{FACTS_SQL},
g AS (SELECT conv_id, turn, bool_or(bad) AS o, bool_or(bad AND element_type = 'import') AS i, bool_or(bad AND element_type = 'install') AS s,
  bool_or(bad AND element_type = 'function_call') AS f FROM facts GROUP BY 1, 2)
SELECT *, {_rate('overall_turns', 'total_turns')} AS overall_rate, {_rate('import_turns', 'total_turns')} AS import_rate,
  {_rate('install_turns', 'total_turns')} AS install_rate, {_rate('function_turns', 'total_turns')} AS function_rate
FROM (SELECT turn, count(*) AS total_turns, count(*) FILTER (WHERE o) AS overall_turns, count(*) FILTER (WHERE i) AS import_turns,
  count(*) FILTER (WHERE s) AS install_turns, count(*) FILTER (WHERE f) AS function_turns FROM g GROUP BY 1) t"""))
def coding_by_turn(i: Inputs):
    return rounded(M.coding_by_turn(M.coding_facts(i.judgments())))


@query("hallucinated_segments", "E13", with_views("judgments_fx meta_fx", f"""{FACTS_SQL}
SELECT conv_id, turn, claim_id, language, element_type FROM facts WHERE bad"""))
def hallucinated_segments(i: Inputs):
    return M.hallucinated_segments(_facts(i)).select("conv_id", "turn", "claim_id", "language", "element_type")


@query("hallucinated_segment_counts", "E13", with_views("judgments_fx meta_fx", f"""{FACTS_SQL}
SELECT 'language' AS axis, language AS grp, count(*) AS n_segments FROM facts WHERE bad GROUP BY 2
UNION ALL SELECT 'element_type', element_type, count(*) FROM facts WHERE bad GROUP BY 2"""))
def hallucinated_segment_counts(i: Inputs):
    facts = _facts(i)
    parts = [
        M.hallucinated_segments(facts, by).select(F.lit(by).alias("axis"), F.col(by).alias("grp"), "n_segments")
        for by in ("language", "element_type")]
    return parts[0].union(parts[1])


# ---- summaries -----------------------------------------------------------------------------


@query("usage_totals", "E24", with_views("judgments_fx meta_fx", """
SELECT model_name, CAST(sum(m) AS BIGINT) AS input_tokens, CAST(sum(m * 2) AS BIGINT) AS output_tokens, CAST(sum(m * 3) AS BIGINT) AS total_tokens,
  0::BIGINT AS cached_tokens, CAST(sum(CASE WHEN m % 2 = 0 THEN m ELSE 0 END) AS BIGINT) AS reasoning_tokens
FROM judgments_fx JOIN meta_fx USING (conv_id) GROUP BY 1"""))
def usage_totals(i: Inputs):
    m = F.col("m")
    usage = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("input_tokens", "output_tokens", "total_tokens", "reasoning_tokens", "odd_key")]),
        F.array(m, m * 2, m * 3, F.when(m % 2 == 0, m), m * 9))
    j = i.judgments().withColumn("token_usage", usage).join(i.meta().select("conv_id", "model_name"), "conv_id")
    return M.usage_totals(j, ["model_name"])


@query("run_summary", "E25", with_views("judged_fx", """
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, count(*) AS claims,
  count(*) FILTER (WHERE hallucination = 'Yes') AS hallucinations,
  round(1.0 - count(*) FILTER (WHERE hallucination = 'Yes') / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS accuracy FROM judged_fx"""))
def run_summary(i: Inputs):
    return rounded(M.run_summary(M.score_conversations(_convs(i), i.judged())))


@query("document_distribution", "E26", """
SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def document_distribution(i: Inputs):
    docs = i.table("documents")
    parts = [M.distribution(docs, c).select(F.lit(c).alias("axis"), F.col(c).alias("value"), "n")
             for c in ("lang", "source")]
    return parts[0].union(parts[1])


@query("leaderboard", "E28", with_views("judgments_fx meta_fx", f"""
, g AS (SELECT task, model_name, CAST(grouping_id(task, model_name) AS BIGINT) AS level, count(*) AS total_facts,
  count(*) FILTER (WHERE NOT {ERR}) AS valid_facts, count(*) FILTER (WHERE NOT {ERR} AND hallucination = 'Yes') AS hallucinated_facts
  FROM judgments_fx JOIN meta_fx USING (conv_id) GROUP BY ROLLUP (task, model_name))
SELECT task, model_name, level, total_facts, valid_facts, hallucinated_facts, round(hallucinated_facts / CAST(valid_facts AS DOUBLE), 6) AS hallucination_rate,
  CASE WHEN level = 0 THEN rank() OVER (PARTITION BY level, task ORDER BY hallucinated_facts / CAST(valid_facts AS DOUBLE)) END AS place FROM g"""))
def leaderboard(i: Inputs):
    return rounded(M.leaderboard(i.judgments(), i.meta()))


@query("leaderboard_coding", "E28", with_views("judgments_fx meta_fx", f"""{KIND_SQL.format(src='judgments_fx')},
g AS (SELECT model_name, count(*) AS conversations, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_responses, CAST(sum(coalesce(o, 0)) AS BIGINT) AS hallucinated_responses
  FROM meta_fx LEFT JOIN p USING (conv_id) GROUP BY 1)
SELECT *, {_rate('hallucinated_responses', 'total_responses')} AS hallucination_rate,
  rank() OVER (ORDER BY hallucinated_responses / CAST(total_responses AS DOUBLE)) AS place FROM g"""))
def leaderboard_coding(i: Inputs):
    return rounded(M.leaderboard_coding(i.meta().select("conv_id", "model_name"), i.judgments()))


# ---- reports from stored records -----------------------------------------------------------


def _stored_claims(i: Inputs):
    """Judgments nested into evaluation records, written, read and cut into claims again; odd conversations list `facts`."""
    path = files.scratch(i.spark, "evaluations")
    records = files.nest_evaluations(i.table("conversations"), i.judgments())
    facts = records.withColumn("details", F.col("details").withField("facts", F.col("details.claim_evaluations")).dropFields("claim_evaluations"))
    files.write_evaluations(records.filter("conversation_id % 2 = 0"), path, fmt="json")
    files.write_evaluations(facts.filter("conversation_id % 2 <> 0"), path, fmt="json")
    return files.claims_of_evaluations(files.read_evaluations(i.spark, path))


@query("evaluation_records", "A3 E1", with_views("judgments_fx", """
, j AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE hallucination = 'Yes') AS y, count(*) FILTER (WHERE snippets_only) AS s FROM judgments_fx GROUP BY 1)
SELECT conv_id AS conversation_id, coalesce(n, 0) AS total_claims, coalesce(y, 0) AS hallucinations, coalesce(s, 0) AS snippets_only_count, coalesce(n, 0) AS listed,
  round(CASE WHEN n > 0 THEN 1.0 - y / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS score
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN j USING (conv_id)"""))
def evaluation_records(i: Inputs):
    records = files.nest_evaluations(i.table("conversations"), i.judgments())
    return rounded(records.select("conversation_id", "details.total_claims", "details.hallucinations", "details.snippets_only_count",
                                  F.size("details.claim_evaluations").cast("bigint").alias("listed"), "score"))


@query("stored_grounding_totals", "A3 E5", ORACLES["grounding_totals"])
def stored_grounding_totals(i: Inputs):
    return rounded(M.grounding_totals(_stored_claims(i)))


@query("stored_grounding_by_turn", "A3 E6", ORACLES["grounding_by_turn"])
def stored_grounding_by_turn(i: Inputs):
    return rounded(M.grounding_by_turn(_stored_claims(i)))


@query("stored_coding_totals", "A3 E9", ORACLES["coding_totals"])
def stored_coding_totals(i: Inputs):
    return rounded(M.coding_totals(_convs(i), _stored_claims(i)))
