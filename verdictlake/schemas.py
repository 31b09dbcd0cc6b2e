"""Fixed schemas of the stored records. Reads never infer."""

from __future__ import annotations

TURN = "STRUCT<role: STRING, content: STRING, turn_index: BIGINT>"

METADATA = (
    "STRUCT<task_name: STRING, model_name: STRING, system_prompt_name: STRING, "
    "conversation_id: BIGINT, timestamp: STRING, "
    "paper_title: STRING, abstract: STRING, research_question: STRING, doi: STRING, arxiv_id: STRING, "
    "publication_year: INT, cited_by_count: BIGINT, created_date: STRING, "
    "question: STRING, question_category: STRING, source: STRING, case_id: STRING, "
    "guideline_text: STRING, language: STRING, task: STRING, prompt_template: STRING, prompt: STRING>"
)

CONVERSATION = (
    f"conversation_id BIGINT, timestamp STRING, turns ARRAY<{TURN}>, task_name STRING, "
    f"model_name STRING, system_prompt_name STRING, metadata {METADATA}"
)

CLAIM_FIELDS = (
    "inferred_source_type", "claimed_content", "full_citation", "claimed_title", "claimed_authors",
    "claimed_year", "claimed_institution", "claimed_url", "type", "content", "reference_name",
    "holding_or_description", "authority", "element_type", "package_name", "code_snippet", "language",
    "function_name", "original_statement", "human_reference_grounding", "human_content_grounding",
    "human_comment",
)
CLAIM_DATA = "STRUCT<" + ", ".join(f"{f}: STRING" for f in CLAIM_FIELDS) + ", not_a_claim: BOOLEAN>"

# A judged claim carries its turn as well.
JUDGED_CLAIM = CLAIM_DATA.removesuffix(">") + ", turn_number: BIGINT>"

CLAIM = (
    f"claim_id STRING, conversation_id BIGINT, turn_number BIGINT, data {CLAIM_DATA}, "
    "metadata MAP<STRING, STRING>"
)

LEGACY_FIELDS = (
    "inferred_source_type", "claimed_content", "full_citation", "claimed_title", "claimed_authors",
    "claimed_year", "claimed_institution", "claimed_url", "human_reference_grounding",
    "human_content_grounding", "human_comment",
)
LEGACY_CLAIM = "STRUCT<" + ", ".join(f"{f}: STRING" for f in LEGACY_FIELDS) + ", not_a_claim: BOOLEAN>"

# One file may mix the old nested rows with rows that are already one claim each.
EXTRACTION = (
    "_type STRING, conv_idx BIGINT, conversation_id BIGINT, turn_number BIGINT, "
    f"original_statement STRING, extracted_claims ARRAY<{LEGACY_CLAIM}>, "
    f"claim_id STRING, data {CLAIM_DATA}, metadata MAP<STRING, STRING>"
)

USAGE = (
    "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, total_tokens: BIGINT, "
    "cached_tokens: BIGINT, reasoning_tokens: BIGINT>"
)

JUDGMENT_FIELDS = (
    "claim_id: STRING, conversation_id: BIGINT, turn_idx: BIGINT, reference_name: STRING, "
    "reference_grounding: STRING, content_grounding: STRING, hallucination: STRING, abstention: STRING, "
    "verification_error: STRING, input_use_fallback: BOOLEAN, judge_used_websearch_fallback: BOOLEAN, "
    "snippets_only: BOOLEAN, hallucinated_import_detected: BOOLEAN, "
    "hallucinated_install_detected: BOOLEAN, hallucinated_function_usage_detected: BOOLEAN, "
    "skipped_early_stopping: BOOLEAN, reason: STRING, search_queries: ARRAY<STRING>, error: STRING, "
    f"claim: {JUDGED_CLAIM}, token_usage: {USAGE}"
)

EVALUATION = (
    "_type STRING, conversation_id BIGINT, score DOUBLE, reasoning STRING, "
    "details STRUCT<total_claims: BIGINT, hallucinations: BIGINT, input_use_fallback_count: BIGINT, "
    "judge_used_websearch_fallback_count: BIGINT, snippets_only_count: BIGINT, total_turns: BIGINT, total_responses: BIGINT, "
    "overall_hallucinated_responses: BIGINT, import_hallucinated_responses: BIGINT, install_hallucinated_responses: BIGINT, "
    "function_hallucinated_responses: BIGINT, "
    f"facts: ARRAY<STRUCT<{JUDGMENT_FIELDS}>>, claim_evaluations: ARRAY<STRUCT<{JUDGMENT_FIELDS}>>>, "
    f"metadata {METADATA}"
)


def judgment_fields() -> list[str]:
    """Names of a judged claim's own fields: not its place, which the record tells, nor the claim itself."""
    names = [f.split(":")[0] for f in JUDGMENT_FIELDS.split(", claim: ")[0].split(", ")]
    return [n for n in [*names, "token_usage"] if n not in ("conversation_id", "turn_idx")]


# What a judge answers for one claim.
JUDGE_RESPONSE = (
    "reference_name STRING, reference_grounding STRING, content_grounding STRING, hallucination STRING, "
    "abstention STRING, verification_error STRING, hallucinated_import_detected BOOLEAN, "
    "hallucinated_install_detected BOOLEAN, hallucinated_function_usage_detected BOOLEAN, reason STRING"
)

ISSUE = "STRUCT<package: STRING, function: STRING, code: STRING, reason: STRING>"

TURN_VERDICT = (
    f"has_hallucination BOOLEAN, hallucinated_imports ARRAY<{ISSUE}>, "
    f"hallucinated_installs ARRAY<{ISSUE}>, hallucinated_function_calls ARRAY<{ISSUE}>, reasoning STRING"
)

HIT = (
    "STRUCT<title: STRING, link: STRING, snippet: STRING, position: BIGINT, date: STRING, "
    "attributes: MAP<STRING, STRING>>"
)
