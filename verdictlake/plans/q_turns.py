"""Queries: sources, turns, claim payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.functions import claims as C
from verdictlake.functions import labels as L
from verdictlake.operators import turns as T
from verdictlake.plans.fixtures import Inputs, with_views
from verdictlake.plans.registry import query
from verdictlake.sources import files


# ---- sources -------------------------------------------------------------------------------


@query("conversations_round_trip", "A1 A2", "SELECT conv_id, turn, role, text FROM conversations")
def conversations_round_trip(i: Inputs):
    path = files.scratch(i.spark, "conversations")
    files.write_conversations(files.nest_turns(i.table("conversations")), path, task_name="t", model_name="m")
    return files.flatten_turns(files.read_conversations(i.spark, path))


@query("conversations_lifted_metadata", "A1", """
SELECT conv_id, 'coding' AS task_name, concat('m', CAST(conv_id % 5 AS VARCHAR)) AS model_name,
  conv_id AS meta_conversation_id, count(*) AS n_turns
FROM conversations GROUP BY conv_id""")
def conversations_lifted_metadata(i: Inputs):
    nested = files.nest_turns(i.table("conversations"))
    model = F.concat(F.lit("m"), (F.col("conversation_id") % 5).cast("string"))
    stale = F.struct(F.lit("stale").alias("task_name"), model.alias("model_name"))
    path = files.scratch(i.spark, "lifted")
    files.write_conversations(nested.withColumn("metadata", stale), path, task_name="coding")
    back = files.read_conversations(i.spark, path)
    return back.select(
        F.col("conversation_id").alias("conv_id"), "metadata.task_name", "metadata.model_name",
        F.col("metadata.conversation_id").alias("meta_conversation_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
    )


@query("evaluations_read", "A3 A5", with_views("judgments_fx", """
SELECT conv_id, count(*) AS n_claims, count(*) FILTER (WHERE hallucination = 'Yes') AS n_yes
FROM judgments_fx GROUP BY conv_id"""))
def evaluations_read(i: Inputs):
    """Tagged evaluations next to malformed and untagged lines; only the valid tagged ones count."""
    j = i.judgments()
    item = F.struct("claim_id", F.col("conv_id").alias("conversation_id"), "hallucination")
    evals = j.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_claims"), F.collect_list(item).alias("claim_evaluations")
    ).select(
        F.col("conv_id").alias("conversation_id"), F.lit(1.0).alias("score"),
        F.struct("total_claims", "claim_evaluations").alias("details"),
    )
    path = files.scratch(i.spark, "evals")
    files.write_evaluations(evals, path, fmt="json")
    files.write_extractions(evals.drop("score"), path, fmt="json")
    evals.select(F.concat(F.lit('{"_type": "evaluation_result", "score": 1, "broken" '),
                          F.col("conversation_id").cast("string")).alias("value")).write.mode("append").text(
        path + "/bad")
    rows = files.read_evaluations(i.spark, path + "{,/bad}", strict=False)
    flat = rows.select(F.col("conversation_id").alias("conv_id"), F.explode("details.claim_evaluations").alias("e"))
    return flat.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_claims"), L.count_true(F.col("e.hallucination") == "Yes").alias("n_yes")
    )


@query("valid_prefix_rows", "A4", with_views("claims_fx", """
, c AS (SELECT *, conv_id % 8 AS bucket FROM claims_fx),
bad AS (SELECT bucket, min((conv_id, turn, claim_idx)) AS bad_at FROM c WHERE h % 97 = 5 GROUP BY bucket)
SELECT conv_id, turn, claim_idx, claim_id FROM c LEFT JOIN bad USING (bucket)
WHERE bad_at IS NULL OR (conv_id, turn, claim_idx) < bad_at"""))
def valid_prefix_rows(i: Inputs):
    """Checkpoint lines of all claims in eight ordered files, each cut at its first broken line."""
    path = files.scratch(i.spark, "prefix")
    line = F.to_json(F.struct("conv_id", "turn", "claim_idx", "claim_id"))
    broken = F.col("h") % 97 == 5
    claims = i.claims().withColumn("bucket", F.col("conv_id") % 8)
    ordered = claims.repartition(8, "bucket").sortWithinPartitions("bucket", "conv_id", "turn", "claim_idx")
    ordered.select("bucket", F.when(broken, F.lit('{"conv_id": 1, ')).otherwise(line).alias("value")).write.partitionBy(
        "bucket").text(path)
    return files.read_valid_prefix(i.spark, path, "conv_id BIGINT, turn BIGINT, claim_idx BIGINT, claim_id STRING")


@query("claim_cache_round_trip", "A6", with_views("payload_fx", """
SELECT claim_id, conv_id, turn, claimed_content, full_citation, claimed_year FROM payload_fx"""))
def claim_cache_round_trip(i: Inputs):
    claims = i.payload().select(
        "claim_id", F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_number"),
        F.struct("claimed_content", "full_citation", "claimed_year").alias("data"),
    )
    path = files.scratch(i.spark, "cache")
    files.write_claims(claims, path)
    return files.read_claims(i.spark, path).select(
        "claim_id", F.col("conversation_id").alias("conv_id"), F.col("turn_number").alias("turn"),
        "data.claimed_content", "data.full_citation", "data.claimed_year",
    )


def _legacy_rows(i: Inputs):
    """Even conversations in the old nested form, odd ones already one claim per row, plus unknown rows."""
    p = i.payload()
    item = F.struct(
        "claim_idx", "claimed_content", "claimed_title", "claimed_year",
        F.when(F.col("h") % 3 == 0, "yes").alias("human_reference_grounding"),
    )
    nested = (
        p.filter("conv_id % 2 = 0").groupBy("conv_id", "turn")
        .agg(F.sort_array(F.collect_list(item)).alias("extracted_claims"))
        .select(
            F.lit("extraction_result").alias("_type"),
            F.when(F.col("conv_id") % 4 == 0, F.col("conv_id")).alias("conversation_id"),
            F.col("conv_id").alias("conv_idx"), F.col("turn").alias("turn_number"), "extracted_claims",
        )
    )
    single = p.filter("conv_id % 2 = 1").select(
        "claim_id", F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_number"),
        F.struct("claimed_content", "claimed_title", "claimed_year").alias("data"),
    )
    unknown = i.meta().select(F.lit("other").alias("_type"), F.col("conv_id").alias("conversation_id"))
    path = files.scratch(i.spark, "legacy")
    for part in (nested, single, unknown):
        part.write.mode("append").json(path)
    return i.spark.read.schema(schemas.EXTRACTION).json(path)


@query("normalized_extractions", "A7", with_views("payload_fx", """
SELECT conv_id AS conversation_id, turn AS turn_number, claimed_content, claimed_title, claimed_year,
  CASE WHEN conv_id % 2 = 0 AND h % 3 = 0 THEN 'yes' END AS human_reference_grounding
FROM payload_fx"""))
def normalized_extractions(i: Inputs):
    claims, _ = files.normalize_extractions(_legacy_rows(i))
    return claims.select(
        "conversation_id", "turn_number", "data.claimed_content", "data.claimed_title", "data.claimed_year",
        "data.human_reference_grounding",
    )


@query("normalized_extraction_counts", "A7", with_views("payload_fx", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM payload_fx WHERE conv_id % 2 = 0) t)
     + count(*) FILTER (WHERE conv_id % 2 = 1) + (SELECT count(DISTINCT conv_id) FROM conversations) AS input_lines,
  (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM payload_fx WHERE conv_id % 2 = 0) t) AS extraction_results,
  count(*) AS claims_converted, (SELECT count(DISTINCT conv_id) FROM conversations) AS skipped_lines,
  count(*) FILTER (WHERE conv_id % 2 = 0 AND h % 3 = 0) AS human_annotations_preserved
FROM payload_fx"""))
def normalized_extraction_counts(i: Inputs):
    return files.normalize_extractions(_legacy_rows(i))[1]


@query("latest_annotations", "A8", """
SELECT conv_id AS conv_idx, turn AS turn_number, (conv_id + 2 * turn) % 4 AS n_claims
FROM conversations WHERE role = 'assistant' AND (conv_id + 2 * turn) % 4 > 0""")
def latest_annotations(i: Inputs):
    """Every assistant turn is saved three times; the third save decides, and may clear the turn."""
    turns = i.table("conversations").filter("role = 'assistant'")
    log = turns.select(
        F.col("conv_id").alias("conv_idx"), F.col("turn").alias("turn_number"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"),
    ).withColumn("size", (F.col("conv_idx") + F.col("seq") * F.col("turn_number")) % 4).select(
        "conv_idx", "turn_number", "seq",
        F.expr("filter(array(1, 2, 3), x -> x <= size)").alias("extracted_claims"),
    )
    state = files.latest_annotations(log)
    return state.select("conv_idx", "turn_number", F.size("extracted_claims").cast("bigint").alias("n_claims"))


@query("line_list", "A9", """
SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS value FROM benchmark WHERE trim(text) <> ''""")
def line_list(i: Inputs):
    """Benchmark texts as a task list, between blank and comment lines."""
    path = files.scratch(i.spark, "tasks")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    i.table("benchmark").select(
        F.concat(F.lit("# item\n\n  "), text, F.lit("  \n   \n")).alias("value")
    ).write.text(path)
    return files.read_line_list(i.spark, path)


@query("study_csv_round_trip", "A10", with_views("payload_fx", """
SELECT claim_id, conv_id, turn, concat(claim_text, chr(10), '"quoted", ', authority) AS note FROM payload_fx"""))
def study_csv_round_trip(i: Inputs):
    path = files.scratch(i.spark, "study")
    note = F.concat("claim_text", F.lit('\n"quoted", '), "authority").alias("note")
    files.write_study_csv(i.payload().select("claim_id", "conv_id", "turn", note), path)
    return files.read_study_csv(i.spark, path, "claim_id STRING, conv_id BIGINT, turn BIGINT, note STRING")


@query("questions_two_sources", "A11", """
SELECT question, question_category, origin, case_id FROM (
  SELECT text AS question, source AS question_category, 'bulk' AS origin, doc_id AS case_id,
    row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE source IN ('src1', 'src2', 'src3')
  UNION ALL
  SELECT text, 'src1', 'local', item_id, row_number() OVER (ORDER BY item_id) FROM benchmark) t
WHERE rn <= 25""")
def questions_two_sources(i: Inputs):
    bulk = i.table("documents").select(
        F.col("text").alias("question"), F.col("source").alias("question_category"), F.col("doc_id").alias("case_id"))
    local = i.table("benchmark").select(
        F.col("text").alias("question"), F.lit("src1").alias("question_category"), F.col("item_id").alias("case_id"))
    return files.load_questions({"bulk": bulk, "local": local}, "case_id", ["src1", "src2", "src3"], 25)


@query("file_inventory", "A12", "SELECT source AS name, count(*) AS entries FROM documents GROUP BY source")
def file_inventory(i: Inputs):
    """One line file per document source, blank lines between; rows counted per file."""
    path = files.scratch(i.spark, "inventory")
    text = F.concat(F.col("doc_id").cast("string"), F.lit("\n   "))
    i.table("documents").select("source", text.alias("value")).write.partitionBy("source").text(path)
    files_seen = files.file_inventory(i.spark, path + "/*")
    return files_seen.groupBy(F.regexp_extract("file", "source=([^/]+)/", 1).alias("name")).agg(
        F.sum("entries").alias("entries"))


@query("latest_snapshot", "A13", """
SELECT conv_id, turn FROM conversations WHERE role = 'assistant'""")
def latest_snapshot(i: Inputs):
    """Two snapshots of the conversations; only the newer, larger one is read back."""
    base = files.scratch(i.spark, "snapshots")
    nested = files.nest_turns(i.table("conversations"))
    older = files.nest_turns(i.table("conversations").filter("role = 'user'"))
    older.write.json(base + "/conversations_m_1convs")
    nested.write.json(base + "/conversations_m_2convs")
    newest = files.latest_snapshot(i.spark, base + "/conversations_m_*convs")
    return files.flatten_turns(newest).filter("role = 'assistant'").select("conv_id", "turn")


@query("report_items", "A14", with_views("payload_fx", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) - 1 AS item_idx,
  concat('Claim ', claim_id) AS fact_id, claim_text, concat('Ref ', type, '|', language) AS badges, authority AS reasoning
FROM payload_fx"""))
def report_items(i: Inputs):
    item = F.concat(
        F.lit('<div class="result-item"><div class="head"><h4> Claim '), "claim_id",
        F.lit('</h4></div>\n<div class="claim-text"> <b>'), "claim_text",
        F.lit('</b></div>\n<div class="status-badges"><span class="badge ok">Ref <i>'), "type",
        F.lit('</i></span><span class="badge">'), "language",
        F.lit('</span></div><div class="reasoning"><p>'), "authority", F.lit("</p> </div></div>"),
    )
    pages = i.payload().groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_idx", item.alias("x")))),
                                 lambda s: s["x"]), "\n").alias("html"))
    pages = pages.withColumn("page_id", F.struct("conv_id", "turn"))
    return files.extract_report_items(pages).select(
        "page_id.conv_id", "page_id.turn", "item_idx", "fact_id", "claim_text",
        F.array_join("badges", "|").alias("badges"), "reasoning")


# ---- turns ---------------------------------------------------------------------------------


@query("assistant_turns_message_index", "B1", """
SELECT conv_id, turn, turn_number, length(text) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_number FROM conversations) t
WHERE role = 'assistant'""")
def assistant_turns_message_index(i: Inputs):
    return T.assistant_turns(i.table("conversations"), "message_index").select(
        "conv_id", "turn", "turn_number", F.length("text").cast("bigint").alias("n"))


@query("assistant_turns_ordinal", "B1", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number
FROM conversations WHERE role = 'assistant'""")
def assistant_turns_ordinal(i: Inputs):
    return T.assistant_turns(i.table("conversations"), "assistant_ordinal").select("conv_id", "turn", "turn_number")


@query("assistant_turns_stored", "B1", """
SELECT conv_id, turn, turn AS turn_number FROM conversations WHERE role = 'assistant'""")
def assistant_turns_stored(i: Inputs):
    return T.assistant_turns(i.table("conversations"), "stored").select("conv_id", "turn", "turn_number")


@query("previous_message", "B2", """
SELECT conv_id, turn, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS user_question FROM conversations""")
def previous_message(i: Inputs):
    return T.with_previous(i.table("conversations")).select("conv_id", "turn", "user_question")


@query("long_enough_texts", "B3", """
SELECT 'assistant' AS kind, conv_id AS id FROM conversations WHERE role = 'assistant' AND length(text) >= 20
UNION ALL SELECT 'guideline', doc_id FROM documents WHERE length(trim(text, E' \\t\\n\\r')) >= 50
UNION ALL SELECT 'abstract', doc_id FROM documents WHERE length(text) > 200
UNION ALL SELECT 'page', page_id FROM pages WHERE length(trim(html, E' \\t\\n\\r')) >= 100""")
def long_enough_texts(i: Inputs):
    docs = i.table("documents")
    kept = [
        ("assistant", T.min_length(i.table("conversations").filter("role = 'assistant'"), "text",
                                   T.MIN_ASSISTANT_CHARS, strip=False), "conv_id"),
        ("guideline", T.min_length(docs, "text", T.MIN_GUIDELINE_CHARS), "doc_id"),
        ("abstract", T.min_length(docs, "text", T.MIN_ABSTRACT_CHARS, strict=True, strip=False), "doc_id"),
        ("page", T.min_length(i.table("pages"), "html", T.MIN_PAGE_CHARS), "page_id"),
    ]
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, df, key in kept]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("conversation_prefixes", "B4", """
SELECT conv_id, turn, 1 + count(*) OVER w AS n_messages,
  string_agg(CASE WHEN role = 'user' THEN concat('User: ', text, ' (cite)') ELSE concat('Assistant: ', text) END, chr(10)) OVER w AS prefix
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def conversation_prefixes(i: Inputs):
    with_system = T.conversation_prefix(i.table("conversations"), system="Be exact.", suffix=" (cite)")
    return with_system.select(
        "conv_id", "turn", F.size("prefix").cast("bigint").alias("n_messages"),
        T.prefix_text(F.slice("prefix", F.lit(2), F.size("prefix"))).alias("prefix"))


@query("unblocked_conversations", "B19", """
SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (
  SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND contains(b.text, 'rec')
    AND (b.role = 'assistant' OR b.turn = (SELECT min(turn) FROM conversations f WHERE f.conv_id = b.conv_id)))""")
def unblocked_conversations(i: Inputs):
    return T.drop_blocked(i.table("conversations"), "rec").select("conv_id", "turn", "role")


# ---- claims --------------------------------------------------------------------------------


@query("valid_claims_per_task", "B5 I2", with_views("payload_fx", """
SELECT 'research_questions' AS task, claim_id FROM payload_fx WHERE claimed_content NOT IN ('', 'Unknown')
UNION ALL SELECT 'legal_cases', claim_id FROM payload_fx WHERE content NOT IN ('', 'Unknown') AND reference_name NOT IN ('', 'Unknown')
UNION ALL SELECT 'medical_guidelines', claim_id FROM payload_fx WHERE claimed_content NOT IN ('', 'Unknown') AND authority NOT IN ('', 'Unknown')
UNION ALL SELECT 'coding', claim_id FROM payload_fx WHERE element_type IN ('import', 'install', 'function_call') AND package_name <> '' AND code_snippet <> ''"""))
def valid_claims_per_task(i: Inputs):
    # One scan: a claim may be valid for several tasks.
    flags = F.array(*[F.when(C.domain(t).valid(), F.lit(t)) for t in sorted(C.DOMAINS)])
    return i.payload().select(F.explode(F.array_compact(flags)).alias("task"), "claim_id")


@query("claim_texts", "B6", with_views("payload_fx", """
SELECT claim_id,
  concat_ws(chr(10), CASE WHEN claimed_content <> '' THEN concat('Content: ', claimed_content) END,
    CASE WHEN full_citation <> '' THEN concat('Citation: ', full_citation) END,
    CASE WHEN full_citation = '' AND claimed_title <> '' THEN concat('Title: ', claimed_title) END,
    CASE WHEN full_citation = '' AND claimed_authors <> '' THEN concat('Authors: ', claimed_authors) END,
    CASE WHEN full_citation = '' AND claimed_year <> '' THEN concat('Year: ', claimed_year) END,
    CASE WHEN full_citation = '' AND claimed_url <> '' THEN concat('URL/DOI: ', claimed_url) END) AS research,
  concat('Type: ', type, chr(10), 'Reference: ', reference_name, chr(10), 'Holding/Description: ',
    CASE WHEN holding_or_description = '' THEN '(Mentioned without description)' ELSE holding_or_description END,
    chr(10), chr(10), 'User''s Full Statement:', chr(10), content) AS legal,
  concat('Authority: ', authority, chr(10),
    CASE WHEN full_citation <> '' THEN concat(chr(10), 'Full Citation: ', full_citation) ELSE concat(chr(10), 'Claimed Content: ', claimed_content) END,
    CASE WHEN claimed_url <> '' THEN concat(chr(10), 'URL/DOI: ', claimed_url) ELSE '' END) AS medical_search,
  concat('Authority: ', authority, chr(10),
    CASE WHEN claimed_url <> '' THEN concat(chr(10), 'URL/DOI: ', claimed_url) ELSE '' END,
    CASE WHEN full_citation <> '' THEN concat(chr(10), 'Full Citation: ', full_citation) ELSE '' END,
    chr(10), 'Claimed Content: ', claimed_content) AS medical_judge,
  CASE WHEN function_name <> '' THEN function_name WHEN contains(code_snippet, '(')
    THEN list_last(string_split(string_split(code_snippet, '(')[1], '.')) ELSE '' END AS function_called,
  concat('Verification type: ', CASE element_type WHEN 'function_call' THEN 'function call' WHEN 'other' THEN 'code element' ELSE element_type END,
    chr(10), 'Language: ', language, chr(10), 'Package: ', package_name,
    CASE WHEN element_type = 'function_call' THEN concat(chr(10), 'Function/Method: ', CASE WHEN function_name <> '' THEN function_name
      ELSE list_last(string_split(string_split(code_snippet, '(')[1], '.')) END) ELSE '' END,
    chr(10), 'Code: ', code_snippet) AS coding
FROM payload_fx"""))
def claim_texts(i: Inputs):
    return i.payload().select(
        "claim_id",
        C.domain("research_questions").text("judge").alias("research"),
        C.domain("legal_cases").text("judge").alias("legal"),
        C.domain("medical_guidelines").text("search").alias("medical_search"),
        C.domain("medical_guidelines").text("judge").alias("medical_judge"),
        C.function_name().alias("function_called"),
        C.domain("coding").text("judge").alias("coding"),
    )


@query("routed_evidence", "B7", with_views("payload_fx", """
, e AS (SELECT claim_id, claimed_content AS claim_text, h % 2 = 1 AS use_fallback,
  CASE h % 3 WHEN 0 THEN '' WHEN 1 THEN 'No search results found.' ELSE concat('hit ', authority) END AS s,
  CASE WHEN h % 4 = 0 THEN content ELSE ' ' END AS v FROM payload_fx)
SELECT claim_id, CASE WHEN NOT use_fallback THEN 'full' WHEN s NOT IN ('', 'No search results found.') THEN 'snippets' ELSE 'fallback' END AS route,
  CASE WHEN NOT use_fallback THEN concat('S:', s, ' E:', v, ' C:', claim_text)
    WHEN s NOT IN ('', 'No search results found.') THEN concat('only ', s, ' for ', claim_text) ELSE concat('search ', claim_text) END AS prompt,
  trim(v) = '' AND s NOT IN ('', 'No search results found.') AS snippets_only,
  use_fallback AND s IN ('', 'No search results found.') AS judge_used_websearch_fallback
FROM e"""))
def routed_evidence(i: Inputs):
    base = i.payload().select(
        "claim_id", F.col("claimed_content").alias("claim_text"), (F.col("h") % 2 == 1).alias("use_fallback"),
        F.expr("CASE h % 3 WHEN 0 THEN '' WHEN 1 THEN 'No search results found.' ELSE concat('hit ', authority) END"
               ).alias("search_text"),
        F.expr("CASE WHEN h % 4 = 0 THEN content ELSE ' ' END").alias("evidence_text"),
    )
    words = {"full": "S:{search} E:{evidence} C:{claim}", "snippets": "only {search} for {claim}",
             "fallback": "search {claim}"}
    return C.route_evidence(base, words).select(
        "claim_id", "route", "prompt", "snippets_only", "judge_used_websearch_fallback")


@query("claim_display_fields", "B15 B16", with_views("payload_fx", """
SELECT claim_id, CASE WHEN claimed_authors <> '' THEN claimed_authors WHEN reference_name <> '' THEN reference_name ELSE content END AS claim_identifier,
  CASE WHEN claimed_authors <> '' THEN claimed_authors WHEN reference_name <> '' THEN reference_name ELSE content END AS display_text,
  CASE WHEN claimed_authors <> '' THEN claimed_year ELSE type END AS display_detail,
  substr(CASE WHEN holding_or_description <> '' THEN holding_or_description ELSE claimed_content END, 1, 500) AS display_content,
  CASE WHEN h % 2 = 0 THEN concat_ws('/', conv_id, claim_id)
    ELSE concat_ws('/', conv_id, turn, package_name, CASE WHEN code_snippet <> '' THEN code_snippet ELSE claimed_year END) END AS claim_key
FROM payload_fx"""))
def claim_display_fields(i: Inputs):
    shown = C.claim_display(i.payload().withColumn("original_statement", F.lit("")), 500)
    anonymous = shown.withColumn("id", F.col("claim_id")).withColumn(
        "claim_id", F.when(F.col("h") % 2 == 0, F.col("claim_id")).otherwise(""))
    key = F.translate(C.claim_key(), "\x1f", "/")
    return anonymous.select(F.col("id").alias("claim_id"), "claim_identifier", "display_text", "display_detail",
                            "display_content", key.alias("claim_key"))
