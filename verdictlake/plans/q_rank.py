"""Queries: work lists, first-n and samples, deduplication, order-dependent judging, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.operators import ranking as K
from verdictlake.operators import resume as R
from verdictlake.operators import setops as S
from verdictlake.operators import stateful as Z
from verdictlake.plans.fixtures import Inputs, with_views
from verdictlake.plans.q_reports import FUN, IMP, INS, _authors, _convs
from verdictlake.plans.registry import query, rounded

CONVS = "convs AS (SELECT DISTINCT conv_id FROM conversations)"

# ---- resume --------------------------------------------------------------------------------


@query("restricted_claims", "D4", with_views("cache_fx", """
SELECT claim_id, conv_id FROM cache_fx WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')"""))
def restricted_claims(i: Inputs):
    current = i.table("conversations").filter("role = 'system'").select("conv_id").distinct()
    return R.restrict_claims(i.cache(), current).select("claim_id", "conv_id")


@query("unjudged_claims", "D5", with_views("cache_fx judged_fx", """
SELECT claim_id, conv_id FROM cache_fx WHERE claim_id NOT IN (SELECT claim_id FROM judged_fx)"""))
def unjudged_claims(i: Inputs):
    return R.unjudged(i.cache(), i.judged()).select("claim_id", "conv_id")


@query("unextracted_conversations", "D6", with_views("cache_fx", """
SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM cache_fx)"""))
def unextracted_conversations(i: Inputs):
    return R.unextracted(_convs(i), i.cache())


@query("incomplete_conversations", "D12", with_views("cache_fx judged_fx", f"""
, {CONVS}, e AS (SELECT conv_id, count(*) AS expected FROM cache_fx GROUP BY 1), j AS (SELECT conv_id, count(*) AS judged FROM judged_fx GROUP BY 1)
SELECT conv_id, coalesce(expected, 0) AS expected, coalesce(judged, 0) AS judged FROM convs LEFT JOIN e USING (conv_id) LEFT JOIN j USING (conv_id)
WHERE coalesce(judged, 0) = 0 OR (coalesce(expected, 0) > 0 AND judged < expected)"""))
def incomplete_conversations(i: Inputs):
    return R.incomplete(_convs(i), i.cache(), i.judged())


PDF_SQL = """, p AS (SELECT claim_id, h, CAST(k AS BIGINT) AS pdf_idx, concat('https://ex.org/', CAST(h % 17 + k AS VARCHAR), '.pdf') AS url, (h + k) % 5 <> 0 AS success,
  CASE WHEN (h + k) % 7 = 0 THEN '' ELSE concat('pdf of ', claim_id) END AS content FROM claims_fx, LATERAL (SELECT unnest([0, 1]) AS k) x WHERE k < h % 3),
ct AS (SELECT claim_id, CAST(k AS BIGINT) AS source_idx, concat('title ', k) AS title, concat('https://ex.org/', k) AS url, claim_text AS content FROM claims_fx, LATERAL (SELECT unnest([0, 1]) AS k) x)"""


def _contents(i: Inputs):
    c = i.claims()
    pair = F.explode(F.array(F.lit(0), F.lit(1)))
    contents = c.select(
        "claim_id", pair.alias("source_idx"), F.col("claim_text").alias("content"), (F.col("h") % 3 % 2 + F.col("h") % 3).alias("expected")
    ).withColumns({"title": F.concat(F.lit("title "), F.col("source_idx").cast("string")),
                   "url": F.concat(F.lit("https://ex.org/"), F.col("source_idx").cast("string"))})
    pdfs = c.select("claim_id", "h", pair.alias("pdf_idx")).filter("pdf_idx < h % 3").selectExpr(
        "claim_id", "pdf_idx", "concat('https://ex.org/', CAST(h % 17 + pdf_idx AS STRING), '.pdf') AS url",
        "(h + pdf_idx) % 5 <> 0 AS success", "CASE WHEN (h + pdf_idx) % 7 = 0 THEN '' ELSE concat('pdf of ', claim_id) END AS content")
    return contents, pdfs


@query("contents_with_pdfs", "D8", with_views("claims_fx", PDF_SQL + """
SELECT claim_id, source_idx, title, url, content FROM ct UNION ALL SELECT claim_id, 2 + pdf_idx, 'PDF', url, content FROM p WHERE success AND content <> ''"""))
def contents_with_pdfs(i: Inputs):
    return R.attach_pdfs(*_contents(i))[0]


@query("content_completeness", "D8", with_views("claims_fx", """
SELECT claim_id, CAST(h % 3 % 2 + h % 3 AS BIGINT) AS expected, CAST(h % 3 AS BIGINT) AS received, h % 3 >= h % 3 % 2 + h % 3 AS complete FROM claims_fx"""))
def content_completeness(i: Inputs):
    return R.attach_pdfs(*_contents(i))[1]


def _whitelist(i: Inputs):
    """Well-known packages as the caller lists them, next to the standard library."""
    listed = [("numpy", True, "Python"), ("opencv-python", True, "Python"), ("pyyaml", True, "Python"), ("mix", False, "Elixir")]
    own = R.package_table(i.spark, listed)
    return own.unionByName(R.python_stdlib(i.spark))


@query("known_packages", "D9", with_views("payload_fx", """
SELECT claim_id, CASE element_type WHEN 'import' THEN package_name IN ('numpy', 'cv2', 'yaml')
  WHEN 'install' THEN package_name IN ('numpy', 'cv2', 'yaml') AND NOT contains(code_snippet, '==') ELSE FALSE END AS known FROM payload_fx"""))
def known_packages(i: Inputs):
    return R.match_known_packages(i.payload(), _whitelist(i)).select("claim_id", "known")


@query("prompt_grid", "D11 B22", """
SELECT item_id, language, template_id, replace(replace(t, '{language}', language), '{task}', text) AS prompt
FROM benchmark, (SELECT unnest(['Python', 'R']) AS language) l, (SELECT unnest(['In {language}: {task}', 'Solve {task} with {language}']) AS t, unnest([0::BIGINT, 1::BIGINT]) AS template_id) p""")
def prompt_grid(i: Inputs):
    return _grid(i).select("item_id", "language", "template_id", "prompt")


def _grid(i: Inputs):
    return R.prompt_grid(i.table("benchmark"), ["Python", "R"], ["In {language}: {task}", "Solve {task} with {language}"], task="text")


@query("author_matches", "D14", with_views("judgments_fx", """
SELECT conv_id, claim_id AS name, content_grounding LIKE 'Yes%' AS matched,
  round(count(*) FILTER (WHERE content_grounding LIKE 'Yes%') OVER (PARTITION BY conv_id) / CAST(count(*) OVER (PARTITION BY conv_id) AS DOUBLE), 6) AS match_rate FROM judgments_fx"""))
def author_matches(i: Inputs):
    return rounded(R.author_matches(_authors(i)))


@query("next_unannotated", "D15", with_views("cache_fx", """
, o AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM cache_fx))
SELECT min((conv_id, turn))[1] AS conv_id, min((conv_id, turn))[2] AS turn, count(*) AS remaining FROM o"""))
def next_unannotated(i: Inputs):
    return R.next_unannotated(i.table("conversations").filter("role = 'assistant'"), i.cache().select("conv_id", "turn").distinct())


# ---- first-n and samples -------------------------------------------------------------------


@query("first_n_per_language", "F1", with_views("meta_fx", """
SELECT conv_id, language FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY conv_id) AS rn FROM meta_fx) t WHERE rn <= 7"""))
def first_n_per_language(i: Inputs):
    return K.first_n_per(i.meta(), "language", ["conv_id"], 7).select("conv_id", "language")


@query("first_n_conversations", "F2", "SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 30")
def first_n_conversations(i: Inputs):
    return K.first_n(_convs(i), ["conv_id"], 30)


@query("sampled_documents", "F3", "SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 100")
def sampled_documents(i: Inputs):
    return K.sample_n(i.table("documents"), 100, 42, ["doc_id"]).select("doc_id", "lang")


@query("sampled_claims_per_turn", "F4", with_views("claims_fx", """
SELECT claim_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5(concat('42:', claim_id)), claim_id) AS rn FROM claims_fx) t WHERE rn <= 5"""))
def sampled_claims_per_turn(i: Inputs):
    return K.sample_per_turn(i.claims(), 5, 42).select("claim_id")


@query("claims_per_category", "F5", with_views("judgments_fx", """
SELECT claim_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, element_type ORDER BY turn, claim_idx) AS rn FROM judgments_fx) t WHERE rn <= 3"""))
def claims_per_category(i: Inputs):
    return K.limit_per_category(i.judgments(), 3).select("claim_id")


def _even_sql(key: str, n: int) -> str:
    return f"""WITH r AS (SELECT doc_id, {key} AS stratum, md5(concat('7:', doc_id)) AS k, row_number() OVER (PARTITION BY {key} ORDER BY md5(concat('7:', doc_id)), doc_id) AS rn,
  count(*) OVER (PARTITION BY {key}) AS c FROM documents),
p AS (SELECT CAST(floor({n} / count(DISTINCT stratum)) AS BIGINT) AS share, count(DISTINCT stratum) AS s FROM r),
m AS (SELECT coalesce(sum(greatest(share - c, 0)), 0) + {n} % any_value(s) AS missing FROM (SELECT DISTINCT stratum, c FROM r) d, p),
pool AS (SELECT doc_id, stratum, row_number() OVER (ORDER BY k, doc_id) AS pr FROM r, p WHERE rn > share)
SELECT doc_id, stratum FROM r, p WHERE rn <= share UNION ALL SELECT doc_id, stratum FROM pool, m WHERE pr <= missing"""


@query("even_sample_over_sources", "F6", _even_sql("source", 110))
def even_sample_over_sources(i: Inputs):
    return K.stratified_even(i.table("documents"), "source", 110, 7, ["doc_id"]).select("doc_id", F.col("source").alias("stratum"))


@query("even_sample_over_languages", "F6", _even_sql("lang", 600))
def even_sample_over_languages(i: Inputs):
    """Three languages are short of their share; the fourth makes up for them."""
    return K.stratified_even(i.table("documents"), "lang", 600, 7, ["doc_id"]).select("doc_id", F.col("lang").alias("stratum"))


@query("sampled_grid", "F7", """
SELECT item_id, language, template_id FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5(concat_ws(':', 3, item_id, language, template_id)), item_id) AS rn
FROM benchmark, (SELECT unnest(['Python', 'R']) AS language) l, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS template_id) p) t WHERE rn <= 12""")
def sampled_grid(i: Inputs):
    return K.sample_grid(_grid(i), 12, 3, ["item_id", "language", "template_id"]).select("item_id", "language", "template_id")


@query("sampled_papers", "F8", with_views("papers_fx", """
SELECT doc_id FROM papers_fx WHERE cited_by_count > 300 AND doi IS NOT NULL AND length(abstract) > 200 ORDER BY md5(concat('5:', doc_id)), doc_id LIMIT 60"""))
def sampled_papers(i: Inputs):
    return K.sample_papers(i.papers(), 60, 5, cited_by_min=300).select("doc_id")


@query("next_prompt_slice", "F19", """
SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) d
LEFT JOIN (SELECT lang, count(*) AS have FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) h USING (lang)
WHERE rn > coalesce(have, 0) AND rn <= 90""")
def next_prompt_slice(i: Inputs):
    prompts = i.table("documents").select("doc_id", F.col("lang").alias("language"))
    done = prompts.join(i.table("labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return K.next_slice(prompts, done, 90, ["doc_id"])


@query("remaining_prompts", "F19", """
SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) d
LEFT JOIN (SELECT lang, count(*) AS have FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) h USING (lang) WHERE rn > coalesce(have, 0)""")
def remaining_prompts(i: Inputs):
    prompts = i.table("documents").select("doc_id", F.col("lang").alias("language"))
    done = prompts.join(i.table("labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return K.next_slice(prompts, done, None, ["doc_id"])


# Greedy deduplication, one row after the other: the state holds the keys taken so far.
DEDUP_SQL = """, o AS (SELECT doc_id, doi, title, row_number() OVER (ORDER BY doc_id) AS rn FROM papers_fx),
walk AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS doc_id, FALSE AS keep, []::VARCHAR[] AS dois, []::VARCHAR[] AS titles
  UNION ALL SELECT o.rn, o.doc_id, NOT (coalesce(list_contains(dois, doi), FALSE) OR list_contains(titles, title)),
    CASE WHEN NOT (coalesce(list_contains(dois, doi), FALSE) OR list_contains(titles, title)) AND doi IS NOT NULL THEN list_append(dois, doi) ELSE dois END,
    CASE WHEN NOT (coalesce(list_contains(dois, doi), FALSE) OR list_contains(titles, title)) THEN list_append(titles, title) ELSE titles END
  FROM walk JOIN o ON o.rn = walk.rn + 1)"""


@query("deduplicated_papers", "F13", with_views("papers_fx", DEDUP_SQL + " SELECT doc_id FROM walk WHERE keep").replace("WITH ", "WITH RECURSIVE ", 1))
def deduplicated_papers(i: Inputs):
    return K.dedup_any_key(i.papers(), ["doi", "title"], "doc_id").select("doc_id")


@query("target_papers", "F20", with_views("papers_fx", DEDUP_SQL + " SELECT doc_id FROM walk WHERE keep ORDER BY doc_id LIMIT 80").replace("WITH ", "WITH RECURSIVE ", 1))
def target_papers(i: Inputs):
    return K.take_target(i.papers(), 80, ["doi", "title"], "doc_id").select("doc_id")


@query("ordered_facts", "F15", with_views("judgments_fx", """
, k AS (SELECT claim_id, CASE WHEN h % 23 = 0 THEN concat('conv_', CAST(conv_id AS VARCHAR)) ELSE CAST(conv_id AS VARCHAR) END AS conv_id,
  CASE WHEN h % 19 = 0 THEN NULL ELSE CAST(turn AS VARCHAR) END AS turn FROM judgments_fx)
SELECT claim_id, row_number() OVER (ORDER BY try_cast(conv_id AS BIGINT) NULLS LAST, conv_id, try_cast(turn AS BIGINT) NULLS LAST, claim_id) AS fact_number FROM k"""))
def ordered_facts(i: Inputs):
    named = i.judgments().selectExpr(
        "claim_id", "CASE WHEN h % 23 = 0 THEN concat('conv_', CAST(conv_id AS STRING)) ELSE CAST(conv_id AS STRING) END AS conv_id",
        "CASE WHEN h % 19 = 0 THEN NULL ELSE CAST(turn AS STRING) END AS turn")
    return K.order_facts(named, ["claim_id"]).select("claim_id", "fact_number")


@query("numbered_claims", "F18", with_views("claims_fx", """
SELECT claim_id, rn AS claim_number, concat('Claim #', rn, ' - Conv ', conv_id, ' Turn ', turn) AS fact_id
FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn, claim_idx) AS rn FROM claims_fx) t"""))
def numbered_claims(i: Inputs):
    return K.number_claims(i.claims(), ["conv_id", "turn"], "claim_idx").select("claim_id", "claim_number", "fact_id")


# ---- order-dependent judging ---------------------------------------------------------------

# Claim by claim: a bit set of detected types per turn.
STOP_SQL = f""", c AS (SELECT conv_id, turn, claim_id, element_type, CASE element_type WHEN 'import' THEN 1 WHEN 'install' THEN 2 ELSE 4 END AS bit,
  CASE WHEN {IMP} THEN 1 ELSE 0 END + CASE WHEN {INS} THEN 2 ELSE 0 END + CASE WHEN {FUN} THEN 4 ELSE 0 END AS mask, hallucination,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) AS rn FROM judgments_fx),
walk AS (SELECT conv_id, turn, 0::BIGINT AS rn, NULL::VARCHAR AS claim_id, 0 AS s, FALSE AS skip FROM (SELECT DISTINCT conv_id, turn FROM c) t
  UNION ALL SELECT c.conv_id, c.turn, c.rn, c.claim_id, CASE WHEN w.s & c.bit <> 0 THEN w.s ELSE w.s | c.mask END, w.s & c.bit <> 0
  FROM walk w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn AND c.rn = w.rn + 1)"""


@query("early_stopped_claims", "F9", with_views("judgments_fx", STOP_SQL + """
SELECT claim_id, skip AS skipped_early_stopping, CASE WHEN skip THEN 'Skipped' ELSE hallucination END AS hallucination, NOT skip AND mask & 1 <> 0 AS hallucinated_import_detected
FROM walk JOIN c USING (claim_id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def early_stopped_claims(i: Inputs):
    return Z.early_stop(i.judgments()).select("claim_id", "skipped_early_stopping", "hallucination", IMP)


def _packages(i: Inputs):
    """Judgments with the package each claim names and the snippet it came from."""
    p = i.payload().select("claim_id", "package_name", "code_snippet")
    return i.judgments().join(p, "claim_id")


REUSE_SQL = f""", j AS (SELECT j.*, p.code_snippet, CASE p.package_name WHEN 'cv2' THEN 'opencv-python' WHEN 'sklearn' THEN 'scikit-learn' WHEN 'PIL ' THEN 'pillow' WHEN 'yaml' THEN 'pyyaml'
  WHEN 'bs4' THEN 'beautifulsoup4' ELSE p.package_name END AS pkg FROM judgments_fx j JOIN payload_fx p USING (claim_id)),
f AS (SELECT pkg, min((conv_id, turn, claim_idx)) AS place, arg_min(NOT CASE WHEN element_type = 'import' THEN {IMP} ELSE {INS} END, (conv_id, turn, claim_idx)) AS ex
  FROM j WHERE element_type IN ('import', 'install') GROUP BY 1),
u AS (SELECT j.*, ex, (element_type = 'import' OR (element_type = 'install' AND NOT contains(code_snippet, '=='))) AS asked,
  coalesce((element_type = 'import' OR (element_type = 'install' AND NOT contains(code_snippet, '=='))) AND (conv_id, turn, claim_idx) > place, FALSE) AS reused FROM j LEFT JOIN f USING (pkg))"""


@query("reused_verdicts", "F10", with_views("judgments_fx payload_fx", REUSE_SQL + f"""
SELECT claim_id, reused, CASE WHEN reused THEN ex END AS package_exists, CASE WHEN reused THEN CASE WHEN ex THEN 'No' ELSE 'Yes' END ELSE hallucination END AS hallucination,
  CASE WHEN reused THEN element_type = 'import' AND NOT ex ELSE {IMP} END AS hallucinated_import_detected,
  CASE WHEN reused THEN element_type = 'install' AND NOT ex ELSE {INS} END AS hallucinated_install_detected FROM u"""))
def reused_verdicts(i: Inputs):
    return Z.reuse_verdicts(_packages(i)).select("claim_id", "reused", "package_exists", "hallucination", IMP, INS)


KNOWN_SQL = """CASE element_type WHEN 'import' THEN package_name IN ('numpy', 'cv2', 'yaml')
  WHEN 'install' THEN package_name IN ('numpy', 'cv2', 'yaml') AND NOT contains(code_snippet, '==') ELSE FALSE END"""


@query("resolved_package_claims", "D9 F9 F10", with_views("judgments_fx payload_fx", f"""
, k AS (SELECT * EXCLUDE (h, package_name, code_snippet), {KNOWN_SQL} AS known, code_snippet, CASE package_name WHEN 'cv2' THEN 'opencv-python' WHEN 'sklearn' THEN 'scikit-learn' WHEN 'PIL ' THEN 'pillow'
    WHEN 'yaml' THEN 'pyyaml' WHEN 'bs4' THEN 'beautifulsoup4' ELSE package_name END AS pkg
  FROM (SELECT j.*, p.package_name, p.code_snippet FROM judgments_fx j JOIN payload_fx p USING (claim_id)) a),
f AS (SELECT pkg, min((conv_id, turn, claim_idx)) AS place, arg_min(NOT CASE WHEN element_type = 'import' THEN {IMP} ELSE {INS} END, (conv_id, turn, claim_idx)) AS ex
  FROM k WHERE element_type IN ('import', 'install') AND NOT known GROUP BY 1),
u AS (SELECT k.*, ex, coalesce(NOT known AND (element_type = 'import' OR (element_type = 'install' AND NOT contains(code_snippet, '=='))) AND (conv_id, turn, claim_idx) > place, FALSE) AS reused FROM k LEFT JOIN f USING (pkg))
SELECT claim_id, known, reused, CASE WHEN known THEN 'No' WHEN reused AND ex THEN 'No' WHEN reused THEN 'Yes' ELSE hallucination END AS hallucination,
  CASE WHEN known THEN 'Verified - Whitelisted package' WHEN reused AND ex THEN 'Verified - Cached verdict (exists)' WHEN reused THEN 'Verified - Cached verdict (does NOT exist)' ELSE reference_grounding END AS reference_grounding,
  CASE WHEN known OR reused THEN 'No' ELSE verification_error END AS verification_error FROM u"""))
def resolved_package_claims(i: Inputs):
    """Known packages first, then verdicts reused from earlier claims."""
    known = R.match_known_packages(_packages(i), _whitelist(i)).drop("package_key")
    out = Z.known_verdicts(Z.reuse_verdicts(known))
    return out.select("claim_id", "known", "reused", "hallucination", "reference_grounding", "verification_error")


# Claim by claim over the whole table: types detected in the turn, packages found to exist or not.
RESOLVE_SQL = f""", k AS MATERIALIZED (SELECT claim_id, conv_id, turn, element_type, hallucination, {KNOWN_SQL} AS known, h % 13 = 4 AS failed,
  CASE package_name WHEN 'cv2' THEN 'opencv-python' WHEN 'sklearn' THEN 'scikit-learn' WHEN 'PIL ' THEN 'pillow' WHEN 'yaml' THEN 'pyyaml' WHEN 'bs4' THEN 'beautifulsoup4' ELSE package_name END AS pkg,
  element_type IN ('import', 'install') AS named, element_type = 'import' OR (element_type = 'install' AND NOT contains(code_snippet, '==')) AS asked,
  CASE element_type WHEN 'import' THEN 1 WHEN 'install' THEN 2 ELSE 4 END AS bit, NOT CASE WHEN element_type = 'import' THEN {IMP} ELSE {INS} END AS found,
  CASE WHEN {IMP} THEN 1 ELSE 0 END + CASE WHEN {INS} THEN 2 ELSE 0 END + CASE WHEN {FUN} THEN 4 ELSE 0 END AS mask,
  row_number() OVER (ORDER BY conv_id, turn, claim_idx) AS rn
  FROM (SELECT j.*, p.package_name, p.code_snippet FROM judgments_fx j JOIN payload_fx p USING (claim_id)) a),
walk AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS claim_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, 0 AS s, []::VARCHAR[] AS good, []::VARCHAR[] AS bad, NULL::VARCHAR AS outcome
  UNION ALL
  SELECT k.rn, k.claim_id, k.conv_id, k.turn, CASE WHEN y.outcome = 'judged' AND NOT failed THEN x.s | mask ELSE x.s END,
    CASE WHEN y.outcome = 'judged' AND NOT failed AND named AND NOT list_contains(w.good || w.bad, pkg) AND found THEN list_append(w.good, pkg) ELSE w.good END,
    CASE WHEN y.outcome = 'judged' AND NOT failed AND named AND NOT list_contains(w.good || w.bad, pkg) AND NOT found THEN list_append(w.bad, pkg) ELSE w.bad END, y.outcome
  FROM walk w JOIN k ON k.rn = w.rn + 1,
    LATERAL (SELECT CASE WHEN k.conv_id = w.conv_id AND k.turn = w.turn THEN w.s ELSE 0 END AS s) x,
    LATERAL (SELECT CASE WHEN known THEN 'known' WHEN asked AND list_contains(w.good, pkg) THEN 'exists' WHEN asked AND list_contains(w.bad, pkg) THEN 'missing'
      WHEN x.s & bit <> 0 THEN 'skipped' ELSE 'judged' END AS outcome) y)"""
RESOLVED_SQL = RESOLVE_SQL + """
SELECT claim_id, known, outcome IN ('exists', 'missing') AS reused, outcome = 'skipped' AS skipped_early_stopping,
  CASE outcome WHEN 'known' THEN 'No' WHEN 'exists' THEN 'No' WHEN 'missing' THEN 'Yes' WHEN 'skipped' THEN 'Skipped' ELSE hallucination END AS hallucination FROM walk JOIN k USING (claim_id)"""


@query("resolved_coding_claims", "D9 F9 F10", with_views("judgments_fx payload_fx", RESOLVED_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def resolved_coding_claims(i: Inputs):
    return _resolved(i).select("claim_id", "known", "reused", "skipped_early_stopping", "hallucination")


def _resolved(i: Inputs):
    """Known, reused, skipped and judged claims in one order; every thirteenth judgment failed."""
    answers = _packages(i).withColumn("error", F.when(F.col("h") % 13 == 4, "timeout"))
    known = R.match_known_packages(answers, _whitelist(i)).drop("package_key")
    return Z.resolve_coding_claims(known)


@query("skip_statistics", "E27", with_views("judgments_fx payload_fx", RESOLVE_SQL + """,
w AS (SELECT k.*, outcome FROM walk JOIN k USING (claim_id)),
t AS (SELECT bit_or(CASE WHEN outcome = 'judged' AND NOT failed THEN mask ELSE 0 END) AS got FROM w GROUP BY conv_id, turn)
SELECT (SELECT count(*) FROM t WHERE got <> 0) AS turns_tracked, (SELECT count(*) FROM t WHERE got = 7) AS turns_fully_stopped,
  count(*) FILTER (WHERE outcome = 'skipped') AS claims_skipped, count(*) FILTER (WHERE outcome IN ('exists', 'missing')) AS cache_hits,
  count(*) FILTER (WHERE asked AND outcome = 'judged') AS cache_misses, count(*) FILTER (WHERE known) AS whitelist_skips,
  count(DISTINCT CASE WHEN named AND NOT known THEN pkg END) AS cached_packages FROM w""").replace("WITH ", "WITH RECURSIVE ", 1))
def skip_statistics(i: Inputs):
    """Counts of the joint order, known packages included."""
    return Z.skip_stats(_resolved(i))


def _evidence(i: Inputs):
    """Claims: the first vector of each label. Blocks: pairs of a vector and a text, dealt in turn until both tables are used up."""
    e = i.table("embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("f"))
    claims = first.select(F.col("label").alias("claim_id"), F.col("f.vec_id").alias("own"), "f.embedding")
    texts = i.table("documents").select("doc_id", F.col("text").alias("block"), "source")
    vectors, documents = e.count(), texts.count()
    pairs = i.spark.range(max(vectors, documents)).select(
        F.col("id").alias("block_idx"), (F.col("id") % max(vectors, 1)).alias("vec_id"), (F.col("id") % max(documents, 1)).alias("doc_id"))
    blocks = pairs.join(e, "vec_id").join(texts, "doc_id").join(
        claims.select("claim_id", "own"), F.col("label") == F.col("claim_id")).filter("vec_id <> own")
    return claims.select("claim_id", "embedding"), blocks.select("claim_id", "block_idx", "block", "embedding", "source")


EVIDENCE_SQL = """, ec AS (SELECT label AS claim_id, min(vec_id) AS own FROM embeddings GROUP BY 1),
ek AS (SELECT k AS block_idx, k % (SELECT count(*) FROM embeddings) AS vec_id, k % (SELECT count(*) FROM documents) AS doc_id
  FROM (SELECT unnest(range((SELECT greatest((SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents))))) AS k) r),
eb AS (SELECT ec.claim_id, ek.block_idx, d.text AS block, d.source, CAST(b.embedding AS DOUBLE[]) AS emb, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS sim
  FROM ec JOIN embeddings a ON a.vec_id = ec.own JOIN embeddings b ON b.label = ec.claim_id AND b.vec_id <> ec.own JOIN ek ON ek.vec_id = b.vec_id JOIN documents d USING (doc_id))"""


@query("ranked_blocks", "F11", "WITH" + EVIDENCE_SQL[1:] + """
SELECT claim_id, block_idx, place, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY sim DESC, block_idx) AS place FROM eb) t WHERE place <= 20""")
def ranked_blocks(i: Inputs):
    scored = Z.score_blocks(*_evidence(i))
    return rounded(Z.rank_blocks(scored, 20).select("claim_id", "block_idx", "place", "similarity"))


WALK_SQL = "WITH RECURSIVE" + EVIDENCE_SQL[1:] + """,
ev AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY sim DESC, block_idx) AS rn,
  list_filter(string_split_regex(block, '\\s+'), lambda x: x <> '') AS tok FROM eb),
walk AS (SELECT claim_id, 0::BIGINT AS rn, NULL::BIGINT AS block_idx, NULL::VARCHAR AS block, NULL::BOOLEAN AS truncated, 0::BIGINT AS words, 0::BIGINT AS step, FALSE AS done, []::DOUBLE[][] AS held, FALSE AS picked FROM ec
  UNION ALL
  SELECT w.claim_id, ev.rn, ev.block_idx, CASE WHEN x.fits THEN ev.block ELSE concat(array_to_string(tok[:1500 - w.words], ' '), '...') END, NOT x.fits,
    CASE WHEN x.fresh AND x.fits THEN w.words + len(tok) ELSE w.words END, CASE WHEN w.picked THEN w.step + 1 ELSE w.step END,
    x.fresh AND NOT x.fits, CASE WHEN x.fresh AND x.fits THEN list_append(held, emb) ELSE held END,
    x.fresh AND (x.fits OR 1500 - w.words > 10)
  FROM walk w JOIN ev ON ev.claim_id = w.claim_id AND ev.rn = w.rn + 1,
    LATERAL (SELECT len(list_filter(held, lambda e: list_cosine_similarity(e, emb) > 0.85)) = 0 AS fresh, w.words + len(tok) <= 1500 AS fits) x
  WHERE NOT w.done)"""


@query("selected_evidence", "F11", WALK_SQL + """
SELECT claim_id, step, block_idx, block, truncated FROM walk WHERE picked""")
def selected_evidence(i: Inputs):
    claims, blocks = _evidence(i)
    return Z.select_evidence(claims, blocks)


@query("evidence_texts", "F11", WALK_SQL + """
, s AS (SELECT claim_id, source, concat('-- Source: ', source, ', url: u/', source, ' --', chr(10), string_agg(w.block, concat(chr(10), chr(10)) ORDER BY step)) AS t
  FROM walk w JOIN eb USING (claim_id, block_idx) WHERE picked GROUP BY claim_id, source)
SELECT claim_id, string_agg(t, concat(chr(10), chr(10)) ORDER BY source) AS evidence_text FROM s GROUP BY 1""")
def evidence_texts(i: Inputs):
    claims, blocks = _evidence(i)
    picks = Z.select_evidence(claims, blocks)
    sources = blocks.select("claim_id", "block_idx", F.col("source").alias("source_idx"), F.col("source").alias("title"),
                            F.concat(F.lit("u/"), "source").alias("url"), F.lit("").alias("snippet"))
    return Z.assemble_evidence(picks, sources)


# ---- unions --------------------------------------------------------------------------------


@query("merged_results", "G1", with_views("judgments_fx judged_fx", f"""
, {CONVS}, j AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE hallucination = 'Yes') AS y FROM
  (SELECT * FROM judged_fx UNION ALL SELECT * FROM judgments_fx WHERE claim_id NOT IN (SELECT claim_id FROM judged_fx)) u GROUP BY 1)
SELECT conv_id, coalesce(n, 0) AS total_claims, coalesce(y, 0) AS hallucinations, round(CASE WHEN n > 0 THEN 1.0 - y / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS score FROM convs LEFT JOIN j USING (conv_id)"""))
def merged_results(i: Inputs):
    """An interrupted run's judgments and those of the claims it had left."""
    new = R.unjudged(i.judgments(), i.judged())
    return rounded(S.merge_results(_convs(i), i.judged(), new).select("conv_id", "total_claims", "hallucinations", "score"))


@query("verdict_claims", "G2", with_views("verdicts_fx", """
, x AS (SELECT *, 'import' AS kind, unnest(imports) AS pkg, generate_subscripts(imports, 1) AS k FROM verdicts_fx WHERE has_hallucination
  UNION ALL SELECT *, 'install', unnest(installs), generate_subscripts(installs, 1) FROM verdicts_fx WHERE has_hallucination
  UNION ALL SELECT *, 'function_call', unnest(functions), generate_subscripts(functions, 1) FROM verdicts_fx WHERE has_hallucination)
SELECT conv_id, turn, concat('turn-', conv_id, '-', turn, '-', CASE kind WHEN 'function_call' THEN 'function' ELSE kind END, '-', pkg, CASE WHEN kind = 'function_call' THEN concat('-fn', k) ELSE '' END) AS claim_id,
  'Yes' AS hallucination, kind AS element_type, pkg AS package_name, CASE WHEN kind = 'function_call' THEN concat('fn', k) END AS function_name, concat('code ', k) AS code_snippet, 'not found' AS reason FROM x
UNION ALL SELECT conv_id, turn, concat('turn-', conv_id, '-', turn, '-verified'), 'No', 'unknown', NULL, NULL, NULL, 'checked' FROM verdicts_fx WHERE NOT has_hallucination"""))
def verdict_claims(i: Inputs):
    return S.verdicts_to_claims(i.verdicts()).select(
        "conv_id", "turn", "claim_id", "hallucination", "element_type", "package_name", "function_name", "code_snippet", "reason")


@query("appended_conversations", "G5", """
SELECT conv_id, turn, role, NULL AS lang FROM conversations UNION ALL SELECT doc_id + 1000000, 0, 'user', lang FROM documents""")
def appended_conversations(i: Inputs):
    new = i.table("documents").select((F.col("doc_id") + 1000000).alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
                                      F.lit("user").alias("role"), "lang")
    return S.append_conversations(i.table("conversations").select("conv_id", "turn", "role"), new)
