"""Parsing of model answers: claims, judge responses, verdicts, plans, match pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.functions.claims import domain, first_filled
from verdictlake.functions.labels import BLANKS, text
from verdictlake.scale import evaluate_once


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def unfence(c: Column | str) -> Column:
    """Body of the first json fence, else of the first fence, else the text itself."""
    # Each pattern takes the whole text apart, and leaves a text without its fence as it is.
    tagged = F.regexp_replace(text(c), r"(?s)\A.*?```json(.*?)(?:```.*)?\z", "$1")
    return _strip(F.regexp_replace(tagged, r"(?s)\A.*?```(.*?)(?:```.*)?\z", "$1"))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repair_escapes(c: Column) -> Column:
    """Double the backslash of escapes JSON does not know; text that parses is left alone."""
    # An odd backslash, after any escaped pairs, before a character that needs no escape.
    stray = r'(?<!\\)((?:\\\\)*)\\(?=[^"\\/bfnrtu\n])'
    fixed = F.regexp_replace(c, stray, r"$1\\\\")
    return F.when(is_json(c), c).otherwise(fixed)


def parse_judgments(
    raw: DataFrame, response: str = "response", repair: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Judge answers to judgment rows, and the rows that could not be parsed.

    Unparsed rows carry a failed verification and the best reference name their claim offers.
    """
    body = unfence(response)
    if repair:
        body = repair_escapes(body)
    parsed = evaluate_once(
        evaluate_once(raw, "_body", body), "_r",
        F.when(is_json(F.col("_body")) & F.col("_body").startswith("{"),
               F.from_json("_body", schemas.JUDGE_RESPONSE)))
    keep = raw.columns
    defaults = {
        "reference_name": "Unknown", "reference_grounding": "Unknown", "content_grounding": "Unknown",
        "hallucination": "Unknown", "abstention": "Unknown", "verification_error": "No", "reason": "",
    }
    flags = ("hallucinated_import_detected", "hallucinated_install_detected", "hallucinated_function_usage_detected")
    good = parsed.filter("_r IS NOT NULL").select(
        *keep,
        *[F.coalesce(F.col(f"_r.{n}"), F.lit(d)).alias(n) for n, d in defaults.items()],
        *[F.coalesce(F.col(f"_r.{n}"), F.lit(False)).alias(n) for n in flags])
    names = [n for n in ("authority", "reference_name", "claimed_title") if n in raw.columns]
    fallback = first_filled(*names, default="Unknown") if names else F.lit("Unknown")
    # The labels of an answer that could not be read.
    failed = "Error - Failed to evaluate"
    bad = parsed.filter("_r IS NULL").select(
        *[c for c in keep if c != "reference_name"], fallback.alias("reference_name"),
        F.lit(failed).alias("reference_grounding"), F.lit(failed).alias("content_grounding"),
        F.lit("Unknown").alias("hallucination"), F.lit("Unknown").alias("abstention"),
        F.lit("Yes").alias("verification_error"), F.lit("JSON parse error").alias("error"))
    return good, bad


def parse_rate(good: DataFrame, bad: DataFrame, by: str = "model_name") -> DataFrame:
    """Share of answers that parsed, per model."""
    marked = good.select(by, F.lit(1).alias("ok")).unionByName(bad.select(by, F.lit(0).alias("ok")))
    return marked.groupBy(by).agg(F.count("*").alias("n"), F.avg("ok").alias("parse_rate"))


def parse_turn_verdicts(raw: DataFrame, response: str = "response") -> DataFrame:
    """Direct verdicts: fenced object, else flat object naming the verdict, else outermost braces, else empty."""
    raw = evaluate_once(raw, "_s", _strip(text(response)))
    s = F.col("_s")
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    flat = F.regexp_extract(s, r'(?s)\{[^{}]*"has_hallucination"[^{}]*\}', 0)
    first = F.instr(s, "{")
    last = F.length(s) - F.instr(F.reverse(s), "}") + 1
    outer = F.when((first > 0) & s.contains("}"), F.substring(s, first, last - first + 1))

    def usable(c: Column) -> Column:
        return F.when(is_json(c) & c.startswith("{"), c)

    body = F.coalesce(usable(fenced), usable(flat), usable(outer))
    parsed = evaluate_once(evaluate_once(raw, "_body", body), "_v", F.from_json("_body", schemas.TURN_VERDICT))
    lists = ("hallucinated_imports", "hallucinated_installs", "hallucinated_function_calls")
    empty = F.from_json(F.lit("[]"), f"ARRAY<{schemas.ISSUE}>")
    out = parsed.withColumns({
        "has_hallucination": F.coalesce("_v.has_hallucination", F.lit(False)),
        **{n: F.coalesce(F.col(f"_v.{n}"), empty) for n in lists},
        "reasoning": F.when(F.col("_v").isNull(), F.concat(
            F.lit("Failed to parse response: "), F.substring("_s", 1, 500))).otherwise(
                F.coalesce("_v.reasoning", F.lit(""))),
        "parsed": F.col("_v").isNotNull(),
    })
    return out.withColumns({
        "hallucinated_import_detected": F.size(lists[0]) > 0,
        "hallucinated_install_detected": F.size(lists[1]) > 0,
        "hallucinated_function_usage_detected": F.size(lists[2]) > 0,
    }).drop("_s", "_body", "_v")


def parse_claims(raw: DataFrame, task: str, response: str = "response", statement: str = "text") -> DataFrame:
    """Extractor answers (a list or one object) to valid claims with repeatable ids.

    `raw` carries conv_id and turn; the id is derived from them and the place in the answer.
    """
    element = schemas.CLAIM_DATA
    body = repair_escapes(unfence(response))
    items = F.when(F.col("_b").startswith("["), F.from_json("_b", f"ARRAY<{element}>")).when(
        F.col("_b").startswith("{"), F.array(F.from_json("_b", element)))
    rows = evaluate_once(raw, "_b", body).filter(is_json(F.col("_b"))).select(
        "conv_id", "turn", F.col(statement).alias("original_statement"), F.posexplode(items).alias("pos", "c"))
    fields = [f for f in schemas.CLAIM_FIELDS if f != "original_statement"]
    flat = rows.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("claim_idx"), "original_statement",
        F.md5(F.concat_ws(":", "conv_id", "turn", "pos")).alias("claim_id"),
        *[F.col(f"c.{f}").alias(f) for f in fields])
    return flat.filter(domain(task).valid())


def parse_search_plan(raw: DataFrame, response: str = "response") -> DataFrame:
    """Planner answers: go on?, query, url references; the fallback query is the first fenced block."""
    body = repair_escapes(unfence(response))
    plan = "continue_searching BOOLEAN, search_query STRING, relevant_urls ARRAY<STRING>"
    fenced = _strip(F.regexp_extract(text(response), r"(?s)```(?:\w+)?\s*(.*?)```", 1))
    parsed = evaluate_once(
        evaluate_once(raw, "_b", body), "_p",
        F.when(is_json(F.col("_b")) & F.col("_b").startswith("{"), F.from_json("_b", plan)))
    failed = F.col("_p").isNull()
    return parsed.select(
        *raw.columns,
        F.when(failed, fenced != "").otherwise(F.coalesce("_p.continue_searching", F.lit(False))
                                               ).alias("continue_searching"),
        F.when(failed, F.nullif(fenced, F.lit(""))).otherwise(F.col("_p.search_query")).alias("search_query"),
        F.coalesce("_p.relevant_urls", F.array().cast("array<string>")).alias("relevant_urls"))


def parse_match_pairs(raw: DataFrame, response: str = "response") -> DataFrame:
    """`(i, j)` pairs of an answer, 0-based; positions outside 1..n_a and 1..n_b are dropped."""
    pattern = r"\((\d+),\s*(\d+)\)"
    pairs = F.arrays_zip(
        F.regexp_extract_all(response, F.lit(pattern), 1).alias("i"),
        F.regexp_extract_all(response, F.lit(pattern), 2).alias("j"))
    found = raw.select("conv_id", "turn", "n_a", "n_b", F.explode(pairs).alias("p")).select(
        "conv_id", "turn", "n_a", "n_b", (F.col("p.i").try_cast("bigint") - 1).alias("a_pos"),
        (F.col("p.j").try_cast("bigint") - 1).alias("b_pos"))
    inside = "a_pos >= 0 AND a_pos < n_a AND b_pos >= 0 AND b_pos < n_b"
    return found.filter(inside).select("conv_id", "turn", "a_pos", "b_pos")


def apply_task_validation(tasks: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Keep, replace or skip tasks by a validator's answer; counts per language.

    VALID keeps, `INVALID: other` replaces (skips when nothing follows), anything else keeps.
    """
    s = _strip(text(answer))
    invalid = F.upper(s).startswith("INVALID:")
    other = _strip(F.substring(s, F.instr(s, ":") + F.lit(1), F.length(s)))
    status = F.when(~invalid, "kept").when(other != "", "replaced").otherwise("skipped")
    marked = tasks.withColumn("status", status).withColumn("task", F.when(invalid, other).otherwise(F.col("task")))
    stats = marked.groupBy("language").agg(*[
        F.count_if(F.col("status") == k).alias(k) for k in ("kept", "replaced", "skipped")])
    return marked.filter("status <> 'skipped'"), stats
