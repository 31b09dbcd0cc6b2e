"""Claim columns per domain: validity, search and judging text, prompts, keys, display."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.labels import text

# The code element types.
ELEMENT_TYPES = ("import", "install", "function_call")
NO_RESULTS = "No search results found."


def _filled(name: str) -> Column:
    return ~text(name).isin("", "Unknown")


def _line(label: str, name: str) -> Column:
    """`label: value`, or null (skipped by concat_ws) when the value is blank."""
    return F.when(text(name) != "", F.concat(F.lit(f"{label}: "), text(name)))


def _research_valid() -> Column:
    return _filled("claimed_content")


def _research_text(purpose: str) -> Column:
    def uncited(label: str, name: str) -> Column:
        return F.when(text("full_citation") == "", _line(label, name))

    return F.concat_ws(
        "\n",
        _line("Content", "claimed_content"),
        _line("Citation", "full_citation"),
        uncited("Title", "claimed_title"),
        uncited("Authors", "claimed_authors"),
        uncited("Year", "claimed_year"),
        uncited("URL/DOI", "claimed_url"),
    )


def _legal_valid() -> Column:
    return _filled("content") & _filled("reference_name")


def _legal_text(purpose: str) -> Column:
    holding = F.when(
        text("holding_or_description") == "", F.lit("(Mentioned without description)")
    ).otherwise(text("holding_or_description"))
    return F.concat(
        F.lit("Type: "), F.coalesce(F.col("type"), F.lit("unknown")),
        F.lit("\nReference: "), F.coalesce(F.col("reference_name"), F.lit("Unknown")),
        F.lit("\nHolding/Description: "), holding,
        F.lit("\n\nUser's Full Statement:\n"), text("content"),
    )


def _medical_valid() -> Column:
    return _filled("claimed_content") & _filled("authority")


def _medical_text(purpose: str) -> Column:
    url = F.when(text("claimed_url") != "", F.concat(F.lit("\nURL/DOI: "), text("claimed_url")))
    cite = F.when(text("full_citation") != "", F.concat(F.lit("\nFull Citation: "), text("full_citation")))
    body = F.concat(F.lit("\nClaimed Content: "), text("claimed_content"))
    head = F.concat(F.lit("Authority: "), text("authority"), F.lit("\n"))
    blank = F.lit("")
    if purpose == "search":
        return F.concat(head, F.coalesce(cite, body), F.coalesce(url, blank))
    return F.concat(head, F.coalesce(url, blank), F.coalesce(cite, blank), body)


def _coding_valid() -> Column:
    return (
        text("element_type").isin(*ELEMENT_TYPES)
        & (text("package_name") != "")
        & (text("code_snippet") != "")
    )


def function_name() -> Column:
    """Named function, else the snippet's text before the first bracket, after its last dot."""
    called = F.when(
        text("code_snippet").contains("("),
        F.substring_index(F.substring_index(text("code_snippet"), "(", 1), ".", -1),
    ).otherwise("")
    return F.when(text("function_name") != "", text("function_name")).otherwise(called)


def _coding_text(purpose: str) -> Column:
    kind = text("element_type")
    title = (
        F.when(kind == "import", "import")
        .when(kind == "install", "install")
        .when(kind == "function_call", "function call")
        .otherwise("code element")
    )
    fallback = "see code snippet" if purpose == "search" else "see code"
    called = F.when(
        kind == "function_call",
        F.concat(
            F.lit("Function/Method: "),
            F.when(function_name() == "", fallback).otherwise(function_name()),
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Verification type: "), title),
        F.concat(F.lit("Language: "), text("language")),
        F.concat(F.lit("Package: "), text("package_name")),
        called,
        F.concat(F.lit("Code: "), text("code_snippet")),
    )


@dataclass(frozen=True)
class Domain:
    """What differs between tasks: which claims count and how they read."""

    task: str
    valid: Callable[[], Column]
    text: Callable[[str], Column]


DOMAINS = {
    "research_questions": Domain("research_questions", _research_valid, _research_text),
    "legal_cases": Domain("legal_cases", _legal_valid, _legal_text),
    "medical_guidelines": Domain("medical_guidelines", _medical_valid, _medical_text),
    "coding": Domain("coding", _coding_valid, _coding_text),
}


def domain(task: str) -> Domain:
    try:
        return DOMAINS[task]
    except KeyError:
        raise ValueError(f"unknown task {task!r}; known: {sorted(DOMAINS)}") from None


def register_domain(entry: Domain) -> None:
    """Add a task of the caller's own."""
    DOMAINS[entry.task] = entry


def valid_claims(df: DataFrame, task: str) -> DataFrame:
    """Claims that carry what the task needs to be judged."""
    return df.filter(domain(task).valid())


def claim_text(df: DataFrame, task: str, purpose: str, out: str = "claim_text") -> DataFrame:
    """Add the text a claim is searched (`search`) or judged (`judge`) with."""
    if purpose not in ("search", "judge"):
        raise ValueError("purpose is 'search' or 'judge'")
    return df.withColumn(out, domain(task).text(purpose))


# Placeholders {search}, {evidence} and {claim} are filled per row. Callers pass their own wording.
DEFAULT_TEMPLATES = {
    "full": "Search results:\n{search}\n\nEvidence:\n{evidence}\n\nClaim:\n{claim}",
    "snippets": "Search results:\n{search}\n\nOnly snippets are available.\n\nClaim:\n{claim}",
    "fallback": "Look the claim up on the web.\n\nClaim:\n{claim}",
}


def route_evidence(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Choose the judging route of a claim and assemble its prompt.

    Needs `use_fallback`, `search_text`, `evidence_text`, `claim_text`.
    """
    words = {**DEFAULT_TEMPLATES, **(templates or {})}
    has_snippets = ~text("search_text").isin("", NO_RESULTS)
    route = (
        F.when(~F.col("use_fallback"), "full").when(has_snippets, "snippets").otherwise("fallback")
    )

    def prompt(kind: str) -> Column:
        return _assemble(words[kind], {
            "search": text("search_text"), "evidence": text("evidence_text"), "claim": text("claim_text"),
        })

    no_evidence = F.btrim(text("evidence_text"), F.lit(" \t\n\r")) == ""
    return (
        df.withColumn("route", route)
        .withColumn(
            "prompt",
            F.when(F.col("route") == "full", prompt("full"))
            .when(F.col("route") == "snippets", prompt("snippets"))
            .otherwise(prompt("fallback")),
        )
        .withColumn("snippets_only", no_evidence & has_snippets)
        .withColumn("judge_used_websearch_fallback", F.col("route") == "fallback")
    )


def _assemble(template: str, values: dict[str, Column]) -> Column:
    """Concatenate literal pieces and values, so text in a value is never read as a placeholder."""
    pieces, rest = [], template
    while rest:
        found = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, key = min(found)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[key])
        rest = rest[at + len(key) + 2:]
    return F.concat(*pieces)


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Fill `{name}` places of a template column."""
    filled = F.col(template) if isinstance(template, str) else template
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return filled


def claim_key() -> Column:
    """Key shared by two judges' rows of one claim."""
    first = F.coalesce(F.nullif(text("package_name"), F.lit("")), text("claimed_authors"))
    second = F.coalesce(F.nullif(text("code_snippet"), F.lit("")), text("claimed_year"))
    conv = F.col("conv_id").cast("string")
    return F.when(
        text("claim_id") != "", F.concat_ws("\x1f", conv, text("claim_id"))
    ).otherwise(F.concat_ws("\x1f", conv, F.col("turn").cast("string"), first, second))


def first_filled(*names: str, default: str = "") -> Column:
    return F.coalesce(*[F.nullif(text(n), F.lit("")) for n in names], F.lit(default))


def claim_display(df: DataFrame, n: int = 2000) -> DataFrame:
    """Identifier, display text and shortened content of a claim for reports."""
    by_author = text("claimed_authors") != ""
    return (
        df.withColumn("claim_identifier", first_filled("claimed_authors", "reference_name", "content"))
        .withColumn(
            "display_text",
            F.when(by_author, text("claimed_authors"))
            .otherwise(first_filled("reference_name", "content", default="Unknown")),
        )
        .withColumn("display_detail", F.when(by_author, text("claimed_year")).otherwise(text("type")))
        .withColumn(
            "display_content",
            F.substring(first_filled("holding_or_description", "claimed_content", "original_statement"), 1, n),
        )
    )
