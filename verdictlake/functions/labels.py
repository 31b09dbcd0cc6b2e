"""Label columns: grounding text, yes/no flags, verdicts and report classes.

Every function takes and returns Columns, so it stays inside code generation
and filters built from it can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks stripped around labels.
BLANKS = " \t\n\r\x0b\x0c"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def clean(c: Column | str) -> Column:
    """Lower case without surrounding white space, blank for null."""
    return F.lower(F.btrim(text(c), F.lit(BLANKS)))


def parse_grounding(c: Column | str) -> Column:
    """Free judge text to yes / no / na / unknown.

    The rules are tried in order; "Unknown" therefore reads as "no", because it
    contains those letters near its start.
    """
    s = clean(c)
    head = F.substring(s, 1, 50)
    return (
        F.when(s == "", "unknown")
        .when(s.startswith("yes"), "yes")
        .when(s.startswith("no"), "no")
        .when(s.startswith("n/a") | s.contains("could not") | s.contains("cannot verify"), "na")
        .when(head.contains("yes"), "yes")
        .when(head.contains("no"), "no")
        .otherwise("unknown")
    )


def is_yes(c: Column | str, numeric: bool = False) -> Column:
    """True for a boolean true or the words yes / true (and "1" when `numeric`)."""
    words = ["yes", "true"] + (["1"] if numeric else [])
    return clean(c).isin(*words)


def is_verification_error(c: Column | str) -> Column:
    """Yes, true and unknown are failed verifications; a missing value is a success."""
    return clean(c).isin("yes", "true", "unknown")


def reference_failed(c: Column | str) -> Column:
    s = F.lower(text(c))
    return s.startswith("no") | s.isin("unknown", "not found", "false")


def content_failed(c: Column | str) -> Column:
    s = F.lower(text(c))
    return s.startswith("no") | s.isin("unknown", "not grounded", "false")


def human_hallucination(ref: Column | str, content: Column | str) -> Column:
    """Human grounding labels to one hallucination label."""
    r, c = clean(ref), clean(content)
    return (
        F.when((r == "no") | (c == "no"), "yes")
        .when((r == "yes") & (c == "yes"), "no")
        .when(r.isin("", "na", "unknown") & (c == "yes"), "no")
        .otherwise("unknown")
    )


def infer_element_type(declared: Column | str, imp: Column, inst: Column, func: Column) -> Column:
    """Declared element type, else the first raised flag in the order import, install, call."""
    known = F.when(~clean(declared).isin("", "unknown"), text(declared))
    flagged = (
        F.when(F.coalesce(imp, F.lit(False)), "import")
        .when(F.coalesce(inst, F.lit(False)), "install")
        .when(F.coalesce(func, F.lit(False)), "function_call")
    )
    return F.coalesce(known, flagged, F.lit("unknown"))


def resolve_verdict(hallucination: Column | str, imp: Column, inst: Column, func: Column) -> Column:
    """Code claim verdict: the judge's word; the flags count only where it is unknown or blank."""
    word = F.lower(F.coalesce((F.col(hallucination) if isinstance(hallucination, str) else hallucination)
                              .cast("string"), F.lit("unknown")))
    flags = (
        F.coalesce(imp, F.lit(False)) | F.coalesce(inst, F.lit(False)) | F.coalesce(func, F.lit(False))
    )
    return F.when(word.isin("unknown", ""), flags).otherwise(word.isin("yes", "true"))


def citation_bucket(c: Column | str) -> Column:
    n = F.col(c) if isinstance(c, str) else c
    return F.when(n < 50, "low_citations").when(n >= 1000, "high_citations")


def status_class(rate: Column, bad_above: float, good_below: float) -> Column:
    """Report class of a failure rate (high is bad)."""
    return F.when(rate > bad_above, "highlight").when(rate < good_below, "good").otherwise("")


def agreement_class(share: Column, good: float = 0.8, warn: float = 0.6) -> Column:
    return F.when(share > good, "good").when(share > warn, "warning").otherwise("danger")


def result_badge(abstention: Column, hallucination: Column) -> Column:
    """Abstention outranks hallucination, which outranks valid."""
    return (
        F.when(abstention, "Abstention").when(hallucination, "Hallucination").otherwise("Valid")
    )


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def count_true(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")
