"""Paper and guideline selection, and task detection of a result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.claims import ELEMENT_TYPES
from verdictlake.operators.turns import MIN_ABSTRACT_CHARS
from verdictlake.scale import evaluate_once


def filter_papers(
    df: DataFrame,
    year: int | None = None,
    cited_by_min: int | None = None,
    cited_by_max: int | None = None,
    min_title_words: int | None = None,
    need_doi: bool = True,
    min_abstract: int = MIN_ABSTRACT_CHARS,
) -> DataFrame:
    """Papers of a year, cited more than `cited_by_min` and at most `cited_by_max` times, with DOI and abstract."""
    conditions: list[Column] = [F.length(F.coalesce("abstract", F.lit(""))) > min_abstract]
    if year is not None:
        conditions.append(F.col("publication_year") == year)
    if cited_by_min is not None:
        conditions.append(F.col("cited_by_count") > cited_by_min)
    if cited_by_max is not None:
        conditions.append(F.coalesce("cited_by_count", F.lit(0)) <= cited_by_max)
    if min_title_words is not None:
        words = F.filter(F.split(F.coalesce("title", F.lit("")), r"\s+"), lambda w: w != "")
        conditions.append(F.size(words) >= min_title_words)
    if need_doi:
        conditions.append(F.coalesce("doi", F.lit("")) != "")
    for condition in conditions:
        df = df.filter(condition)
    return df


def clean_authors(names: Column | str) -> Column:
    """Author names without blanks and repeats."""
    column = F.col(names) if isinstance(names, str) else names
    return F.array_distinct(F.filter(column, lambda n: n.isNotNull() & (n != "")))


def word_positions(df: DataFrame, texts: str, out: str) -> DataFrame:
    """`df` plus `out`, the inverted index (word to positions) of the array of texts; rows without words go.

    Words are sorted inside the row and cut where they change, so no word becomes a row of its own.
    """
    def placed(body: Column) -> Column:
        words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
        return F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))

    ordered = evaluate_once(df, "_placed", F.array_sort(F.flatten(F.transform(texts, placed)))).filter(F.size("_placed") > 0)

    def at(k: Column) -> Column:
        return F.get(F.col("_placed"), k)

    places = F.sequence(F.lit(0), F.size("_placed") - 1)
    begins = F.filter(places, lambda k: (k == 0) | (at(k)["w"] != at(k - 1)["w"]))
    cut = evaluate_once(ordered, "_begins", begins)

    def entry(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_begins"), k + 1), F.size("_placed"))
        return F.struct(at(begin)["w"].alias("w"), F.transform(F.sequence(begin, end - 1), lambda p: at(p)["p"]).alias("ps"))

    return cut.select(*df.columns, F.map_from_entries(F.transform("_begins", entry)).alias(out))


def rebuild_abstract(index: Column | str) -> Column:
    """Text of an inverted index (word to positions), words in position order."""
    placed = F.flatten(F.transform(
        F.map_entries(index),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def detect_task(df: DataFrame, task: str | None = None) -> DataFrame:
    """One row naming the kind of a result table: the given task, else what its columns show."""
    flags = [c for c in df.columns if c.startswith("hallucinated_") and c.endswith("_detected")]
    is_code = F.lit(False)
    if "element_type" in df.columns:
        is_code = is_code | F.col("element_type").isin(*ELEMENT_TYPES)
    if flags and "package_name" in df.columns:
        flagged = F.coalesce(*flags).isNotNull()
        is_code = is_code | (flagged & (F.coalesce("package_name", F.lit("")) != ""))
    has_names = F.lit(False)
    if "predicted_names" in df.columns:
        has_names = F.col("predicted_names").isNotNull()
    seen = df.agg(F.coalesce(F.bool_or(is_code), F.lit(False)).alias("c"),
                  F.coalesce(F.bool_or(has_names), F.lit(False)).alias("p"))
    if task is not None:
        return seen.select(F.lit(task).alias("task"))
    return seen.select(F.when(F.col("c"), "coding").when(F.col("p"), "paper_authors").otherwise("grounding").alias("task"))
