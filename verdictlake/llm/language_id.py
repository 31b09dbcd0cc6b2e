"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood comes from hashed character trigrams counted per language over all
training documents. What a page declares in its markup and the suffix of its address are
further observations, whose distributions per language are estimated from the pages
themselves with the text's posterior as soft labels. Hosts give the prior: the soft labels of
a host's other pages, smoothed towards its domain's, those towards all pages'. Every
statistic is a grouped aggregation with map-side combining; a missing observation is neutral.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.llm.rows import lowered, table
from verdictlake.llm.toxicity import training
from verdictlake.scale import write_through

BINS = 1 << 14
ALPHA = 0.1
#: A text counts as at most so many independent trigrams; more only sharpen a certain answer.
WEIGHT = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTHING = 5.0, 20.0, 1.0
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")


def trigrams(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a lower-cased text."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(lang, bin, n) over columns lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums.setdefault(lang, np.zeros(BINS, np.int64))
                sums[lang] += np.bincount(trigrams(text.as_py()), minlength=BINS)
            for lang, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bin", "n"])

    return texts.mapInArrow(run, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class TextModel:
    """Log-likelihood of trigrams per language: languages times BINS numbers."""

    def __init__(self, counts: DataFrame):
        rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).orderBy("lang").collect()
        self.langs = [r["lang"] for r in rows]
        table = np.full((BINS, max(1, len(rows))), ALPHA)
        for k, r in enumerate(rows):
            table[[x["bin"] for x in r["bins"]], k] += [x["n"] for x in r["bins"]]
        self.log = np.log(table / table.sum(0))

    def evidence(self, text: bytes) -> np.ndarray:
        """Log-likelihoods of the whole text, tempered to WEIGHT trigrams; zero for no text."""
        bins = trigrams(text)
        if not text.strip() or not len(bins):
            return np.zeros(self.log.shape[1])
        found = np.bincount(bins, minlength=BINS) @ self.log
        return (found - found.max()) * min(1.0, WEIGHT / len(bins))


def observe(rows: DataFrame, model: TextModel, columns: dict[str, Column], markup: bool) -> DataFrame:
    """Columns plus `text_evidence` and, for markup, `declared`, read from the page itself."""
    names = list(columns)
    source = rows.select(*[c.alias(n) for n, c in columns.items()], F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("_bytes"))
    kinds = source.drop("_bytes").schema.fields
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kinds]).add("declared", "string").add("text_evidence", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, evidence = [], []
            for value in batch.column("_bytes"):
                text, said = value.as_py(), None
                if markup:
                    match = _DECLARED.search(text)
                    said = match.group(1).decode().lower() if match else None
                    text = _HIDDEN.sub(b" ", text)
                declared.append(said)
                evidence.append(model.evidence(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(declared, pa.string()), pa.array(evidence, pa.list_(pa.float64()))],
                names=[*names, "declared", "text_evidence"])

    return source.mapInArrow(run, schema)


def _posterior(logs: Column) -> Column:
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def _sums(size: int) -> list[Column]:
    return [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(size)]


def _gathered(size: int) -> Column:
    return F.array(*[F.col(f"s{k}") for k in range(size)])


def fuse(observed: DataFrame, langs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` plus lang, probability and text_lang for rows of `observe` with host, domain and suffix columns.

    Nulls in declared, suffix, host or domain are left out of the fusion. A row's own label
    never counts in its host's prior. Ties go to the alphabetically first language; with no
    evidence at all the overall prior decides.
    """
    size = len(langs)
    seen = write_through(observed.withColumn("soft", _posterior(F.col("text_evidence"))))
    overall = [float(x or 0) for x in seen.agg(*_sums(size)).first()]
    prior = F.array(*[F.lit((x + SMOOTHING) / (sum(overall) + SMOOTHING * size)) for x in overall])

    def attach(df: DataFrame, key: str, out: str) -> DataFrame:
        sums = seen.filter(F.col(key).isNotNull()).groupBy(key).agg(*_sums(size)).select(key, _gathered(size).alias(out))
        return df.join(sums, key, "left")

    # P(observation | language), from soft counts of each observed value and of each language.
    def likelihood(key: str, out: str, df: DataFrame) -> DataFrame:
        known = [float(x or 0) for x in seen.filter(F.col(key).isNotNull()).agg(*_sums(size)).first()]
        sums = write_through(seen.filter(F.col(key).isNotNull()).groupBy(key).agg(*_sums(size)))
        kinds = sums.count() or 1
        table = sums.select(key, F.array(*[
            F.log((F.col(f"s{k}") + SMOOTHING) / (known[k] + SMOOTHING * kinds)) for k in range(size)]).alias(out))
        return df.join(table, key, "left")

    rows = attach(attach(seen, "domain", "domain_sum"), "host", "host_sum")
    rows = likelihood("suffix", "suffix_log", likelihood("declared", "declared_log", rows))
    # The row's own soft label is taken out of both sums.
    less = lambda name: F.when(F.col(name).isNotNull(), F.zip_with(name, "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))).otherwise(
        F.array_repeat(F.lit(0.0), size))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda counts, below, weight: F.zip_with(counts, below, lambda c, p: (c + F.lit(weight) * p) / (total(counts) + weight))
    rows = rows.withColumn("_domain", less("domain_sum")).withColumn("_host", less("host_sum"))
    rows = rows.withColumn("_prior", smooth(F.col("_domain"), prior, DOMAIN_WEIGHT)).withColumn(
        "_prior", smooth(F.col("_host"), F.col("_prior"), HOST_WEIGHT))
    zero = F.array_repeat(F.lit(0.0), size)
    add = lambda a, b: F.zip_with(a, F.coalesce(b, zero), lambda x, y: x + y)
    logs = add(add(add(F.col("text_evidence"), F.transform("_prior", lambda p: F.log(p))), F.col("declared_log")), F.col("suffix_log"))
    names = F.array(*[F.lit(n) for n in langs])
    best = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return rows.withColumn("_post", _posterior(logs)).select(
        *keep, best(F.col("_post")).alias("lang"), F.array_max("_post").alias("probability"), best(F.col("soft")).alias("text_lang"))


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (the last) of an address; null where it has none."""
    host = F.nullif(F.regexp_extract(lowered(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def labelled(docs: DataFrame, folds: bool = False) -> DataFrame:
    """(lang, text) of every document with a language; with `folds`, of training folds only, for evaluation."""
    some = docs.filter(F.col("lang").isNotNull())
    some = some.filter(training("doc_id")) if folds else some
    return some.select("lang", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every page and every document: doc_id or page_id, declared, host, lang, probability, text_lang.

    Pages have markup, address and host; a document's host is its source, and it has neither
    markup nor address. Language labels are learnt from every labelled document.
    """
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = TextModel(write_through(count_trigrams(labelled(docs))))
    langs = model.langs or ["und"]
    none = F.lit(None).cast("string")
    host, domain, suffix = host_parts(F.col("url"))
    from_pages = observe(pages.withColumnRenamed("html", "_text"), model, {
        "doc_id": F.lit(None).cast("bigint"), "page_id": F.col("page_id"), "host": host, "domain": domain, "suffix": suffix}, True)
    from_docs = observe(docs.withColumnRenamed("text", "_text"), model, {
        "doc_id": F.col("doc_id"), "page_id": F.lit(None).cast("bigint"), "host": F.col("source"), "domain": none, "suffix": none}, False)
    return fuse(from_docs.unionByName(from_pages), langs, ["doc_id", "page_id", "declared", "host"])
