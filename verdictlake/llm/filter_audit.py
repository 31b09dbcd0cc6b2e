"""Filter interaction audit: what each filter removes, in every order, from one lattice of filter sets.

A document is reduced to the set of filters it fails. After any order's first filters only
their set matters, so the orders are the paths of the lattice of filter sets: its states are
sets, its edges add one filter. What an edge removes follows from the counts of failure sets.
Counting the paths that reach an edge's start from the empty set and those that leave its end
for the full set weighs its removals for the Shapley value; the steps of every order are read
from the same edges. Documents meet only in counts: one row per part and failure set.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import WORD, table
from verdictlake.scale import write_through

COUNTS = ("n", "good", "toxic")


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Per state (a bit set): orders that reach it from the empty set, and orders that leave it for the full set.

    Forward and backward sums over the edges; states number 2 ** filters, a parameter of a few.
    """
    states = 1 << filters
    reach, leave = [0] * states, [0] * states
    reach[0] = leave[-1] = 1
    for s in range(1, states):
        reach[s] = sum(reach[s ^ (1 << f)] for f in range(filters) if s >> f & 1)
    for s in range(states - 2, -1, -1):
        leave[s] = sum(leave[s | (1 << f)] for f in range(filters) if not s >> f & 1)
    return reach, leave


def edges(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, state, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) per lattice edge.

    `counts` has (part, mask, n, good, toxic), one row per part and failure set present. Every
    count meets each edge of the lattice once, a fixed number, and is summed per part and edge.
    """
    size = len(filters)
    reach, leave = path_counts(size)
    lattice = [(s, f) for s in range(1 << size) for f in range(size) if not s >> f & 1]
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(reach[s] * leave[s | 1 << f]).cast("bigint").alias("orders"))
                      for s, f in lattice])
    met = counts.select("part", "mask", *COUNTS, F.explode(every).alias("e")).select("part", "mask", *COUNTS, "e.*")
    alive, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(rows: Column, what: str = "n") -> Column:
        return F.sum(F.when(rows, F.col(what)).otherwise(F.lit(0))).cast("bigint")

    summed = met.groupBy("part", "state", "f").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(alive & fails, "good").alias("good_lost"),
        total(alive & fails, "toxic").alias("toxic_lost"), F.first("orders").alias("orders"))
    # One row per part and filter: bounded by the parts, so the sums per filter are a small join.
    values = summed.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).cast("bigint").alias("shapley"))
    return summed.drop("orders").join(values, ["part", "f"])


def order_steps(lattice: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Every order's steps, read from the edges: part, filter_order, step and the edge's columns."""
    taken = {}
    for order in permutations(range(len(filters))):
        state = 0
        for step, f in enumerate(order):
            taken.setdefault((state, f), []).append(("".join(filters[k] for k in order), step + 1))
            state |= 1 << f
    # An edge lists the orders that pass it; the lists together hold each step of each order once.
    passing = F.create_map(*[x for (s, f), steps in taken.items() for x in (
        F.lit(s * len(filters) + f), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step")) for o, k in steps]))])
    return lattice.withColumn("_pass", F.explode(F.element_at(passing, F.col("state") * len(filters) + F.col("f")))).select(
        "part", "_pass.filter_order", "_pass.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Steps of all orders of `filters` over counts of failure sets (bit k: the k-th filter fails)."""
    return order_steps(write_through(edges(counts, filters)), filters)


def failures(text: Column) -> list[Column]:
    """The four conditions that a text settles by itself; `text` is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    # The list of words is made once per row: a lambda's argument is held, not repeated.
    counted = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("d"))), F.lit(0))
    return [counted["n"] < 100, 100 * counted["d"] < 80 * counted["n"], 100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"),
            text.rlike("[#$%&*|]")]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of the five filters they fail.

    Null texts are empty and null parts the empty string. A document is a copy if its whole
    text, by SHA-256, occurs under a smaller id anywhere in the table; rows that repeat an id
    count each, and none of them is a copy of the others; a null id is neither a copy nor
    copied. Labels of one id are joined by "any": one row saying 1 is enough; unlabelled
    documents are neither good nor toxic. Only `id_col`, `text_col` and `part_col` are read,
    so other columns may have any name. Empty tables give no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    seen = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures(F.col("text")))), F.lit(0))
    traits = write_through(seen.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask")))
    rows = traits.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Aggregated map-side and joined on (text, id), so neither a common text nor a common part is one task's.
    first = traits.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    joined = rows.join(first, ["id", "digest"], "left").join(told, "id", "left")
    return joined.groupBy("part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask")).agg(
        F.sum("n").cast("bigint").alias("n"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(c) for c in COUNTS[1:]])


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part, order of the five filters and step."""
    counts = failure_counts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit(write_through(counts), "ABCDE")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT w.doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS bad,
             coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id),
c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, bad),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, k::INT AS step, instr('ABCDE', substr(o, k, 1)) AS f, [instr('ABCDE', substr(o, j, 1)) FOR j IN range(1, k)] AS earlier
      FROM p, range(1, 6) r(k) WHERE length(o) = 5),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT bad[f]) AS kept, sum(n) FILTER (NOT gone AND bad[f]) AS removed,
             sum(n) FILTER (gone AND bad[f]) AS redundant, sum(n) FILTER (bad[f] AND list_sum([x::INT FOR x IN bad]) = 1) AS unique_fails,
             sum(good) FILTER (NOT gone AND bad[f]) AS good_lost, sum(toxic) FILTER (NOT gone AND bad[f]) AS toxic_lost
      FROM (SELECT *, list_bool_or([bad[j] FOR j IN earlier]) IS TRUE AS gone FROM c, s) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r
"""
