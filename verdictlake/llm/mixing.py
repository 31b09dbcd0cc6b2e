"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Each document has an expected number of copies. Within its source the expectations are
summed in order of size, one random offset is added, and the document is emitted once per
integer boundary that its share of the sum crosses. Because documents of a source are ordered
by size, the words taken differ from the source's target by at most its largest document.
The running sum is cut into the ranges of a parallel sort, so a source with a third of all
rows is summed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.llm.rows import RID, identified, own_names, table, word_count
from verdictlake.scale import number_globally, write_through

UNIT = 1_000_000_000
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, target. `sizes` has one (source, source_size) row per source.

    Sources by code point, null last, take the weights in turn and share `share` times all
    sizes. A target stops at `cap` times its source's size; the excess is shared again by
    weight among the others until none is above. Only two sums per round reach the driver.
    """
    numbered = number_globally(sizes, [F.col("source").asc_nulls_last()], "_place")
    turn = (F.col("_place") - 1) % len(weights)
    weighed = write_through(numbered.select("source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("_w")))
    most, level, full = F.col("source_size") * F.lit(cap), None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_w") * F.lit(level) > most
        row = weighed.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, most).otherwise(F.lit(0.0))).alias("taken"),
            F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("_w"))).alias("free"),
            F.sum(above.cast("bigint")).alias("full")).first()
        if not row["free"] or row["full"] == full:
            level = level or 0.0
            break
        level, full = (share * row["total"] - row["taken"]) / row["free"], row["full"]
    return weighed.select("source", "source_size", F.least(F.col("_w") * F.lit(level), most).alias("target"))


def systematic_copies(items: DataFrame, group: str, order: Sequence[str], units: str, offset: Column) -> DataFrame:
    """`items` plus `copies`: integer boundaries crossed by each row's share of its group's running sum.

    `units` holds the expected copies in billionths as an integer; `offset` is the group's
    random start in billionths. Sums are decimals, so neither the order of adding nor the
    number of rows changes them.
    """
    keys = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = items.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = write_through(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_group", F.struct(
        F.col(group).isNull().alias("n"), F.coalesce(F.col(group), F.lit("")).alias("s")))
    share = F.col(units).cast("decimal(20,0)")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fixed.groupBy("_group", "_part").agg(F.sum(share).alias("_all")).select(
        "_group", "_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).cast("decimal(38,0)").alias("_earlier"))
    inside = Window.partitionBy("_group", "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    summed = fixed.withColumn("_here", F.sum(share).over(inside)).join(offsets, ["_group", "_part"])
    unit = F.lit(UNIT)
    after = (F.col("_earlier") + F.col("_here") + offset).cast("decimal(38,0)")
    crossed = summed.withColumn("_after", after).withColumn(
        "_before", (F.col("_after") - share).cast("decimal(38,0)"))
    return crossed.select(*items.columns, F.expr(
        f"(_after div cast({UNIT} as decimal(10,0))) - (_before div cast({UNIT} as decimal(10,0)))").cast("bigint").alias("copies"))


def mix(rows: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of `identified` rows: _rid, doc_id, size, source_size, target, copies.

    Size is the number of words, 0 for a null or empty text. Null is a source of its own,
    after all others. Rows of equal size go by md5 of the id, then id (null first), then row
    identity; the same rows in the same files give the same result. No row is emitted more
    than `cap` times, rounded up. An empty table gives an empty result.
    """
    sized = write_through(rows.select(
        RID, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    expected = targets.withColumn("_units", F.coalesce(
        F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * F.lit(float(UNIT))), F.lit(0)).cast("bigint"))
    t = expected.select(F.col("source").alias("_source"), "source_size", "target", "_units")
    items = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "_tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("bigint") % UNIT
    return systematic_copies(items, "source", ["size", "_tie", "doc_id", RID], "_units", start).select(
        RID, "doc_id", "size", "source_size", "target", "copies")


@own_names
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, each as many times as the mix takes it, with the columns of `docs`."""
    rows = identified(docs)
    copies = mix(rows, **options).filter("copies > 0").select(RID, "copies")
    names = list(docs.columns)
    taken = rows.select(RID, F.struct(*names).alias("_row")).join(copies, RID)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(
        *[F.col("_row")[n].alias(n) for n in names])


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    mixed = mix(identified(table(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, sum(w) OVER () AS all_w, sum(source_size) OVER () AS total,
             coalesce(sum(2 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before,
             row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS nth
      FROM w WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((1.5 * total::DOUBLE - cap_before::DOUBLE) / (all_w - w_before), nth) FILTER (
             WHERE w * ((1.5 * total::DOUBLE - cap_before::DOUBLE) / (all_w - w_before)) <= 2 * source_size) AS level FROM r),
t AS (SELECT source, source_size, least(w * level, 2.0::DOUBLE * source_size) AS target FROM w, l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size::DOUBLE * 1e9::DOUBLE) END::BIGINT AS units,
             ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT % 1000000000 AS start FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, units, start, row_number() OVER (
             PARTITION BY d.source ORDER BY d.size, md5(d.doc_id::VARCHAR), d.doc_id)::HUGEINT AS place
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (((place * units + start) // 1000000000 - ((place - 1) * units + start) // 1000000000) * size)::BIGINT AS taken
FROM p
"""
