"""Building blocks that keep keyed work spread out when one key is hot.

A key may hold a large share of all rows, so nothing here sorts or collects a
whole key group in one task. Ordered work inside a key is cut into chunks of an
integer ordinal; chunks are summarised with map-side combining, and only the
summaries (one row per chunk) are scanned per key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 4096


def settings() -> dict[str, str]:
    """Session settings the operators are written for (all runtime-adaptive)."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A skewed side of a join is split even if that costs another shuffle later.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Broadcast is decided from measured shuffle sizes, never from row counts we guess.
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        # First-n-per-key filters prune inside map tasks whatever n is.
        "spark.sql.optimizer.windowGroupLimitThreshold": str((1 << 31) - 1),
        # Python workers hold one batch each: bounded by bytes, since pages and texts differ in length.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in settings().items():
        spark.conf.set(key, value)
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session with batches to Python bounded by bytes, its other settings as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, settings()[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a local one in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="verdictlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage of a narrow table with a reliable checkpoint; survives lost executors."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def write_through(df: DataFrame) -> DataFrame:
    """Cut lineage of a wide table: written to the shared folder and read back.

    Columnar, so later passes read only the columns they use. The cluster expires old
    `written-*` folders as it does checkpoints.
    """
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query of the session shuffles meanwhile goes from the disks when that query ends.

    Otherwise it stays until the driver's own memory is cleaned up, which may be long after.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of recomputing.

    Projections merge and filters move down, which repeats a costly expression
    (parsing, long regular expressions) at every use. A one-element generator keeps it in place.
    """
    return df.select("*", F.explode(F.array(F.struct(value.alias(name)))).alias("_once")).select(
        *df.columns, F.col(f"_once.{name}").alias(name))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key by `order`; an aggregate, so hot keys combine map-side."""
    return _edge_per_key(df, keys, order, F.max_by)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key by `order`."""
    return _edge_per_key(df, keys, order, F.min_by)


def _edge_per_key(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ranked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return ranked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _chunk(order: str, span: int) -> Column:
    return F.floor(F.col(order) / F.lit(span)).cast("bigint")


def null_safe_back(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a one-row-per-key summary; a null key finds the summary of nulls."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    span: int = DEFAULT_SPAN,
    ties: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row inside its key group, by an integer `order` column.

    Rows are numbered inside (key, order // span); the running count of earlier
    chunks is added from the chunk summary. The row side shuffles once, on
    (key, chunk), and that partitioning serves both the numbering and the join.
    """
    chunked = df.withColumn("_chunk", _chunk(order, span))
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties)
    numbered = chunked.withColumn("_local", F.row_number().over(inside))
    joined = null_safe_back(numbered, offsets, [*keys, "_chunk"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).cast("bigint").alias(out))


def previous_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    default: Column,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Value of the preceding row in the key group; the last row of a chunk feeds the next chunk."""
    chunked = df.withColumn("_chunk", _chunk(order, span))
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_tail")
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    handed = tails.select(*keys, "_chunk", F.lag("_tail").over(by_chunk).alias("_handed"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn("_local", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = null_safe_back(local, handed, [*keys, "_chunk"])
    found = F.coalesce("_local", "_handed")
    return joined.select(
        *df.columns, F.when(found.isNull(), default).otherwise(found["v"]).alias(out)
    )


def number_globally(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based number over the whole table in `order`, without one global window.

    The table is range-partitioned and sorted (parallel), written so that the
    ranges cannot change, and numbered from the row index inside each range plus
    the running size of earlier ranges. Only one row per range is scanned serially.
    """
    sort_keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
    # The id holds the partition in its upper bits and the row index in the lower 33.
    fixed = write_through(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # One row per range partition: bounded by the shuffle partition count.
    joined = fixed.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_idx") + F.col("_offset") + 1).cast("bigint").alias(out))


def first_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows of every key. The rank filter becomes a group limit before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def sample_order(seed: int, *columns: str) -> Column:
    """Repeatable pseudo-random order key: md5 of the seed and the row's id."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c) for c in columns]))
