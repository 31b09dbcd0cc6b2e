"""Verdict reuse and early stopping together, as the one fixed point of their mutual dependence.

Whether a claim is reused depends on where its package was first judged; whether it is skipped
depends on what its turn has detected; both depend on earlier places only, so there is one
solution. Claims are first reduced to acts: of equal claims of a turn (package, type, raised
types) only the first can matter. The first round settles all turns and packages; every later
round takes up only the turns in which a changed source turns an act, and only the packages
of which a changed detection turns an act. Acts lie in folders by turn and by package, so a
round reads the folders of what it takes up.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.claims import ELEMENT_TYPES
from verdictlake.operators.stateful import TURN, detections
from verdictlake.scale import shared_folder, write_through

FOLDER_ROWS, MOST_FOLDERS = 50_000, 256
FROM = ("_from_0", "_from_1", "_from_2")


def acts_of(narrow: DataFrame) -> DataFrame:
    """First place of each (turn, package, asked, own type, raised types); claims that neither raise nor judge are left out.

    `narrow` has the turn, claim_idx, package_key, asked (may take an earlier verdict), usable
    (its answer is a verdict on the package), own (type number) and mask (raised types).
    """
    named = F.when(F.col("usable") | F.col("asked"), F.col("package_key"))
    return narrow.filter("mask <> 0 OR usable").groupBy(*TURN, named.alias("package_key"), "asked", "usable", "own", "mask").agg(
        F.min("claim_idx").cast("bigint").alias("at"))


def write_folders(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.partitionBy("_folder").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Layout:
    """A table written in folders by a hash of its key, read by the keys of another table."""

    def __init__(self, df: DataFrame, keys: Sequence[str], folders: int):
        self.keys, self.folders = list(keys), folders
        folder = F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
        self.rows = write_folders(df.withColumn("_folder", folder).repartition("_folder", spread))

    def of(self, keys: DataFrame) -> DataFrame:
        """Rows of the given written, distinct keys; only their folders are read."""
        if self.folders == 1:
            return self.rows.join(keys.select(*self.keys), self.keys, "left_semi").drop("_folder")
        found = keys.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int").alias("f")).distinct().collect()
        pruned = self.rows.filter(F.col("_folder").isin([r["f"] for r in found]))
        return pruned.join(keys.select(*self.keys), self.keys, "left_semi").drop("_folder")


def _place() -> Column:
    return F.struct(*TURN, F.col("at").alias("claim_idx"))


def _reused(source: str) -> Column:
    return F.coalesce(F.col("asked") & (_place() > F.col(source)), F.lit(False))


def _skipped(prefix: str = "") -> Column:
    out = F.lit(False)
    for k in range(len(ELEMENT_TYPES)):
        out = out | ((F.col("own") == k + 1) & (F.col("at") > F.col(f"{prefix}{FROM[k]}")))
    return F.coalesce(out, F.lit(False))


def _detected(acts: DataFrame, sources: DataFrame) -> DataFrame:
    """Detections of the turns of `acts`, every turn listed, given each package's source."""
    judged = acts.join(sources.select("package_key", "_place"), "package_key", "left").filter((F.col("mask") != 0) & ~_reused("_place"))
    bit = F.get(F.array(*[F.lit(b) for b in (0, 1, 2, 4)]), F.col("own"))
    seen = judged.groupBy(*TURN, bit.alias("bit"), "mask").agg(F.min("at").alias("at"))
    return acts.select(*TURN).distinct().join(detections(seen), list(TURN), "left")


def _sources(acts: DataFrame, found: DataFrame) -> DataFrame:
    """First act of each package that is a verdict and not skipped."""
    exists = F.when(F.col("own") == 1, F.col("mask").bitwiseAND(1) == 0).otherwise(F.col("mask").bitwiseAND(2) == 0)
    judged = acts.filter("usable").join(found, list(TURN), "left").filter(~_skipped())
    return judged.groupBy("package_key").agg(F.min(F.struct(_place().alias("p"), exists.alias("e"))).alias("f")).select(
        "package_key", F.col("f.p").alias("_place"), F.col("f.e").alias("package_exists"))


def _over(base: DataFrame, newer: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """`base` with the rows of `newer` in place of its own."""
    return base if newer is None else base.join(newer.select(*keys), list(keys), "left_anti").unionByName(newer)


def settled_sources(narrow: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """(package_key, _place, package_exists) of the fixed point; `trace` takes the acts that each round took up."""
    acts = write_through(acts_of(narrow))
    package = ["package_key"]
    size = acts.count()
    folders = max(1, min(MOST_FOLDERS, size // FOLDER_ROWS))
    by_turn, by_package = Layout(acts, TURN, folders), Layout(acts.filter("package_key IS NOT NULL"), package, folders)
    none = acts.limit(0).select("package_key", _place().alias("_place"), F.lit(False).alias("package_exists"))
    first_found = Layout(_detected(acts, none), TURN, folders)
    first_sources = write_through(_sources(acts, first_found.rows.drop("_folder")))
    if trace is not None:
        trace.append(size)
    newer_found, newer_sources = None, None
    changed = write_through(first_sources.select("package_key", F.lit(None).cast(none.schema["_place"].dataType).alias("_was"), "_place"))
    while True:
        # Acts that a changed source turns from judged to reused, or back.
        asked = by_package.of(changed).join(changed, package).filter(F.col("asked") & (F.col("mask") != 0) & (_reused("_was") != _reused("_place")))
        turns = write_through(asked.select(*TURN).distinct())
        if turns.isEmpty():
            break
        taken = by_turn.of(turns)
        packages = write_through(taken.filter("package_key IS NOT NULL").select("package_key").distinct())
        sources = write_through(_over(first_sources, newer_sources, package).join(packages, package, "left_semi"))
        again = write_through(_detected(taken, sources))
        before = _over(first_found.of(turns), None if newer_found is None else newer_found.join(turns, list(TURN), "left_semi"), TURN)
        differs = F.lit(False)
        for c in FROM:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_was{c}"))
        moved = write_through(again.join(before.select(*TURN, *[F.col(c).alias(f"_was{c}") for c in FROM]), list(TURN)).filter(differs))
        if moved.isEmpty():
            break
        newer_found = write_through(_over(newer_found, again, TURN)) if newer_found is not None else again
        # Packages with an act that a changed detection turns from judged to skipped, or back.
        touched = write_through(by_turn.of(moved).join(moved, list(TURN)).filter(F.col("usable") & (_skipped() != _skipped("_was"))).select(
            "package_key").distinct())
        if touched.isEmpty():
            break
        held = by_package.of(touched)
        lying = write_through(held.select(*TURN).distinct())
        found = _over(first_found.of(lying), newer_found.join(lying, list(TURN), "left_semi"), TURN)
        after = touched.join(_sources(held, found), package, "left")
        was = _over(first_sources, newer_sources, package).select("package_key", F.col("_place").alias("_was"), F.col("package_exists").alias("_did"))
        compared = write_through(after.join(was, package, "left"))
        changed = write_through(compared.filter(~(F.col("_place").eqNullSafe(F.col("_was")) & F.col("package_exists").eqNullSafe(F.col("_did")))).select(
            "package_key", "_was", "_place"))
        again_sources = compared.select("package_key", "_place", "package_exists")
        newer_sources = write_through(_over(newer_sources, again_sources, package)) if newer_sources is not None else again_sources
        if trace is not None:
            trace.append(taken.count() + held.count())
    return _over(first_sources, newer_sources, package).filter("_place IS NOT NULL")
