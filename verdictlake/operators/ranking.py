"""First-n, repeatable samples, numbering and deduplication.

Samples order rows by md5 of seed and id: repeatable, the same on any cluster,
and pruned inside map tasks before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.operators.graph import connected_components
from verdictlake.operators.papers import filter_papers
from verdictlake.scale import first_n_by, null_safe_back, number_globally, sample_order, settle, write_through


def first_n_per(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    return first_n_by(df, [key], [F.col(c) for c in order], n)


PIVOTS, EDGE_ROWS = 32, 2000


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n first rows in ascending order (nulls first), however large n is, not sorted.

    The n-th key is found by narrowing: keys of a small sample cut the range, a count per piece
    tells in which the n-th lies, and that piece is cut again until it holds at most EDGE_ROWS
    keys. Then all rows up to that key are kept where they are. Rows of equal keys, if only
    some of them belong to the first n, are taken as they come. A pass reads the order columns
    only; its counts and the last piece's keys are all that the driver sees.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    key = F.struct(*order)

    def at(values) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, values)])

    keys, before, rows = df.select(*order), 0, df.count()
    if n >= rows:
        return df
    if n <= 0:
        return df.limit(0)
    low = high = None  # the n-th key lies above `low` and not above `high`
    seed = 0
    while rows > EDGE_ROWS:
        seed += 1
        inside = keys.filter((F.lit(True) if low is None else key > at(low)) & (F.lit(True) if high is None else key <= at(high)))
        sample = inside.sample(fraction=min(1.0, 16 * PIVOTS / rows), seed=seed).distinct().orderBy(*order).collect()
        pivots = [tuple(r) for r in sample[::max(1, len(sample) // PIVOTS)]]
        if not pivots:  # an unlucky sample
            continue
        piece = F.size(F.filter(F.array(*[at(p) for p in pivots]), lambda p: p < key))
        counts = {r["p"]: r["c"] for r in inside.groupBy(piece.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
        k, start = 0, before
        while start + counts.get(k, 0) < n:
            start += counts.get(k, 0)
            k += 1
        low, high, before = pivots[k - 1] if k else low, pivots[k] if k < len(pivots) else high, start
        if len(pivots) == 1 and counts[k] == rows:  # as good as one key fills the piece
            break
        rows = counts[k]
    inside = keys.filter((F.lit(True) if low is None else key > at(low)) & (F.lit(True) if high is None else key <= at(high)))
    edge, start = None, before
    for r in inside.groupBy(*order).agg(F.count(F.lit(1)).alias("_rows")).orderBy(*order).toLocalIterator():
        edge, start = tuple(r)[:-1], start + r["_rows"]
        if start >= n:
            break
    if start == n:
        return df.filter(key <= at(edge))
    ties = df.filter(key == at(edge)).limit(n - (start - r["_rows"]))
    return df.filter(key < at(edge)).unionByName(ties)


def _first_by_hash(df: DataFrame, n: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """The n rows that come first by md5 of seed and id, however large n is.

    A count per leading four digits (at most 65,536 cells) tells the cell in which the n-th row
    lies. Rows of earlier cells are kept where they are; only that cell is ordered.
    """
    if n <= 0:
        return df.limit(0)
    place = sample_order(seed, *ids)
    cell = F.substring(place, 1, 4)
    sizes = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sizes.withColumn("_before", before).filter(F.col("_before") < n).agg(
        F.max(F.struct("_cell", "_before")).alias("e")).first()["e"]
    if edge is None:
        return df.limit(0)
    last = df.filter(cell == edge["_cell"]).orderBy(place, *ids).limit(n - edge["_before"])
    return df.filter(cell < edge["_cell"]).unionByName(last)


def sample_n(df: DataFrame, n: int, seed: int, ids: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """n rows by seed, given back in input order."""
    return _first_by_hash(df, n, seed, ids).orderBy(*(order or ids))


def sample_per_turn(claims: DataFrame, k: int, seed: int, task: str | None = None) -> DataFrame:
    """At most k claims per turn; code claims are all kept, early stopping bounds those."""
    if task == "coding":
        return claims
    return first_n_by(claims, ["conv_id", "turn"], [sample_order(seed, "claim_id"), "claim_id"], k)


def limit_per_category(claims: DataFrame, k: int) -> DataFrame:
    """At most k claims per conversation and element type, earliest turns first."""
    return first_n_by(claims, ["conv_id", "element_type"], ["turn", "claim_idx"], k)


def stratified_even(df: DataFrame, key: str, n: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """n rows spread evenly over strata: short strata give all, the rest comes from strata with spare rows.

    A row taken to fill up stands within the first (share + missing) of its stratum. Counts per
    stratum and cell of the sample order tell the cells in which these two ranks lie; only rows
    of those cells are ranked, so no stratum is sorted in one task.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("c"))
    # Two numbers describe all strata.
    n_strata = sizes.count()
    if n_strata == 0:
        return df
    share = n // n_strata
    shortfall = sizes.agg(F.coalesce(F.sum(F.greatest(F.lit(share) - F.col("c"), F.lit(0))), F.lit(0))).first()[0]
    missing = int(shortfall) + n % n_strata
    if share + missing == 0:
        return df.limit(0)
    cells = _stratum_cells(df, key, seed, ids, share, share + missing)
    marked = null_safe_back(df.withColumn("_cell", _cell(seed, ids)), cells, [key])
    at, first, last = F.col("_cell"), F.col("_share"), F.col("_whole")
    # Null: the stratum ends before that rank, so all of its rows come before it.
    in_share = F.lit(share > 0) & (first.isNull() | (at < first["cell"]))
    on_edge = (at == first["cell"]) | (at == last["cell"])
    sure = marked.filter(~F.coalesce(on_edge, F.lit(False)))
    edge = _edge_ranks(marked.filter(on_edge), key, seed, ids).withColumn(
        "_even", (at == first["cell"]) & (F.col("_rank") + first["before"] <= share)).withColumn(
        "_spare", ~F.coalesce("_even", F.lit(False)) & F.coalesce((at < last["cell"]) | (F.col("_rank") + last["before"] <= share + missing), F.lit(True)))
    spare = sure.filter(~in_share & F.coalesce(at < last["cell"], F.lit(True))).select(*df.columns).unionByName(edge.filter("_spare").select(*df.columns))
    even = sure.filter(in_share).select(*df.columns).unionByName(edge.filter("_even").select(*df.columns))
    return even.unionByName(_first_by_hash(spare, missing, seed, ids))


def _cell(seed: int, ids: Sequence[str]) -> Column:
    return F.substring(sample_order(seed, *ids), 1, 4)


def _stratum_cells(df: DataFrame, key: str, seed: int, ids: Sequence[str], share: int, whole: int) -> DataFrame:
    """Per stratum the cells (and the rows before them) in which its ranks `share` and `whole` lie, null if it ends before.

    One row per stratum and leading four digits of the sample order, summed up per stratum.
    """
    sizes = df.groupBy(key, _cell(seed, ids).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("before", before)

    def edge(rank: int) -> Column:
        return F.min(F.when((F.col("before") + F.col("n") >= rank) & F.lit(rank > 0), F.struct("cell", "before")))

    return placed.groupBy(key).agg(edge(share).alias("_share"), edge(whole).alias("_whole"))


def _edge_ranks(rows: DataFrame, key: str, seed: int, ids: Sequence[str]) -> DataFrame:
    """Rows of the edge cells with their rank inside their cell; all other rows are settled by their cell."""
    within = Window.partitionBy(key, "_cell").orderBy(sample_order(seed, *ids), *ids)
    return rows.withColumn("_rank", F.row_number().over(within))


def sample_grid(grid: DataFrame, k: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """k random cells per language."""
    return first_n_by(grid, ["language"], [sample_order(seed, *ids), *ids], k)


def sample_papers(papers: DataFrame, n: int, seed: int, **conditions) -> DataFrame:
    """n papers that meet the conditions, without replacement; fewer when fewer there are."""
    return sample_n(filter_papers(papers, **conditions), n, seed, ["doc_id"])


def order_facts(facts: DataFrame, ids: Sequence[str], out: str = "fact_number") -> DataFrame:
    """Facts in reading order with their 1-based number: conversation, then turn, non-numeric ids last."""
    def numeric(name: str) -> Column:
        return F.expr(f"try_cast(trim(cast({name} as string)) as bigint)")

    keyed = facts.withColumns({"_c": numeric("conv_id"), "_t": numeric("turn"),
                               "_raw": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    order = [F.col("_c").asc_nulls_last(), F.col("_raw").asc(), F.col("_t").asc_nulls_last(), *[F.col(c).asc() for c in ids]]
    return number_globally(keyed, order, out).drop("_c", "_t", "_raw")


def number_claims(claims: DataFrame, entry: Sequence[str], position: str) -> DataFrame:
    """Running claim number over all entries, its label, and where the claim came from."""
    numbered = number_globally(claims, [*entry, position], "claim_number")
    label = F.concat(F.lit("Claim #"), F.col("claim_number").cast("string"), F.lit(" - Conv "),
                     F.col("conv_id").cast("string"), F.lit(" Turn "), F.col("turn").cast("string"))
    return numbered.withColumn("fact_id", label)


def next_slice(prompts: DataFrame, existing: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """Per language the prompts after those already done, up to n in all (all of them without n)."""
    have = existing.groupBy("language").agg(F.count("*").alias("_have"))
    # Ranges of one sort over all languages, so a language that holds most rows is spread as well.
    numbered = number_globally(prompts, ["language", *order], "_no")
    starts = null_safe_back(numbered.groupBy("language").agg(F.min("_no").alias("_first")), have, ["language"])
    joined = null_safe_back(numbered, starts, ["language"]).withColumn("_rank", F.col("_no") - F.col("_first") + 1)
    wanted = F.col("_rank") > F.coalesce("_have", F.lit(0))
    return joined.filter(wanted if n is None else wanted & (F.col("_rank") <= n)).select(*prompts.columns)


# Rounds before what is left is split into components, and the rows of a component that one task may walk.
EAGER_ROUNDS, WALKED_ROWS = 3, 100_000


def dedup_any_key(df: DataFrame, keys: Sequence[str], order: str, walked_rows: int = WALKED_ROWS) -> DataFrame:
    """Keep a row unless an earlier kept row shares any of its keys; dropped rows block nobody.

    Rounds: a row that comes first in all its key groups is kept, rows sharing a key with it
    go, the rest is tried again. Each round is grouped minimums (combined map-side) and joins
    on the keys; for rows in random order the number of rounds grows with the logarithm of
    their number (Blelloch, Fineman, Shun: Greedy sequential maximal independent set and
    matching are parallel on average, 2012). What a few rounds leave, such as long chains, is
    split into components of rows that share keys: those of up to `walked_rows` rows are walked
    in order, many per task, and only larger ones go on in rounds. Null and blank keys never
    collide. `order` is unique.
    """
    return df.join(_kept_orders(df, keys, order, walked_rows), order, "left_semi")


def _kept_orders(df: DataFrame, keys: Sequence[str], order: str, walked_rows: int = WALKED_ROWS) -> DataFrame:
    narrow = df.select(order, *[F.nullif(F.col(k), F.lit("")).alias(k) for k in keys])
    undecided, kept, rounds = settle(narrow), [], 0
    while True:
        winners, undecided = _decided(undecided, keys, order)
        kept.append(winners)
        rounds += 1
        if undecided.isEmpty():
            break
        if rounds == EAGER_ROUNDS:
            placed = write_through(_with_component(undecided, keys))
            sizes = write_through(placed.groupBy("_root").agg(F.count(F.lit(1)).alias("_rows")))
            large = sizes.filter(F.col("_rows") > walked_rows).select("_root")
            kept.append(settle(_walked(placed.join(large, "_root", "left_anti"), keys, order)))
            undecided = settle(placed.join(large, "_root", "left_semi").drop("_root"))
            if undecided.isEmpty():
                break
    orders = kept[0].select(order)
    for part in kept[1:]:
        orders = orders.unionByName(part.select(order))
    return orders


def _decided(undecided: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """One round: the rows that come first in all their key groups, and those that share no key with them."""
    marked = undecided
    for k in keys:
        first = undecided.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
        marked = marked.join(first, k, "left")
    is_first = F.lit(True)
    for k in keys:
        is_first = is_first & F.coalesce(F.col(f"_first_{k}") == F.col(order), F.lit(True))
    marked = settle(marked.select(order, *keys, is_first.alias("_kept")))
    winners = marked.filter("_kept").select(order, *keys)
    rest = marked.filter("NOT _kept").select(order, *keys)
    for k in keys:
        taken = winners.filter(F.col(k).isNotNull()).select(k)
        rest = rest.join(taken, k, "left_anti")
    return winners, settle(rest.select(order, *keys))


def _with_component(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows`, which each have a key, with `_root`, equal for all rows connected by common keys."""
    nodes = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(n), F.col(k).cast("string"))) for n, k in enumerate(keys)]))
    linked = write_through(rows.withColumn("_nodes", nodes))
    steps = F.filter(F.transform("_nodes", lambda b, k: F.struct(F.get("_nodes", k - 1).alias("a"), b.alias("b"))), lambda e: e["a"].isNotNull())
    edges = linked.select(F.explode(steps).alias("e")).select("e.*").distinct()
    roots = connected_components(edges).withColumnRenamed("node", "_node")
    return linked.withColumn("_node", F.get("_nodes", F.lit(0))).join(roots, "_node", "left").select(
        *rows.columns, F.coalesce("root", "_node").alias("_root"))


def _walked(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Orders of the rows kept by walking each component in order; a task holds one component's keys at a time."""
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, taken = None, [set() for _ in names]
        for frame in frames:
            kept = []
            for place, at, *values in frame[[order, "_root", *names]].itertuples(index=False):
                if at != root:
                    root, taken = at, [set() for _ in names]
                free = [v is None or v != v or v not in t for v, t in zip(values, taken)]
                if all(free):
                    kept.append(place)
                    for v, t in zip(values, taken):
                        t.add(v)
            yield frame[frame[order].isin(kept)][[order]]

    return rows.repartition("_root").sortWithinPartitions("_root", order).mapInPandas(run, rows.select(order).schema)


def take_target(df: DataFrame, n: int, keys: Sequence[str], order: str) -> DataFrame:
    """First n rows left after deduplication."""
    return df.join(first_n(write_through(_kept_orders(df, keys, order)), [order], n), order, "left_semi")
