"""Order-dependent judging: early stopping, verdict reuse, evidence selection.

The order of claims is (conv_id, turn, claim_idx); nothing depends on task timing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions.claims import ELEMENT_TYPES
from verdictlake.functions.labels import text
from verdictlake.operators.text import has_version, package_key
from verdictlake.scale import first_n_by, settle, write_through

FLAGS = ("hallucinated_import_detected", "hallucinated_install_detected", "hallucinated_function_usage_detected")
TURN = ("conv_id", "turn")


# ---- early stopping ------------------------------------------------------------------------


def _bit(element_type: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(ELEMENT_TYPES):
        out = F.when(element_type == name, 1 << k).otherwise(out)
    return out


def _mask() -> Column:
    out = F.lit(0)
    for k, flag in enumerate(FLAGS):
        out = out.bitwiseOR(F.when(F.coalesce(F.col(flag), F.lit(False)), 1 << k).otherwise(0))
    return out


def type_number(element_type: Column) -> Column:
    """1 to 3 for the three element types, 0 for any other."""
    out = F.lit(0)
    for k, name in enumerate(ELEMENT_TYPES):
        out = F.when(element_type == name, k + 1).otherwise(out)
    return out


def raised_types(judged: DataFrame) -> Column:
    """The types a claim raises as bits; claims of known packages (`known`) raise none."""
    known = F.coalesce("known", F.lit(False)) if "known" in judged.columns else F.lit(False)
    return F.when(known, 0).otherwise(_mask())


def first_sightings(judged: DataFrame, order: str = "claim_idx") -> DataFrame:
    """First place in each turn of every (own type, raised flags) combination: at most 28 rows a turn.

    Aggregated with map-side combining, and mergeable: the minimum over batches is the whole table's.
    """
    raised = judged.filter(F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]))
    if "known" in judged.columns:
        raised = raised.filter(~F.coalesce("known", F.lit(False)))
    return raised.groupBy(*TURN, _bit(F.col("element_type")).alias("bit"), _mask().alias("mask")).agg(
        F.min(order).cast("bigint").alias("at"))


def detections(sightings: DataFrame) -> DataFrame:
    """Per turn, the place from which each type counts as detected (null: never).

    A claim whose type is already detected is not judged, so its flags must not count. Walking
    the first sightings in order is enough: a combination that still matters at a later state
    mattered at every earlier one, so its first sighting is where it would have acted.
    """
    walk = """aggregate(sort_array(collect_list(named_struct('at', at, 'bit', bit, 'mask', mask))),
      named_struct('s', 0, 'p0', CAST(NULL AS BIGINT), 'p1', CAST(NULL AS BIGINT), 'p2', CAST(NULL AS BIGINT)),
      (a, x) -> IF(a.s & x.bit <> 0, a, named_struct('s', a.s | x.mask,
        'p0', IF(a.s & 1 = 0 AND x.mask & 1 <> 0, x.at, a.p0),
        'p1', IF(a.s & 2 = 0 AND x.mask & 2 <> 0, x.at, a.p1),
        'p2', IF(a.s & 4 = 0 AND x.mask & 4 <> 0, x.at, a.p2))))"""
    return sightings.groupBy(*TURN).agg(F.expr(walk).alias("d")).select(
        *TURN, *[F.col(f"d.p{k}").alias(f"_from_{k}") for k in range(3)])


def early_stop(judged: DataFrame, order: str = "claim_idx", found: DataFrame | None = None) -> DataFrame:
    """Mark claims whose element type was already detected in their turn, and blank their verdict.

    Claims of known packages (`known`) are resolved before the check: they neither stop others
    nor get skipped. `found` replaces the table's own detections, for increments.
    """
    found = detections(first_sightings(judged, order)) if found is None else found
    joined = judged.join(found, list(TURN), "left")
    skipped = F.lit(False)
    for k, name in enumerate(ELEMENT_TYPES):
        skipped = skipped | ((F.col("element_type") == name) & (F.col(order) > F.col(f"_from_{k}")))
    skipped = F.coalesce(skipped, F.lit(False))
    if "known" in judged.columns:
        skipped = skipped & ~F.coalesce("known", F.lit(False))
    out = joined.withColumn("skipped_early_stopping", skipped)
    # The labels of a skipped claim.
    blank = {
        "hallucination": "Skipped", "abstention": "No", "verification_error": "No",
        "reference_grounding": "Skipped - Early stopping", "content_grounding": "Skipped - Early stopping",
    }
    s = F.col("skipped_early_stopping")
    out = out.withColumns({
        **{c: F.when(s, v).otherwise(F.col(c)) for c, v in blank.items() if c in judged.columns},
        **{f: ~s & F.coalesce(F.col(f), F.lit(False)) for f in FLAGS}})
    return out.select(*judged.columns, "skipped_early_stopping")


# ---- verdict reuse -------------------------------------------------------------------------


def _place() -> Column:
    return F.struct("conv_id", "turn", "claim_idx")


def verdict_of(judged: DataFrame) -> tuple[Column, Column]:
    """Whether a claim's answer is a verdict on its package, and whether the package exists by it."""
    kind = F.col("element_type")
    usable = kind.isin("import", "install") & (package_key("package_name") != "")
    for mark in ("known", "skipped_early_stopping"):
        if mark in judged.columns:
            usable = usable & ~F.coalesce(mark, F.lit(False))
    if "error" in judged.columns:  # a failed judgment is no verdict
        usable = usable & (F.coalesce("error", F.lit("")) == "")
    missing = F.when(kind == "import", F.col(FLAGS[0])).otherwise(F.col(FLAGS[1]))
    return usable, ~F.coalesce(missing, F.lit(False))


def first_verdicts(judged: DataFrame) -> DataFrame:
    """Per package the first judged import or install claim: where it stands and whether the package exists."""
    usable, exists = verdict_of(judged)
    # One row per package; combined map-side, so a package in most claims costs no more than others.
    return judged.filter(usable).groupBy(package_key("package_name").alias("package_key")).agg(
        F.min(F.struct(_place().alias("place"), exists.alias("exists"))).alias("f")
    ).select("package_key", F.col("f.place").alias("_place"), F.col("f.exists").alias("package_exists"))


def known_verdicts(claims: DataFrame) -> DataFrame:
    """Give claims of known packages (`known`) their verdict: the package exists, nothing was looked up."""
    k = F.coalesce("known", F.lit(False))
    # The labels of a known package.
    fixed = {
        "hallucination": "No", "abstention": "No", "verification_error": "No",
        "reference_grounding": "Verified - Whitelisted package",
        "content_grounding": "Package is in known packages list",
    }
    return claims.withColumns({
        **{c: F.when(k, v).otherwise(F.col(c)) for c, v in fixed.items() if c in claims.columns},
        **{f: ~k & F.coalesce(F.col(f), F.lit(False)) for f in FLAGS}})


def reuse_verdicts(judged: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Later import and install claims of a package take its first judged verdict.

    Installs that ask for a version (`versioned`, or as the snippet says) are always judged
    themselves. Adds `reused` and `package_exists`.
    """
    first = first_verdicts(judged) if verdicts is None else verdicts
    kind = F.col("element_type")
    versioned = F.col("versioned") if "versioned" in judged.columns else has_version("code_snippet")
    cacheable = (kind == "import") | ((kind == "install") & ~versioned)
    joined = judged.withColumn("package_key", package_key("package_name")).join(first, "package_key", "left")
    reused = F.coalesce(cacheable & (_place() > F.col("_place")), F.lit(False))
    if "known" in judged.columns:
        reused = reused & ~F.coalesce("known", F.lit(False))
    r, exists = F.col("reused"), F.col("package_exists")
    out = joined.withColumn("reused", reused)
    # The labels of a reused verdict.
    labels = {
        "reference_grounding": F.when(exists, "Verified - Cached verdict (exists)").otherwise(
            "Verified - Cached verdict (does NOT exist)"),
        "content_grounding": F.lit("Package was verified via web search earlier in this run"),
        "abstention": F.lit("No"), "verification_error": F.lit("No"),
    }
    return out.withColumns({
        **{c: F.when(r, v).otherwise(F.col(c)) for c, v in labels.items() if c in judged.columns},
        "hallucination": F.when(r, F.when(exists, "No").otherwise("Yes")).otherwise(F.col("hallucination")),
        FLAGS[0]: F.when(r, (kind == "import") & ~exists).otherwise(F.coalesce(FLAGS[0], F.lit(False))),
        FLAGS[1]: F.when(r, (kind == "install") & ~exists).otherwise(F.coalesce(FLAGS[1], F.lit(False))),
        FLAGS[2]: ~r & F.coalesce(FLAGS[2], F.lit(False)),
        "package_exists": F.when(r, exists),
    }).select(*judged.columns, "reused", "package_exists")


# ---- known packages, reuse and early stopping together -------------------------------------


def _resolved_with(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with `reused`, `package_exists`, `skipped_early_stopping`, given each package's source."""
    marked = reuse_verdicts(claims, sources)
    settled = F.coalesce("known", F.lit(False))
    marked = marked.withColumn("_known", settled).withColumn("known", settled | F.col("reused"))
    return early_stop(marked)


def resolve_coding_claims(claims: DataFrame) -> DataFrame:
    """Known packages, reused verdicts and early stopping in the one order (conv_id, turn, claim_idx).

    `claims` carry the answer their judge gives if asked, `known`, and on request `error`. A known
    package is settled first; then an import, or an install without a version, of a package
    judged before takes that verdict; then a claim whose type was detected earlier in its turn is
    skipped; all others are judged. Only judged claims without an error raise types or become
    sources. Adds `reused`, `package_exists`, `skipped_early_stopping`.

    Skips depend on reuse and sources on skips, always on earlier places, so the sources have
    one fixed point (`resolution`); later rounds take up only what the round before changed.
    """
    from verdictlake.operators.resolution import settled_sources

    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in claims.columns else F.lit(False)
    asked = claims.withColumns({f: ~failed & F.coalesce(F.col(f), F.lit(False)) for f in FLAGS})
    usable, _ = verdict_of(asked)
    kind, open_ = F.col("element_type"), ~F.coalesce(F.col("known"), F.lit(False)) & ~failed
    cacheable = (kind == "import") | ((kind == "install") & ~has_version("code_snippet"))
    narrow = asked.filter(open_).select(
        *TURN, "claim_idx", package_key("package_name").alias("package_key"), F.coalesce(cacheable, F.lit(False)).alias("asked"),
        F.coalesce(usable, F.lit(False)).alias("usable"), type_number(kind).alias("own"), _mask().alias("mask"))
    resolved = _resolved_with(asked, settled_sources(narrow))
    return known_verdicts(resolved.withColumn("known", F.col("_known"))).drop("_known")


def skip_stats(resolved: DataFrame) -> DataFrame:
    """One row of counts over `resolve_coding_claims`: turns tracked and fully stopped, claims skipped; reuse hits, misses, packages, known.

    A turn's types are those its judged claims raised. A miss is an import, or an install
    without a version, that was judged itself. One aggregate per turn and one over all turns;
    packages are counted apart, by their first claim.
    """
    kind, known = F.col("element_type"), F.coalesce("known", F.lit(False))
    judged = ~known & ~F.col("reused") & ~F.col("skipped_early_stopping")
    asked = (kind == "import") | ((kind == "install") & ~has_version("code_snippet"))
    turns = resolved.groupBy(*TURN).agg(
        *[F.bool_or(judged & F.coalesce(F.col(f), F.lit(False))).alias(f"_{k}") for k, f in enumerate(FLAGS)],
        F.count_if("skipped_early_stopping").alias("skips"), F.count_if("reused").alias("hits"),
        F.count_if(asked & judged).alias("misses"), F.count_if(known).alias("known"))
    packages = resolved.filter(kind.isin("import", "install") & ~known).select(package_key("package_name").alias("p")).distinct()

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return turns.agg(
        F.count_if(F.expr("_0 OR _1 OR _2")).alias("turns_tracked"), F.count_if(F.expr("_0 AND _1 AND _2")).alias("turns_fully_stopped"),
        total("skips").alias("claims_skipped"), total("hits").alias("cache_hits"), total("misses").alias("cache_misses"),
        total("known").alias("whitelist_skips")).withColumn("cached_packages", packages.agg(F.count("p")).scalar())


# ---- evidence selection --------------------------------------------------------------------


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 when either has no length."""
    def dot(x, y) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def score_blocks(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of each claim with their similarity to it."""
    joined = blocks.join(claims.select("claim_id", F.col("embedding").alias("_claim")), "claim_id")
    return joined.withColumn("similarity", cosine("_claim", "embedding")).drop("_claim")


PICK = "claim_id {id}, step BIGINT, block_idx BIGINT, truncated BOOLEAN, words BIGINT, done BOOLEAN, last_sim DOUBLE, last_idx BIGINT, vector ARRAY<DOUBLE>"


WALKED = ["claim_id", "step", "block_idx", "truncated", "words", "done", "last_sim", "last_idx", "vector"]
# What text is split at: Unicode white space and the four separators before it.
TOKEN = r"(?U)[^\s\x1c-\x1f]++"
FETCH_ROWS = 1_000_000


def select_evidence(
    claims: DataFrame, blocks: DataFrame, budget: int = 1500, dedup: float = 0.85, batch: int = 64
) -> DataFrame:
    """Blocks a judge gets to see: most similar first, near copies of chosen ones left out, up to `budget` words.

    Blocks are scored once, as (claim_id, block_idx, vector, word count, similarity); the walk
    runs on those, and texts are fetched for the chosen blocks only. The walk over a claim's
    blocks is sequential. It runs on the `batch` best blocks of every claim (pruned before the
    shuffle); claims that neither reached the budget nor ran out go on with their next best
    blocks, from which copies of the chosen ones are filtered first, in parallel. So no claim's
    blocks are gathered whole, and none are dropped unseen. Ties: lower block_idx first. A last
    block is cut when more than 10 words still fit. (claim_id, block_idx) is unique.
    """
    narrow = blocks.select("claim_id", "block_idx", "embedding", F.regexp_count("block", F.lit(TOKEN)).cast("bigint").alias("words"))
    scored = write_through(score_blocks(claims, narrow))
    id_type = dict(scored.dtypes)["claim_id"]
    schema = PICK.format(id=id_type)
    best = [F.desc("similarity"), F.asc("block_idx")]
    pool, chosen, cursor = scored, None, None
    while True:
        part = first_n_by(pool, ["claim_id"], best, batch)
        if cursor is None:
            walked = part.groupBy("claim_id").applyInPandas(_walker(budget, dedup, batch), schema)
        else:
            going_on = chosen.join(cursor.select("claim_id"), "claim_id", "left_semi")
            state = going_on.select("claim_id", "step", "words", "vector")
            walked = part.groupBy("claim_id").cogroup(state.groupBy("claim_id")).applyInPandas(
                _continued(budget, dedup, batch), schema)
        walked = settle(walked)
        picks = walked.filter("block_idx IS NOT NULL")
        chosen = picks if chosen is None else chosen.unionByName(picks)
        cursor = walked.filter("block_idx IS NULL AND NOT done").select("claim_id", "last_sim", "last_idx")
        if cursor.isEmpty():
            break
        pool = _remaining(scored, cursor, chosen, dedup)
    return _with_texts(write_through(chosen.select("claim_id", "step", "block_idx", "truncated", "words")), blocks)


def _with_texts(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chosen blocks with their texts, a truncated one cut to its words.

    The chosen keys go to the blocks if a count allows it, so that no text moves but theirs;
    beyond that both sides are shuffled.
    """
    keys = F.broadcast(chosen) if chosen.count() <= FETCH_ROWS else chosen
    cut = F.array_join(F.slice(F.regexp_extract_all("block", F.lit(TOKEN), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text_ = F.when(F.col("truncated"), F.concat(cut, F.lit("..."))).otherwise(F.col("block"))
    return blocks.select("claim_id", "block_idx", "block").join(keys, ["claim_id", "block_idx"]).select(
        "claim_id", "step", "block_idx", text_.alias("block"), "truncated")


def _remaining(scored: DataFrame, cursor: DataFrame, chosen: DataFrame, dedup: float) -> DataFrame:
    """Blocks of unfinished claims after the cursor that are no copy of a chosen block."""
    # At most `budget` vectors per claim, as every chosen block uses at least one word.
    kept = chosen.filter("NOT truncated").groupBy("claim_id").agg(F.collect_list("vector").alias("_held"))
    open_claims = cursor.join(kept, "claim_id", "left")
    after = (F.col("similarity") < F.col("last_sim")) | (
        (F.col("similarity") == F.col("last_sim")) & (F.col("block_idx") > F.col("last_idx")))
    joined = scored.join(open_claims, "claim_id").filter(after)
    fresh = ~F.exists(F.coalesce("_held", F.array().cast("array<array<double>>")),
                      lambda e: cosine(e, F.col("embedding")) > dedup)
    return write_through(joined.filter(fresh).select(*scored.columns))


def _walk(pdf: pd.DataFrame, held: list[np.ndarray], words: int, step: int, budget: int, dedup: float, batch: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["similarity", "block_idx"], ascending=[False, True])
    rows, done = [], len(pdf) < batch
    for b in pdf.itertuples(index=False):
        vec = np.asarray(b.embedding, dtype=float)
        vec = vec / (np.linalg.norm(vec) + 1e-10)
        if held and np.max(np.stack(held) @ vec) > dedup:
            continue
        if words + b.words > budget:
            left = budget - words
            if left > 10:
                rows.append((b.claim_id, step, b.block_idx, True, left, vec))
            done = True
            break
        rows.append((b.claim_id, step, b.block_idx, False, b.words, vec))
        words, step = words + b.words, step + 1
        held.append(vec)
    last = pdf.iloc[-1]
    out = [(*r[:5], False, None, None, r[5]) for r in rows]
    out.append((last.claim_id, step, None, False, words, done, float(last.similarity), int(last.block_idx), None))
    return pd.DataFrame(out, columns=WALKED).astype({"block_idx": "Int64", "last_idx": "Int64"})


def _walker(budget: int, dedup: float, batch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _walk(pdf, [], 0, 0, budget, dedup, batch)
    return run


def _continued(budget: int, dedup: float, batch: int):
    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=WALKED)
        held = [np.asarray(v, dtype=float) for v in state["vector"]]
        return _walk(pdf, held, int(state["words"].sum()), len(state), budget, dedup, batch)
    return run


def assemble_evidence(picks: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence text per claim: sections in source order, blocks in the order they were chosen.

    `sources` carries claim_id, block_idx, source_idx, title, url, snippet. The word budget bounds a claim's rows.
    """
    placed = picks.join(sources, ["claim_id", "block_idx"])
    head = F.concat(
        F.lit("-- Source: "), F.coalesce("title", F.lit("Unknown")), F.lit(", url: "), text("url"), F.lit(" --\n"),
        F.when(text("snippet") != "", F.concat(F.col("snippet"), F.lit("\n\n"))).otherwise(""))
    ordered = F.sort_array(F.collect_list(F.struct("step", "block")))
    sections = placed.groupBy("claim_id", "source_idx").agg(
        F.min(head).alias("head"), F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("body"))
    parts = F.sort_array(F.collect_list(F.struct("source_idx", F.concat("head", "body").alias("t"))))
    return sections.groupBy("claim_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("evidence_text"))


def rank_blocks(scored: DataFrame, n: int) -> DataFrame:
    """The n most similar blocks of each claim."""
    w = Window.partitionBy("claim_id").orderBy(F.desc("similarity"), "block_idx")
    return scored.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n)
