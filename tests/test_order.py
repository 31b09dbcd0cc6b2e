"""Order-dependent operators against plain sequential code, and helpers against one-window forms."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdictlake.operators import ranking as K
from verdictlake.operators import stateful as Z
from verdictlake.scale import number_globally, position_in_group, previous_in_group

TYPES = ("import", "install", "function_call", "other")
CLAIM = ("conv_id BIGINT, turn BIGINT, claim_idx BIGINT, claim_id STRING, element_type STRING, hallucination STRING, "
         "hallucinated_import_detected BOOLEAN, hallucinated_install_detected BOOLEAN, "
         "hallucinated_function_usage_detected BOOLEAN, known BOOLEAN, package_name STRING, code_snippet STRING")


def random_claims(seed, n_turns, n_claims, hot=0):
    rng = random.Random(seed)
    rows = []
    for t in range(n_turns):
        for k in range(hot if t == 0 and hot else rng.randint(1, n_claims)):
            flags = [rng.random() < 0.15 for _ in range(3)]
            rows.append((t // 3, t % 3, k, f"c{t}-{k}", rng.choice(TYPES), rng.choice(["Yes", "No"]), *flags,
                         rng.random() < 0.1, rng.choice(["numpy", "cv2", "PIL ", "x"]),
                         rng.choice(["pip install a", "pip install a==1", "import a"])))
    rng.shuffle(rows)
    return rows


def sequential_skips(rows):
    skipped, state = set(), {}
    for r in sorted(rows, key=lambda r: r[:3]):
        seen = state.setdefault(r[:2], set())
        if r[9]:
            continue
        if r[4] in seen:
            skipped.add(r[3])
            continue
        seen |= {t for t, f in zip(TYPES, r[6:9]) if f}
    return skipped


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 0), (3, 3000)])
def test_early_stop_equals_sequential(spark, seed, hot):
    rows = random_claims(seed, 60, 25, hot)
    out = Z.early_stop(spark.createDataFrame(rows, CLAIM).repartition(5))
    got = {r.claim_id for r in out.filter("skipped_early_stopping").select("claim_id").collect()}
    assert got == sequential_skips(rows)


def test_early_stop_skipped_claim_adds_nothing(spark):
    rows = [(1, 0, 0, "a", "import", "Yes", True, False, False, False, "p", ""),
            (1, 0, 1, "b", "import", "Yes", False, False, True, False, "p", ""),
            (1, 0, 2, "c", "function_call", "No", False, False, False, False, "p", "")]
    out = {r.claim_id: r for r in Z.early_stop(spark.createDataFrame(rows, CLAIM)).collect()}
    assert out["b"].skipped_early_stopping and out["b"].hallucination == "Skipped"
    assert not out["c"].skipped_early_stopping


def test_reuse_equals_sequential(spark):
    rows = random_claims(5, 40, 12)
    out = {r.claim_id: r for r in Z.reuse_verdicts(spark.createDataFrame(rows, CLAIM)).collect()}
    names = {"numpy": "numpy", "cv2": "opencv-python", "PIL ": "pillow", "x": "x"}
    first = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        if r[9] or r[4] not in ("import", "install"):
            assert not out[r[3]].reused
            continue
        pkg = names[r[10]]
        if pkg not in first:
            first[pkg] = not (r[6] if r[4] == "import" else r[7])
            assert not out[r[3]].reused
        elif r[4] == "install" and "==" in r[11]:
            assert not out[r[3]].reused
        else:
            assert out[r[3]].reused and out[r[3]].package_exists == first[pkg]
            assert out[r[3]].hallucination == ("No" if first[pkg] else "Yes")


def walked(rows, names):
    """Outcome of every claim, one after the other: known, exists, missing, skipped or judged."""
    out, verdicts, detected = {}, {}, {}
    for r in sorted(rows, key=lambda r: r[:3]):
        kind, pkg, seen = r[4], names[r[10]], detected.setdefault(r[:2], set())
        if r[9]:
            out[r[3]] = "known"
        elif pkg in verdicts and (kind == "import" or (kind == "install" and "==" not in r[11])):
            out[r[3]] = "exists" if verdicts[pkg] else "missing"
        elif kind in seen:
            out[r[3]] = "skipped"
        else:
            out[r[3]] = "judged"
            if not r[12]:
                seen |= {t for t, f in zip(TYPES, r[6:9]) if f}
                if kind in ("import", "install"):
                    verdicts.setdefault(pkg, not (r[6] if kind == "import" else r[7]))
    return out


@pytest.mark.parametrize("seed,packages", [(1, 4), (2, 300)])
def test_joint_resolution_equals_sequential(spark, seed, packages):
    rng = random.Random(seed)
    names = {f"lib{k}": f"lib{k}" for k in range(packages)}
    rows = [(*r[:10], rng.choice(list(names)), r[11], "late" if rng.random() < 0.2 else None) for r in random_claims(seed, 40, 25)]
    got = Z.resolve_coding_claims(spark.createDataFrame(rows, CLAIM + ", error STRING").repartition(3)).collect()
    label = lambda r: ("known" if r.known else ("exists" if r.package_exists else "missing") if r.reused
                       else "skipped" if r.skipped_early_stopping else "judged")
    assert {r.claim_id: label(r) for r in got} == walked(rows, names)
    assert len(got) == len(rows) and {r.hallucination for r in got if label(r) == "missing"} <= {"Yes"}


@pytest.mark.parametrize("folder_rows", [50_000, 20])
def test_later_rounds_take_up_only_what_changed(spark, monkeypatch, folder_rows):
    """A chain in which each skip depends on a reuse that depends on the skip before, among unrelated turns."""
    from verdictlake.operators import resolution

    monkeypatch.setattr(resolution, "FOLDER_ROWS", folder_rows)
    chain, rest = 9, 150

    def claim(conv, idx, package, raised):
        return (conv, 0, idx, f"{conv}:{idx}", "import", "No", raised, False, False, False, package, "import x", None)

    rows = [claim(0, 1, "p1", False)]
    for k in range(1, chain):
        rows += [claim(k, 0, f"p{k}", True), claim(k, 1, f"p{k + 1}", False)]
    for k in range(rest):
        rows += [claim(1000 + k, j, f"q{k}:{j}", j == 1) for j in range(3)]
    trace, real = [], resolution.settled_sources
    monkeypatch.setattr(resolution, "settled_sources", lambda narrow: real(narrow, trace))
    got = Z.resolve_coding_claims(spark.createDataFrame(rows, CLAIM + ", error STRING")).collect()
    want = walked(rows, {r[10]: r[10] for r in rows})
    assert {r.claim_id: (r.reused, r.skipped_early_stopping) for r in got} == {
        c: (o in ("exists", "missing"), o == "skipped") for c, o in want.items()}
    assert len(trace) >= chain - 1 and trace[0] > 2 * rest and max(trace[1:]) <= 8, trace


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, "", *[f"d{j}" for j in range(40)]]), rng.choice([None, *[f"t{j}" for j in range(60)]]))
            for k in range(300)]
    rows += [(300 + k, f"hot{k}", "one title") for k in range(150)]
    kept, seen = [], (set(), set())
    for k, doi, title in rows:
        if (doi and doi in seen[0]) or (title and title in seen[1]):
            continue
        kept.append(k)
        seen[0].add(doi)
        seen[1].add(title)
    df = spark.createDataFrame(rows, "id BIGINT, doi STRING, title STRING").repartition(4)
    assert sorted(r.id for r in K.dedup_any_key(df, ["doi", "title"], "id").collect()) == kept


def test_dedup_chain_keeps_what_dropped_rows_would_block(spark):
    rows = [(1, "d1", "t1"), (2, "d2", "t1"), (3, "d2", "t3"), (4, None, "t3"), (5, None, None), (6, None, None)]
    df = spark.createDataFrame(rows, "id BIGINT, doi STRING, title STRING")
    assert sorted(r.id for r in K.dedup_any_key(df, ["doi", "title"], "id").collect()) == [1, 3, 5, 6]


def jobs_of(spark, run):
    """What `run` gives, and how many Spark jobs it took."""
    context, group = spark.sparkContext, f"counted-{random.random()}"
    context.setJobGroup(group, group)
    try:
        out = run()
        return out, len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def chained(n):
    """Each row shares one key with the row before and one with the row after: every second row stays."""
    return [(k, f"d{(k + 1) // 2}", f"t{k // 2}") for k in range(n)]


def test_dedup_of_a_long_chain_takes_jobs_by_no_length(spark):
    jobs = {}
    for n in (100, 1000):
        df = spark.createDataFrame(chained(n), "id BIGINT, doi STRING, title STRING").repartition(4)
        got, jobs[n] = jobs_of(spark, lambda df=df: sorted(r.id for r in K.dedup_any_key(df, ["doi", "title"], "id").collect()))
        assert got == list(range(0, n, 2))
    assert jobs[1000] < jobs[100] + 40 and jobs[1000] < 250, jobs


def test_components_too_large_to_walk_go_on_in_rounds(spark):
    rows = chained(14) + [(100 + k, f"e{k // 3}", f"u{(k + 1) // 3}") for k in range(30)]
    df = spark.createDataFrame(rows, "id BIGINT, doi STRING, title STRING")
    want = sorted(r.id for r in K.dedup_any_key(df, ["doi", "title"], "id").collect())
    assert sorted(r.id for r in K.dedup_any_key(df, ["doi", "title"], "id", walked_rows=3).collect()) == want


def test_components_of_random_edges(spark):
    from verdictlake.operators.graph import connected_components

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 - k, 999 - k) for k in range(200)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


@pytest.mark.parametrize("n", [0, 1, 7, 3000, 4999, 5000, 6000])
def test_first_n_of_any_order(spark, n, monkeypatch):
    monkeypatch.setattr(K, "EDGE_ROWS", 50)
    monkeypatch.setattr(K, "PIVOTS", 8)
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", f"x{k % 90}"]), rng.choice([None, 1.5, float(k % 11)]), k) for k in range(5000)]
    df = spark.createDataFrame(rows, "s STRING, v DOUBLE, k BIGINT").repartition(5)
    low = lambda x: (x is not None, x if x is not None else 0)
    want = sorted(rows, key=lambda r: (low(r[0])[0], r[0] or "", *low(r[1]), r[2]))[:n]
    assert sorted(map(repr, (tuple(r) for r in K.first_n(df, ["s", "v", "k"], n).collect()))) == sorted(map(repr, want))
    tied = K.first_n(df, ["s"], n).collect()
    assert sorted((r.s or "", r.s is not None) for r in tied) == sorted((r[0] or "", r[0] is not None) for r in sorted(rows, key=lambda r: (low(r[0])[0], r[0] or ""))[:n])


def test_first_n_gathers_nothing_in_one_task(spark):
    df = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.col("id").cast("string").alias("text"))
    out = K.first_n(df, ["k"], 200_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Exchange" not in plan
    assert out.count() == 200_000 and out.agg(F.max("k")).first()[0] < 200_020


@pytest.mark.parametrize("n", [0, 3, 50, 700, 2400, 5000])
def test_even_samples_rank_only_edge_cells(spark, n, monkeypatch):
    import hashlib

    rows = [(k, "hot" if k % 3 == 0 else None if k % 17 == 0 else f"s{k % 5}" if k % 2 else f"rare{k % 211}") for k in range(3000)]
    ranked, real = [], K._edge_ranks
    monkeypatch.setattr(K, "_edge_ranks", lambda part, *a: ranked.append(part) or real(part, *a))
    got = K.stratified_even(spark.createDataFrame(rows, "id BIGINT, s STRING").repartition(5), "s", n, 9, ["id"]).collect()
    strata = {}
    for k, s in sorted(rows, key=lambda r: (hashlib.md5(f"9:{r[0]}".encode()).hexdigest(), r[0])):
        strata.setdefault(s, []).append(k)
    share = n // len(strata)
    missing = sum(max(0, share - len(v)) for v in strata.values()) + n % len(strata)
    spare = sorted((x for v in strata.values() for x in v[share:share + missing]), key=lambda k: (hashlib.md5(f"9:{k}".encode()).hexdigest(), k))
    want = [x for v in strata.values() for x in v[:share]] + spare[:missing]
    assert sorted(r.id for r in got) == sorted(want)
    # A third of all rows is one stratum; a few of its rows are ranked.
    for part in ranked:
        most = {r["s"]: r["count"] for r in part.groupBy("s").count().collect()}
        assert most.get("hot", 0) <= 6


def greedy_evidence(blocks, claim, budget, dedup):
    unit = [np.asarray(b[3]) / np.linalg.norm(b[3]) for b in blocks]
    sims = [float(u @ (np.asarray(claim) / np.linalg.norm(claim))) for u in unit]
    held, words, out = [], 0, []
    for k in sorted(range(len(blocks)), key=lambda k: (-round(sims[k], 12), blocks[k][1])):
        if any(float(h @ unit[k]) > dedup for h in held):
            continue
        n = len(blocks[k][2].split())
        if words + n > budget:
            if budget - words > 10:
                out.append((blocks[k][1], True))
            break
        out.append((blocks[k][1], False))
        words += n
        held.append(unit[k])
    return out


@pytest.mark.parametrize("batch", [2, 5, 64])
def test_evidence_equals_greedy_for_any_batch(spark, batch):
    rng = np.random.default_rng(3)
    claims, blocks = [], []
    for c in range(4):
        claims.append((f"c{c}", [float(x) for x in rng.normal(size=6)]))
        base = rng.normal(size=(8, 6))
        for b in range(40):
            vec = base[b % 8] + rng.normal(size=6) * (0.05 if b % 2 else 0.8)
            blocks.append((f"c{c}", b, " ".join(["w"] * int(rng.integers(5, 60))), [float(x) for x in vec]))
    cdf = spark.createDataFrame(claims, "claim_id STRING, embedding ARRAY<DOUBLE>")
    bdf = spark.createDataFrame(blocks, "claim_id STRING, block_idx BIGINT, block STRING, embedding ARRAY<DOUBLE>")
    out = Z.select_evidence(cdf, bdf, budget=300, batch=batch).collect()
    for cid, vec in claims:
        got = [(r.block_idx, r.truncated) for r in sorted((r for r in out if r.claim_id == cid), key=lambda r: r.step)]
        assert got == greedy_evidence([b for b in blocks if b[0] == cid], vec, 300, 0.85)


def test_no_text_moves_before_the_walk_and_only_chosen_texts_after(spark, tmp_path):
    claims = spark.createDataFrame([("c", [1.0, 0.0]), ("d", [0.0, 1.0])], "claim_id STRING, embedding ARRAY<DOUBLE>")
    blocks = [(c, k, f"word{k} \u2003two\x1cthree " * 40 + "tail", [1.0, k / 10]) for c in "cd" for k in range(30)]
    spark.createDataFrame(blocks, "claim_id STRING, block_idx BIGINT, block STRING, embedding ARRAY<DOUBLE>").write.parquet(f"{tmp_path}/blocks")
    table = spark.read.parquet(f"{tmp_path}/blocks")
    plans, real = [], Z.write_through
    monkey = pytest.MonkeyPatch()
    monkey.setattr(Z, "write_through", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    out = Z.select_evidence(claims, table, budget=200, dedup=2.0)
    monkey.undo()
    for plan in plans:
        for line in plan.splitlines():
            assert "Exchange" not in line or "block#" not in line
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "hashpartitioning" not in final
    got = {(r.claim_id, r.step): r for r in out.collect()}
    assert got[("c", 0)].block == blocks[0][2] and not got[("c", 0)].truncated
    assert got[("c", 1)].truncated and got[("c", 1)].block == " ".join(blocks[1][2].split()[:200 - 121]) + "..."


def test_positions_and_previous_equal_one_window(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), k, f"v{k}") for k in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k BIGINT, ord BIGINT, v STRING")
    w = Window.partitionBy("k").orderBy("ord")
    want = df.select("k", "ord", "v", F.row_number().over(w).cast("bigint").alias("p"), F.lag("v", 1, "-").over(w).alias("prev"))
    got = position_in_group(df, ["k"], "ord", "p", span=64)
    got = previous_in_group(got, ["k"], "ord", "v", "prev", F.lit("-"), span=64)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_global_numbers_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(parts)
    got = number_globally(df, ["x"], "n").collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000


def test_first_n_does_not_sort_whole_groups(spark):
    plan = K.first_n_per(spark.range(1000).withColumn("k", F.col("id") % 3), "k", ["id"], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_even_sample_is_even_and_repeatable(spark):
    rows = [(k, "a" if k < 3 else "b" if k < 60 else "c") for k in range(200)]
    df = spark.createDataFrame(rows, "id BIGINT, s STRING")
    one = sorted(map(tuple, K.stratified_even(df, "s", 31, 7, ["id"]).collect()))
    two = sorted(map(tuple, K.stratified_even(df.repartition(17), "s", 31, 7, ["id"]).collect()))
    assert one == two and len(one) == 31 and sum(s == "a" for _, s in one) == 3
    assert min(sum(s == x for _, s in one) for x in "bc") >= 10
