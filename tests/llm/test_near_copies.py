"""SimHash as the first finder of near copies, and sketches that never lose a similar pair."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdictlake.llm import near_copies, simhash
from verdictlake.llm.rows import RID, identified


def test_sketches_keep_all_similar_sets_and_drop_others():
    rng = np.random.default_rng(4)
    dropped = 0
    for n in (1, 7, 60, 300, 5000, 300_000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.1, 0.11, 0.2, 0.5):
            other = np.concatenate([base[:n - int(share * n)], rng.integers(0, 1 << 63, int(share * n) // 2, dtype=np.uint64)])
            x, y = np.unique(base), np.unique(other)
            both = len(np.intersect1d(x, y))
            fits = near_copies.may_be_similar(near_copies.sketch(x).tobytes(), near_copies.sketch(y).tobytes(), len(x), len(y))
            assert fits or 5 * both < 4 * (len(x) + len(y) - both)
            dropped += not fits
    assert dropped >= 4


def test_near_copies_come_through_the_trie_join(spark, monkeypatch):
    """Candidates of the trie join are compared exactly; what it cannot meet is found by the exact way."""
    base = [f"v{k}" for k in range(400)]
    docs = [(k, " ".join([*base[:399], f"end{k}"])) for k in range(5)] + [(9, " ".join(f"u{k}" for k in range(300)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    marked = near_copies.keyed(identified(frame).select(RID, F.col("doc_id").alias("_id"), "text"), "text")
    order = F.struct("_id", "fp", "n", "sketch")
    pairs = near_copies.fingerprint_pairs(marked.groupBy("key").agg(F.min(order).alias("first"))).collect()
    assert len(pairs) >= 4
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or links(*a, **k))
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each(frame).collect()) == [0, 9]
    assert asked


def test_pairs_that_sketches_rule_out_are_no_rows():
    """A shingle that many unlike sets share makes rows for its similar pairs alone, not for the square of its sets."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for size in (*[100] * 150, *rng.integers(20, 400, 150))]
    sets += [np.concatenate([found[:-2], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for found in sets[::10]]
    # The last two copies have the root of their originals: those pairs are settled already.
    rows = [(h, key, len(found), 10 * (key - 300) if key >= 328 else key, near_copies.sketch(found).tobytes())
            for h in (3, 8) for key, found in enumerate(sets)] + [(5, 1, 100, 1, near_copies.sketch(sets[1]).tobytes())]
    table = pa.table(dict(zip(("h", "key", "n", "root", "sketch"), zip(*sorted(rows)))), schema=pa.schema(
        [("h", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("root", pa.int64()), ("sketch", pa.binary())]))
    want = {(a, b) for h, a, n, r, s in rows for g, b, m, q, t in rows
            if h == g and a < b and r != q and 5 * min(n, m) >= 4 * max(n, m) and near_copies.may_be_similar(s, t, n, m)}
    got = [p for batch in near_copies._open_pairs(iter(table.to_batches(max_chunksize=50))) for p in zip(*(c.to_pylist() for c in batch.columns))]
    assert {tuple(sorted(p)) for p in got} == want and len(got) == 2 * len(want) and 28 <= len(want) < 100
    bare = list(near_copies._open_rows(iter(table.drop_columns("sketch").to_batches())))
    assert {h for batch in bare for h in batch.column("h").to_pylist()} == {3, 8} and sum(b.num_rows for b in bare) == 2 * len(sets)
    cut = list(near_copies._runs(iter(table.to_batches(max_chunksize=50)), "h", 60))
    assert pa.concat_tables(cut).equals(table) and len(cut) == 2


def test_pairs_below_the_similarity_in_a_large_group_are_no_rows():
    """Half-like variants of one text that share a shingle make hardly any rows but those of their similar pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets = [np.concatenate([base, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(200)]
    sets += [np.concatenate([found[:-5], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for found in sets[:20]]
    sketches = [near_copies.sketch(found).tobytes() for found in sets]
    size = len(sets)
    table = pa.table({"h": [3] * size, "key": list(range(size)), "n": pa.array([100] * size, pa.int32()), "root": list(range(size)), "sketch": sketches})
    got = {p for batch in near_copies._open_pairs(iter(table.to_batches())) for p in zip(*(c.to_pylist() for c in batch.columns))}
    similar = {(k, 200 + k) for k in range(20)}
    assert similar <= got and len(got) <= 100, len(got)
    closest = {p for batch in near_copies._closest_pairs(iter(table.to_batches())) for p in zip(*(c.to_pylist() for c in batch.columns))}
    assert similar <= closest <= got


def test_closest_pairs_follow_the_rows_of_a_group():
    """A group of which all pairs may be similar makes no more pairs than rows, and each row that has a partner is in one."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 95, dtype=np.uint64)
    sets = [np.concatenate([base, rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for _ in range(150)]
    rows = [(h, key, 100, key // 2, near_copies.sketch(sets[key]).tobytes()) for h in (1, 2, 5) for key in range(150)]
    rows += [(8, 0, 100, 0, rows[0][4]), (8, 1, 100, 0, rows[1][4]), (9, 2, 100, 1, rows[2][4])]
    table = pa.table(dict(zip(("h", "key", "n", "root", "sketch"), zip(*rows))), schema=pa.schema(
        [("h", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("root", pa.int64()), ("sketch", pa.binary())]))
    got = [p for batch in near_copies._closest_pairs(iter(table.to_batches(max_chunksize=40))) for p in zip(*(c.to_pylist() for c in batch.columns))]
    assert 75 <= len(got) <= 450 and {k for p in got for k in p} == set(range(150))
    assert all(a < b and a // 2 != b // 2 for a, b in got)


def test_rows_without_a_partner_by_size_and_place_are_dropped():
    """A row stays only if another root's row of its shingle is near in size and has enough of its set from there on."""
    rng = np.random.default_rng(8)
    for buckets, most in ((400, 60), (3, 900), (40, 2)):
        bucket = np.sort(rng.integers(0, buckets, 1200))
        n = rng.integers(1, most + 1, 1200).astype(np.int32)
        rest = np.maximum(1, n - (rng.random(1200) * 0.25 * n).astype(np.int32)).astype(np.int32)
        root = rng.integers(0, 4, 1200)
        got = near_copies._with_partner(bucket, n, rest, root)
        x, y = np.meshgrid(np.arange(1200), np.arange(1200), indexing="ij")
        meet = (bucket[x] == bucket[y]) & (root[x] != root[y]) & (9 * np.minimum(rest[x], rest[y]) >= 4 * (n[x] + n[y]))
        assert (got == meet.any(1)).all() and got.any() and (buckets < 400 or not got.all())
    table = pa.table({"h": [1, 1, 1, 2, 2], "key": [1, 2, 3, 1, 2], "n": pa.array([100, 100, 100, 100, 100], pa.int32()),
                      "rest": pa.array([100, 95, 85, 99, 85], pa.int32()), "root": [1, 2, 3, 1, 2]})
    assert sorted(r for b in near_copies._open_rows(iter(table.to_batches())) for r in zip(b["h"].to_pylist(), b["key"].to_pylist())) == [(1, 1), (1, 2)]
    assert sorted(r for b in near_copies._shared(iter(table.drop_columns("root").to_batches())) for r in zip(b["h"].to_pylist(), b["key"].to_pylist())) == [(1, 1), (1, 2)]


def test_first_shared_shingles_of_similar_sets_are_never_ruled_out():
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 9, 60, 333):
        for m in range(n, 5 * n // 4 + 1):
            both = -(-4 * (n + m) // 9)
            sets = [[*range(both)], [*range(both)]]
            sets = [np.sort(rng.permutation([*s, *range(k * 10_000, k * 10_000 + size - both)])) for k, s, size in ((1, sets[0], n), (2, sets[1], m)) if both <= size]
            if len(sets) < 2:
                continue
            place = rng.permutation(30_000)
            x, y = (sorted(s, key=lambda e: place[e]) for s in sets)
            first = next(e for e in x if e in set(y))
            i, j = x.index(first), y.index(first)
            assert i < near_copies.prefix_length(n) and j < near_copies.prefix_length(m) and near_copies._fits(n, m, n - i, m - j)
