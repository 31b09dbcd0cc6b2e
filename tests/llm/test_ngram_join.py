"""The n-gram Jaccard join against brute force: its signatures, its crowded and spread paths, odd rows."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import duck
from pyspark.sql import functions as F

from verdictlake.llm import ngram_join
from verdictlake.scale import write_through

CLASHING = ("_rid", "key", "n", "sketch", "first", "root", "lead", "sig", "_id", "_t", "_text", "_head", "_salt", "_parts")


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words)} if 0 < len(words) < 5 else {b" ".join(words[k:k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """(id, set size, smallest id reachable) of every (id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[k]), least[root(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def found(docs, **options):
    _, rows = ngram_join.linked(docs, **options)
    return sorted(((r["_id"], r["n"], r["id"]) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def copies():
    """Chains of edits around the threshold, groups that share most signatures, and unrelated texts."""
    draw, rows = random.Random(4), []
    for size in (5, 6, 9, 14, 30, 90, 260):
        base = [f"w{draw.randrange(9000)}" for _ in range(size)]
        for _ in range(14):
            for _ in range(draw.randrange(1 + size // 14)):
                base = list(base)
                base[draw.randrange(len(base))] = f"x{draw.randrange(9000)}"
            cut = draw.randrange(1 + size // 6)
            rows.append((len(rows) * 7 % 1009, " ".join(base[cut:])))
    rows += [(2000 + k, " ".join(f"u{draw.randrange(50)}" for _ in range(draw.randrange(12)))) for k in range(60)]
    return rows


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    near = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 300)), dtype=np.uint64))
        keep = rng.permutation(a)[int(rng.integers(0, len(a) // 5 + 1)):]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(rng.integers(0, len(a) // 4 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 9 * common >= 4 * (len(a) + len(b)):
            near += 1
            for seed in range(ngram_join.LEVELS):
                assert len(np.intersect1d(ngram_join.signatures(a, seed), ngram_join.signatures(b, seed)))
            for cells in (ngram_join.COARSE, ngram_join.FINE):
                x, y = ngram_join._folded([ngram_join.sketch(a, cells), ngram_join.sketch(b, cells)], np.zeros(2, np.int64))
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * common
    assert near > 800
    for n in (0, 1, 4, 5, 77, 1000):
        assert ngram_join.signature_count(n) == len(ngram_join.signatures(np.arange(n, dtype=np.uint64)))


def test_blocks_of_all_sizes_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in rng.integers(5, 120, 12)]
    sets = [np.unique(np.concatenate([base[k % 12][: max(3, len(base[k % 12]) - k % 7)], rng.integers(0, 1 << 64, k % 4, dtype=np.uint64)])) for k in range(300)]
    block = np.sort(rng.choice(9, 300, p=[.4, .2, .1, .1, .1, .04, .03, .02, .01]))
    table = pa.table({"sig": block, "u": np.where(block % 2, 0, 1).astype(np.int32), "v": np.ones(300, np.int32), "own": rng.integers(0, 2, 300).astype(np.int32),
                      "key": np.arange(300), "root": rng.integers(0, 40, 300), "n": np.array([len(s) for s in sets]), "sketch": pa.array([ngram_join.sketch(s) for s in sets], pa.binary())})
    want = set()
    r = table.to_pylist()
    for i in range(300):
        for j in range(i + 1, 300):
            x, y = r[i], r[j]
            if x["sig"] != y["sig"] or x["root"] == y["root"] or (x["u"] != x["v"] and x["own"] == y["own"]) or 5 * min(x["n"], y["n"]) < 4 * max(x["n"], y["n"]):
                continue
            # The sketches are folded to the shortest of their block, which can only lower the number of differing bits.
            w = min(len(z["sketch"]) for z in r if z["sig"] == x["sig"]) // 8
            a, b = (np.bitwise_xor.reduce(np.frombuffer(z["sketch"], np.uint64).reshape(-1, w), axis=0) for z in (x, y))
            if 9 * int(np.bitwise_count(a ^ b).sum()) <= x["n"] + y["n"]:
                want.add((i, j))
    assert len(want) > 100
    for small, chunk in ((48, 20_000), (2, 40), (1000, 7)):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        got = [p for batch in ngram_join._allowed(iter(table.to_batches(max_chunksize=13))) for p in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want
        partner = {k for batch in ngram_join._with_partner(iter(table.to_batches(max_chunksize=13))) for k in batch["key"].to_pylist()}
        assert partner == {k for p in want for k in p}
        near = {(min(p), max(p)) for batch in ngram_join._closest(iter(table.to_batches(max_chunksize=13))) for p in zip(batch["key"].to_pylist(), batch["other"].to_pylist())}
        assert near <= want and {k for p in near for k in p} == partner
        for k in partner:
            apart = {}
            for p in want:
                if k in p:
                    x, y = (r[z] for z in p)
                    other = r[p[0] if p[1] == k else p[1]]
                    w = min(len(z["sketch"]) for z in r if z["sig"] == x["sig"]) // 8
                    a, b = (np.bitwise_xor.reduce(np.frombuffer(z["sketch"], np.uint64).reshape(-1, w), axis=0) for z in (x, y))
                    apart[p] = (int(np.bitwise_count(a ^ b).sum()), other["root"])
            first = min(d for d, _ in apart.values())
            assert any(apart[p][0] == first for p in near if k in p)
            assert len({root for p, (_, root) in apart.items() if p in near}) >= min(ngram_join.WAYS, len({root for _, root in apart.values()}))


def test_sets_like_python_sets():
    texts = ["a B c d e f", "A b C d e f a b c d e", "one two", "one two three four", "", None, " \t", "x\x1cy z\x0bw", "Ä ä b c d"]
    got = ngram_join.shingle_sets(pa.array(texts))
    assert [len(f) for f in got] == [len(shingles(t)) for t in texts]
    hashes = {}
    for t in (*texts, "two", "one", "two one"):
        for s, f in ((s, f) for s in [shingles(t)] if len(s) == 1 for f in ngram_join.shingle_sets(pa.array([t]))):
            hashes.setdefault(int(f[0]), s)
            assert hashes[int(f[0])] == s


@pytest.mark.parametrize("options", [{}, {"crowd": 3, "most": 40}])
def test_components_like_comparing_all_pairs(spark, copies, options):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(5)
    want = brute(copies)
    assert len({c for _, _, c in want}) < len(want)
    assert found(docs, **options) == want


def test_odd_rows_and_clashing_names(odd_docs, no_docs):
    docs = odd_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found(no_docs) == []


def test_spread_rows_of_common_keys(spark):
    many = write_through(spark.range(3000).select((F.col("id") % 3 * F.col("id") % 7).alias("key"), "id"))
    one = spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = ngram_join.spread(many, one, "key", how, share=50)
        plain = many.join(one, "key", how)
        assert got.columns == plain.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_query_matches_oracle_on_odd_rows(spark, folder):
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    want = {r[0]: r for r in con.execute(ngram_join.ORACLE_SQL).fetchall()}
    rows = ngram_join.op11_ngram_join(spark, folder).filter("doc_id is not null").collect()
    assert {r["doc_id"]: tuple(r) for r in rows} == want


def placed(spark, step):
    """(_rid, _t) of some texts, their rows `step` apart in three files, one partition."""
    draw = random.Random(6)
    rows = [((k % 3, k * step), " ".join(f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 200)))) for k in range(120)]
    rows.sort()
    return rows, spark.createDataFrame(rows, "_rid struct<f: bigint, i: bigint>, _t string").coalesce(1)


@pytest.mark.parametrize("files, step", [(1, 1), (1, 1 << 12), (3, 1)])
def test_packed_signatures_name_their_texts(spark, files, step):
    rows, texts = placed(spark, step)
    rows, texts = [r for r in rows if r[0][0] < files], texts.filter(F.col("_rid.f") < files)
    want = set()
    for (f, i), t in rows:
        rid = pa.array([{"f": f, "i": i}], pa.struct([("f", pa.int64()), ("i", pa.int64())]))
        key = int(ngram_join.marks(*ngram_join.places(rid))[0])
        for s in ngram_join.signatures(ngram_join.shingle_sets(pa.array([t]))[0]).tolist():
            want.add(((s >> 32) * 5000 >> 32, s & 0xFFFFFFFF, key))
    got = set()
    for r in ngram_join.packed_signatures(texts, 5000).collect():
        sig, key = ngram_join._unpacked(r["bucket"], [(r["start"], bytes(r["sigs"]), bytes(r["keys"]), bytes(r["owners"]))])
        got |= {(s >> 32, s & 0xFFFFFFFF, k) for s, k in zip(sig.tolist(), key.tolist())}
    assert got == want and len({k for _, _, k in want}) == len(rows)


def test_a_signature_is_six_bytes_however_many_buckets(spark):
    _, texts = placed(spark, 1)
    texts = texts.filter("_rid.f = 0")
    for buckets in (1, 100, 10_000):
        size = ngram_join.packed_signatures(texts, buckets).agg(F.sum(F.length("sigs")), F.sum(F.length("keys") + F.length("owners"))).first()
        assert size[0] > 10_000 and 2 * size[1] == size[0]


def test_texts_stay_where_they_are(spark, monkeypatch, tmp_path):
    spark.range(6400).selectExpr("id AS doc_id", "concat('word ', id, ' of this text') AS text").repartition(2).write.parquet(f"{tmp_path}/d")
    monkeypatch.setattr("verdictlake.llm.rows.BROADCAST_BYTES", 6400 * 2)
    run = ngram_join.Join(ngram_join.identified(spark.read.parquet(f"{tmp_path}/d")), "doc_id", "text")
    for keys, n in ((None, 6400), (run.firsts.filter("pmod(key, 3) = 0").select("key"), run.firsts.filter("pmod(key, 3) = 0").count())):
        texts = run.texts(keys)
        plan = texts._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert "Exchange" not in plan
        assert texts.count() == texts.distinct().count() == n > 2000
    kept = run.texts(run.firsts.filter("pmod(key, 3) = 0").select("key")).select("_rid")
    assert kept.exceptAll(run.firsts.filter("pmod(key, 3) = 0").select("first.rid")).isEmpty()


def test_pairs_bring_their_sets_together():
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for k in range(300):
        x = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 60)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[: len(x) - int(rng.integers(0, 1 + len(x) // 5))], rng.integers(0, 1 << 64, int(rng.integers(0, 2 + len(x) // 6)), dtype=np.uint64)]))
        rows += [(k // 7, k, x.tobytes()), (k // 7, k, y.tobytes())]
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            want.add((k // 7, k))
    assert 50 < len(want) < 250
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["a", "b", "found"])
    for size in (1, 5, 1000):
        got = [p for batch in ngram_join._alike(iter(table.to_batches(max_chunksize=size))) for p in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_leaders_of_many_pairs_are_spread(spark, copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARE", 3)
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(5)
    assert found(docs) == brute(copies)


def test_shuffles_go_with_their_step(spark, copies, monkeypatch):
    folders = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    left = []

    def written(df):
        before = shuffled()
        out = write_through(df)
        left.append(shuffled() - before)
        for _ in range(50):
            if not left[-1]:
                break
            time.sleep(0.1)
            left[-1] = shuffled() - before
        return out

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    monkeypatch.setattr(ngram_join, "write_through", written)
    monkeypatch.setattr("verdictlake.llm.components.write_through", written)
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(5)
    assert found(docs) == brute(copies)
    assert len(left) > 10 and not any(left)
    assert spark.conf.get(key) == setting
