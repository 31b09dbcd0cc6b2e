"""Text operators against brute force on ordinary and odd rows."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from verdictlake.llm import exact_dedup, lm_scoring, mixing, near_copies, packing, recurrent, simhash, substring_dedup, toxicity
from verdictlake.llm.components import components
from verdictlake.llm.rows import identified, split_words, table

LATE = 1 << 60


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower()


def rows_of(spark, folder):
    return [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


def test_split_words_like_bytes_split():
    texts = [" a  b\x0b\x0cc\x1cd e ", "", None, "A\tÄ\r\nb", "\n"]
    index, forms, offsets = split_words(pa.array(texts), lower=True)
    got = [[forms[int(i)].as_py().encode() for i in index[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [lower(t).split() for t in texts]
    sliced = pa.array(["x y", *texts])[1:]
    assert list(np.diff(split_words(sliced)[2])) == [len(words(t)) for t in texts]


def test_exact_dedup(spark, folder):
    got = exact_dedup.op10_exact_dedup(spark, folder).collect()
    docs = rows_of(spark, folder)
    groups = {}
    for d, t in docs:
        groups.setdefault(lower(t), []).append(d)
    want = Counter()
    for d, t in docs:
        ids = groups[lower(t)]
        want[(d, max((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(lower(t)).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_keeps_columns_and_one_row(odd_docs, no_docs):
    out = exact_dedup.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 3, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.deduplicate(no_docs).count() == 0


def fingerprint(text):
    w = lower(text).split()
    if not w:
        return 0
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in ([b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)])]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, near):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if near(prints[a], prints[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


@pytest.mark.parametrize("hot", [1000, 1])
def test_simhash(spark, folder, hot):
    docs = rows_of(spark, folder)
    prints = [fingerprint(t) for _, t in docs]
    root = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r, (d, _) in zip(root, docs):
        first[r] = min(first.get(r, LATE), LATE if d is None else d)
    want = Counter((d, f"{p:016x}", None if first[r] == LATE else first[r]) for (d, _), p, r in zip(docs, prints, root))
    marked, heads = simhash.near_groups(identified(table(spark, folder, "documents")), hot=hot)
    got = marked.join(heads, "fp").select("_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "head.id").collect()
    assert Counter(tuple(r) for r in got) == want


def test_simhash_finds_all_links_of_random_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {int(p) for p in base}
    for p in base:
        for _ in range(8):
            prints.add(int(p) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    prints = sorted(prints)
    root = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    table_ = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    for hot in (1000, 3):
        got = {r["fp"] % (1 << 64): r["root"] for r in simhash.groups(table_, hot=hot).collect()}
        seen = {}
        for p, r in zip(prints, root):
            if root.count(r) > 1:
                assert seen.setdefault(r, got[p]) == got[p]
            else:
                assert p not in got
        assert len(set(seen.values())) == len(seen)


def test_simhash_finds_three_bits_in_the_last_cut(spark):
    """All three-bit patterns over the last 27 bits, and over all 64 those whose every path ends in the part of 6."""
    def sides(bits, rest, widths):
        """Remaining bits of each part that agrees: places counted from the top, the part itself taken out."""
        begin = 0
        for width in widths:
            if not any(begin <= b < begin + width for b in bits):
                yield tuple(b if b < begin else b - width for b in bits)
            begin += width

    def only_short(bits):
        left = [tuple((b - 16 * k) % 64 - 16 for b in bits) for k in range(4) if not any((b - 16 * k) % 64 < 16 for b in bits)]
        for rest, widths in simhash.LEVELS[:2]:
            left = [x for bits in left for x in sides(bits, rest, widths)]
        return all(sorted(b // 7 for b in x) == [0, 1, 2] and 0 in x for x in left)

    patterns = [*itertools.combinations(range(37, 64), 3), *filter(only_short, itertools.combinations(range(64), 3))]
    assert len(patterns) > 2925
    rng = np.random.default_rng(8)
    pairs = [(int(p), int(p) ^ sum(1 << 63 - b for b in bits)) for p, bits in zip(rng.integers(0, 1 << 63, len(patterns), dtype=np.uint64), patterns)]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table_ = spark.createDataFrame([(signed(p),) for pair in pairs for p in pair], "fp bigint").distinct()
    root = {r["fp"]: r["root"] for r in simhash.groups(table_, hot=1).collect()}
    assert [b for (p, q), b in zip(pairs, patterns) if root.get(signed(p), p) != root.get(signed(q), q)] == []


def test_simhash_keeps_first(odd_docs, no_docs):
    out = simhash.keep_one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 4, 7, 8, 9, 10]
    assert simhash.keep_one_of_each(no_docs).count() == 0


def five_word_sets(docs):
    cut = lambda w: {b" ".join(w[k:k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set())
    return [cut(lower(t).split()) for _, t in docs]


def kept_of_near_copies(docs):
    """Ids that stay of (id, text) rows, ids being distinct, by comparing all pairs."""
    sets = five_word_sets(docs)
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) if a or b else True
    root = brute_components(sets, near)
    first = {}
    for r, (d, _) in zip(root, docs):
        first[r] = min(first.get(r, LATE), d)
    return sorted(first.values())


def test_near_copies(spark, folder):
    """Copies of similarity 0.6 to 1, one large group among them, beside the small table."""
    rng = np.random.default_rng(6)
    docs = [(d, t) for d, t in dict(rows_of(spark, folder)).items() if d is not None]
    for k in range(60):
        base = [f"v{x}" for x in rng.integers(0, 5000, rng.integers(6, 200))]
        docs.append((20_000 + 10 * k, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            for at in rng.integers(0, len(base), rng.integers(1, 2 + len(base) // 60)):
                copy[at] = f"new{k}x{j}"
            docs.append((20_000 + 10 * k + j, " ".join(copy)))
    base = [f"g{k}" for k in range(120)]
    docs += [(30_000 + k, " ".join(base[:k % 100] + [f"only{k}"] + base[k % 100 + 1:])) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    out = near_copies.keep_one_of_each(frame)
    want = kept_of_near_copies(docs)
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert len(want) < simhash.keep_one_of_each(frame).count()


def test_near_copies_keep_first(odd_docs, no_docs):
    out = near_copies.keep_one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 4, 7, 8, 9, 10]
    assert near_copies.keep_one_of_each(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    assert components(edges.filter("a < 0")).count() == 0


def brute_repeats(docs, span=20):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    first, out = {}, {}
    for n, k in enumerate(order):
        w = words(docs[k][1])
        for s in range(len(w) - span + 1):
            first.setdefault(tuple(w[s:s + span]), (n, s))
    for n, k in enumerate(order):
        w = words(docs[k][1])
        gone = {s + j for s in range(len(w) - span + 1) if first[tuple(w[s:s + span])] < (n, s) for j in range(span)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[k] = (docs[k][0], len(w), len(gone), left.decode())
    return Counter(out.values())


@pytest.mark.parametrize("hot", [500, 1])
def test_substring_dedup(spark, folder, hot):
    docs = rows_of(spark, folder)
    got = substring_dedup.remove_repeats(identified(table(spark, folder, "documents")), hot=hot).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(docs)


def test_substring_dedup_periodic_and_empty(spark, no_docs):
    cycle = " ".join(["a b c"] * 30)
    docs = [(1, "a " * 50), (2, cycle), (3, "z " + cycle + " y"), (4, " ".join(f"u{k}" for k in range(19))), (5, " ".join(f"u{k}" for k in range(20)) + " a a")]
    got = substring_dedup.remove_repeats(identified(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(docs)
    assert substring_dedup.remove_repeats(identified(no_docs)).count() == 0


def test_suffix_automaton_against_search():
    rng = np.random.default_rng(1)
    texts = [list(rng.integers(0, 3, 30)) for _ in range(6)]
    machine, runs = substring_dedup.SuffixAutomaton(), set()
    for n, text in enumerate(texts):
        found = {k for k, _ in machine.matches(text, 4)}
        assert found == {k for k in range(3, len(text)) if tuple(text[k - 3:k + 1]) in runs}
        machine.add(text, n)
        runs |= {tuple(text[k - 3:k + 1]) for k in range(3, len(text))}


def test_mixing_bounds(spark, odd_docs, no_docs):
    rows = mixing.mix(identified(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(identified(no_docs)).count() == 0
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r["copies"] for r in rows)
    again = mixing.mix(identified(odd_docs)).collect()
    pick = lambda rs: Counter((r["doc_id"], r["size"], r["copies"]) for r in rs)
    assert pick(again) == pick(rows)


def test_mixing_comes_near_targets(spark, folder):
    rows = mixing.mix(identified(table(spark, folder, "documents"))).select("*").collect()
    by = {}
    sources = {(r["source_size"], r["target"]) for r in rows}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append((r["copies"] * r["size"], r["size"]))
    for key in sources:
        taken, sizes = zip(*by[key])
        assert abs(sum(taken) - key[1]) <= max(sizes) + 1
        assert key[1] <= 2 * key[0]


def test_packing_round_trip(spark, folder):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary())
    docs = rows_of(spark, folder)
    whole = Counter()
    for d, t in docs:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        whole.update((d, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    got = packing.op2_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == whole
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_ids_and_empty(odd_docs, no_docs):
    cut = packing.pieces(odd_docs, packing.vocabulary(), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in cut)
    assert packing.packed_documents(no_docs).count() == 0


def test_closest_fill_is_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = {int(v): int(rng.integers(1, 4)) for v in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 80))
        sums = {0}
        for v, n in counts.items():
            sums = {s + v * k for s in sums for k in range(n + 1) if s + v * k <= room}
        used = packing.closest_fill(counts, room)
        assert sum(v * k for v, k in used.items()) == max(sums) and all(k <= counts[v] for v, k in used.items())


def test_patterns_use_everything():
    counts = {2048: 3, 2047: 5, 1000: 7, 300: 11, 1: 4}
    used = Counter()
    for times, fill in packing.patterns(counts):
        assert sum(v * n for v, n in fill.items()) <= 2048
        for v, n in fill.items():
            used[v] += n * times
    assert used == Counter(counts)


def test_toxicity_learns_and_keeps_clean(spark):
    rng = np.random.default_rng(4)
    clean = ["".join(rng.choice(list("aeionrst"), 6)) for _ in range(400)]
    text = lambda bad: " ".join("vilespeak" if bad and k % 9 == 4 else str(rng.choice(clean)) for k in range(60))
    docs = [(k, text(k % 3 == 0)) for k in range(300)]
    frame = spark.createDataFrame([*docs, (400, None), (401, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(300)) and got[400] == got[401] < 0.5


def test_toxicity_learns_a_stem_with_rare_endings(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("aeionrstäö"), n))
    clean = [word(6) for _ in range(400)]
    text = lambda bad: " ".join(f"vilespeak{word(4)}" if bad and k % 9 == 4 else str(rng.choice(clean)) for k in range(60))
    frame = spark.createDataFrame([(k, text(k % 3 == 0)) for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(300))


def test_toxicity_odd_rows(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = toxicity.drop_toxic(odd_docs, none)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert toxicity.drop_toxic(no_docs, none).count() == 0


def test_recurrent_gradients():
    head = recurrent.make_head([("a", 5), ("b", 4), ("c", 3), ("d", 2)], 3, 2, 2)
    net = recurrent.Network(head, 3)
    net.w = {n: w.astype(np.float64) for n, w in net.w.items()}
    docs = [np.array([1, 2, 5, 0], np.int32), np.array([3, 4, 0], np.int32)]
    lanes = recurrent.lay_out(docs, 1)

    def loss():
        return -sum(s.sum() for s in net.score(docs, width=1))

    trace, grads = [], {}
    _, states = net._steps(np.zeros((1, 3)), lanes.x, lanes.first, trace)
    used = lanes.document >= 0
    _, dh = net._out(states[used], lanes.y[used], grads)
    full = np.zeros_like(states)
    full[used] = dh
    net._back(full, lanes.x, lanes.first, trace, grads)
    rows, g = grads["gates"]
    for name, at, found in [("turn", (1, 4), grads["turn"][1, 4]), ("out", (0, 1), grads["out"][0, 1]), ("word", (2, 1), grads["word"][2, 1]),
                            ("gates", (int(rows[0]), 2), g[0, 2])]:
        keep, step = net.w[name][at], 1e-5
        net.w[name][at] = keep + step
        up = loss()
        net.w[name][at] = keep - step
        down = loss()
        net.w[name][at] = keep
        assert abs((up - down) / (2 * step) - found) < 1e-3 * max(1, abs(found))


def test_recurrent_scores_do_not_depend_on_lanes():
    rng = np.random.default_rng(2)
    net = recurrent.Network(recurrent.make_head([(f"w{k}", 90 - k) for k in range(40)], 9, 4, 5), 6)
    docs = [np.append(rng.integers(1, 45, n), 0).astype(np.int32) for n in (0, 700, 3, 40, 64, 1, 130, 0)]
    alone = [net.score([d], width=1)[0] for d in docs]
    for width, window in [(1, 64), (3, 7), (8, 64), (50, 1)]:
        for a, b in zip(alone, net.score(docs, width, window)):
            np.testing.assert_allclose(a, b, atol=1e-4)
    net.w = {n: w * np.float32(200) for n, w in net.w.items()}  # logits that need the shift
    assert net._largest() > 80 and all(np.isfinite(s).all() for s in net.score(docs))


def test_lm_scoring(spark, folder):
    got = lm_scoring.op3_lm_scoring(spark, folder).collect()
    docs = rows_of(spark, folder)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    counts, ends = Counter(), 0
    for d, t in docs:
        if not held(d):
            counts.update(lower(t).split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for d, t in docs:
        w = lower(t).split()
        want[(d, held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(float(sum(base(counts[x]) for x in w) + base(ends)), 3))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_lm_beats_counts_on_held_out_text(spark):
    got = lm_scoring.op3_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_without_training_rows(no_docs, spark):
    model, counts = lm_scoring.fit(no_docs)
    one = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    row = lm_scoring.score(identified(one), model, counts).first()
    assert row["n_tokens"] == 3 and row["n_known"] == 0
    assert lm_scoring.score(identified(no_docs), model, counts).count() == 0


def test_forms_with_stops_are_put_together_at_once(monkeypatch):
    """Ids are the tokenizer's own, and no form with trailing stops is looked up and copied by itself."""
    coder, single = packing.WordIds(packing.vocabulary()), []
    ids_of = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda slot: single.append(slot) or ids_of(slot))
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    texts = [" ".join(w + ("", ".", ",", "?!", "...")[k % 5] for k, w in enumerate(words)), "worda, worda. , ... ?! x. 7. a7, É, né;", None, " ".join(words)]
    for _ in range(2):
        ids, starts = coder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[starts[k]:starts[k + 1]].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert not single
