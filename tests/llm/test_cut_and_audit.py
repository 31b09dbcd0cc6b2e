"""Fill-in-middle and filter audit against brute force on ordinary and odd rows."""

import hashlib
import itertools
import re
from collections import Counter

import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

from verdictlake.llm import fill_in_middle, filter_audit
from verdictlake.llm.rows import table

CLASHING = ("row", "key", "h", "a", "m", "form", "output", "n", "e", "part", "mask", "id", "digest", "first", "good", "toxic", "state", "f", "orders", "_pass")


def clash(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def cut(key, units, text):
    g = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(g[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m = "".join(units[:a]), "".join(units[a:b])
    s = text[len(p) + len(m):]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def texts(spark, odd_docs):
    more = [(100 + k, "".join(chr(c) for c in (97 + k, 0x1F600 + k, 10, 0x301, 0xE9, 60, 80)) * (k * 97 % 700), "en", "a", 1, 0.1) for k in range(60)]
    marked = [(900, "a <P> b", "en", "a", 1, 0.1), (901, "<S>", "en", "a", 1, 0.1), (902, "x<M", "en", "a", 1, 0.1), (903, "$1 \\ $2 <", "en", "a", 1, 0.1)]
    return clash(odd_docs.unionByName(spark.createDataFrame(more + marked, odd_docs.schema)))


def units_of(text, words):
    if not words:
        return list(text)
    found, at = [], 0
    while (m := re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+").match(text, at)):
        found.append(m[0])
        at = m.end()
    return found


@pytest.mark.parametrize("words", [False, True])
def test_cuts_like_slices(texts, words):
    options = {"unit": r"\s*+\S++"} if words else {}
    made = fill_in_middle.transform(texts, **options).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter()
    for r in texts.collect():
        text = r["text"] or ""
        want[(r["doc_id"], *cut(r["doc_id"], units_of(text, words), text))] += 1
    assert Counter((r["row"]["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in made) == want
    assert all(r["back"] == (r["row"]["text"] or "") for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert all(r["row"]["key"] == CLASHING.index("key") for r in made)


def test_long_text_is_cut_without_a_deep_stack(spark):
    docs = spark.createDataFrame([(k, "aé😀 \n" * 600_000) for k in range(6)], "doc_id bigint, text string")
    made = fill_in_middle.transform(docs).select("n", "form", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back"), "row")
    rows = made.select("n", "form", (F.col("back") == F.col("row.text")).alias("same")).collect()
    assert all(r["n"] == 3_000_000 and r["same"] for r in rows) and any(r["form"] != "plain" for r in rows)


def test_empty_tables(spark, no_docs):
    assert fill_in_middle.transform(no_docs).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_counts(no_docs, labels), "ABCDE").count() == 0


def test_path_counts():
    reach, leave = filter_audit.path_counts(4)
    assert reach[0] == leave[15] == 1 and reach[15] == leave[0] == 24
    for s in range(16):
        through = sum(1 for o in itertools.permutations(range(4)) if any(sum(1 << f for f in o[:k]) == s for k in range(5)))
        assert reach[s] * leave[s] == through


def audited(docs, labels, conditions, names):
    """Every order walked one document at a time."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    out = {}
    for part in {r["lang"] or "" for r in docs}:
        rows = [(r, [c(r) for c in conditions]) for r in docs if (r["lang"] or "") == part]
        value = Counter()
        for order in itertools.permutations(range(len(names))):
            left = rows
            for step, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                value[f] += len(gone)
                out[(part, "".join(names[k] for k in order), step + 1)] = [
                    len(left), len(gone), sum(x[1][f] for x in rows) - len(gone), sum(x[1][f] and sum(x[1]) == 1 for x in rows),
                    sum(x[0]["doc_id"] in good for x in gone), sum(x[0]["doc_id"] in toxic for x in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = value[out[key][6]]
    return out


def test_audit_like_walking_every_order(spark, odd_docs):
    more = [(200 + k, f"{'Aa' * (k % 3)} " + " ".join(f"w{j % (7 + 20 * (k % 6))}" for j in range(k * 9)) + "$" * (k % 4 == 0), ("en", "de", None)[k % 3], "a", 1, 0.1)
            for k in range(40)]
    copies = [(k, "the same text", ("en", "de", "fr")[(k or 0) % 3], "b", 1, 0.1) for k in (31, 7, 90, 90, 15, None)]
    docs = clash(odd_docs.unionByName(spark.createDataFrame(more + copies, odd_docs.schema)))
    labels = spark.createDataFrame([(k, k % 2, k % 3) for k in range(1, 240)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)],
                                   "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(3)).withColumn("id", F.lit(3))
    rows = docs.collect()
    smallest = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            smallest[t] = min(smallest.get(t, r["doc_id"]), r["doc_id"])

    def words(r):
        return (r["text"] or "").encode().split()

    conditions = [
        lambda r: len(words(r)) < 100, lambda r: 100 * len(set(words(r))) < 80 * len(words(r)),
        lambda r: 100 * sum("A" <= c <= "Z" for c in r["text"] or "") > 10 * len(r["text"] or ""),
        lambda r: bool(re.search("[#$%&*|]", r["text"] or "")), lambda r: r["doc_id"] is not None and r["doc_id"] > smallest[r["text"] or ""]]
    got = filter_audit.audit(filter_audit.failure_counts(docs, labels), "ABCDE").collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == audited(
            rows, [r for r in labels.collect() if r["doc_id"] is not None], conditions, "ABCDE")
    assert len(got) == 600 * len({r["lang"] or "" for r in rows})


def test_queries_match_oracle_on_odd_rows(spark, folder):
    files = {n: f"{folder}/{n}.parquet/*.parquet" for n in ("documents", "labels")}
    con = duck("/nowhere")
    for n, f in files.items():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{f}'")
    for name, module in (("op12_fill_in_middle", fill_in_middle), ("op13_filter_audit", filter_audit)):
        assert compare(spark, con, folder, name, getattr(module, name), module.ORACLE_SQL) is None
    assert table(spark, folder, "documents").filter("doc_id is null").count()
