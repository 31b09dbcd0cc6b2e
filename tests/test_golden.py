"""Hand-written cases for labels, parsing, text, URLs, files, figures and streams."""

import math

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.functions import parse as R
from verdictlake.functions import urls as U
from verdictlake.operators import agreement as A
from verdictlake.operators import hooks as O
from verdictlake.operators import metrics as M
from verdictlake.operators import resume
from verdictlake.operators import text as X
from verdictlake.operators import web as W
from verdictlake.sources import files
from verdictlake.streaming import jobs as J


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x STRING").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,label", [
    ("Yes. Found", "yes"), ("  no match", "no"), ("N/A", "na"), ("It could not be opened", "na"), ("Unknown", "no"),
    ("Partly, yes", "yes"), ("", "unknown"), (None, "unknown"), ("Partial", "unknown"), ("x" * 50 + " no", "unknown")])
def test_grounding_labels(spark, text, label):
    assert one(spark, text, L.parse_grounding) == label


def test_verdict_flags_only_count_when_unknown(spark):
    rows = [("No", True), ("Unknown", True), ("", True), ("Skipped", True), (None, True), ("TRUE", False)]
    df = spark.createDataFrame(rows, "h STRING, f BOOLEAN")
    got = [r[0] for r in df.select(L.resolve_verdict("h", F.col("f"), F.lit(False), F.lit(None))).collect()]
    assert got == [False, True, True, False, True, True]


@pytest.mark.parametrize("ref,content,label", [
    ("no", "yes", "yes"), ("yes", "no", "yes"), ("yes", "yes", "no"), ("yes", "", "unknown"), ("", "yes", "no"),
    ("na", "yes", "no"), ("", "", "unknown")])
def test_human_label(spark, ref, content, label):
    df = spark.createDataFrame([(ref, content)], "r STRING, c STRING")
    assert df.select(L.human_hallucination("r", "c")).first()[0] == label


@pytest.mark.parametrize("raw,fixed", [
    (r'{"c": "Represent \(t\) as"}', r'{"c": "Represent \\(t\\) as"}'), (r'{"c": "ok \n"}', r'{"c": "ok \n"}'),
    (r'{"c": "a \\( b"}', r'{"c": "a \\( b"}'), (r'{"c": "\\\d"}', r'{"c": "\\\\d"}')])
def test_escape_repair(spark, raw, fixed):
    assert one(spark, raw, R.repair_escapes) == fixed


@pytest.mark.parametrize("raw,body", [
    ('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('```\n[1]\n```', "[1]"),
    ("```json {}", "{}"), ("``` a ```json {} ```", "{}")])
def test_unfence(spark, raw, body):
    assert one(spark, raw, R.unfence) == body


def test_turn_verdict_fallbacks(spark):
    rows = [("a", '```json\n{"has_hallucination": true, "hallucinated_imports": [{"package": "p"}]}\n```'),
            ("b", 'so {"has_hallucination": true, "reasoning": "r"} and {x}'),
            ("c", 'say {"has_hallucination": true, "hallucinated_installs": [{"package": "q"}]} end'), ("d", "nothing")]
    out = {r.id: r for r in R.parse_turn_verdicts(spark.createDataFrame(rows, "id STRING, response STRING")).collect()}
    assert out["a"].hallucinated_imports[0].package == "p" and out["a"].hallucinated_import_detected
    assert out["b"].reasoning == "r" and out["b"].has_hallucination
    assert out["c"].hallucinated_installs[0].package == "q"
    assert out["d"].reasoning == "Failed to parse response: nothing" and not out["d"].has_hallucination


def test_blocks_cut_at_sentences_and_always_advance():
    text = "A first one. " + "b" * 30 + ". Next part? " + "c" * 40
    blocks = X.cut_blocks(text, 40, 5)
    assert blocks[0].endswith(".") and "".join(blocks).count("c") >= 40
    assert X.cut_blocks("", 10, 1) == [] and X.cut_blocks("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    # Overlap above a tenth of the block with a break right at its start.
    assert X.cut_blocks("aaaa. " * 50, 20, 15)[-1].endswith("aaaa.")


@pytest.mark.parametrize("url,clean", [
    ("HTTP://Ex.org/a?utm_source=x&b=1&UTM_Medium=2#top", "http://Ex.org/a?b=1"), ("https://e.org/p#x", "https://e.org/p"),
    ("https://e.org/?a=&b&ref=1", "https://e.org/?a=&b="), ("https://e.org/?a=1&b=2&a=3", "https://e.org/?a=1&a=3&b=2"),
    ("https://e.org/?q=a%20b+c*~", "https://e.org/?q=a+b+c%2A~"), ("https://e.org/?ref=1", "https://e.org/")])
def test_canonical_url(spark, url, clean):
    assert one(spark, url, U.canonical_url) == clean


@pytest.mark.parametrize("href,full", [
    ("/x.pdf", "https://e.org/x.pdf"), ("y.pdf", "https://e.org/d/y.pdf"), ("//h.org/z", "https://h.org/z"),
    ("http://q.org", "http://q.org"), ("?a=1", "https://e.org/d/p?a=1")])
def test_resolve_links(spark, href, full):
    assert one(spark, href, lambda c: U.resolve(c, F.lit("https://e.org/d/p?k=v#f"))) == full


def test_pdf_links_are_distinct_and_in_order(spark):
    html = '<a href="/b.PDF">1</a><a class="x" href="a.html">2</a><a href="/pdf/1">3</a><a href="/b.PDF">4</a>'
    pages = spark.createDataFrame([(1, "https://e.org/d/", html)], "page_id BIGINT, url STRING, html STRING")
    got = [r.link for r in W.extract_links(pages).orderBy("pos").collect()]
    assert got == ["https://e.org/b.PDF", "https://e.org/pdf/1"]


def test_valid_prefix_stops_at_first_broken_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n{"k": \n{"k": 4}\n')
    (tmp_path / "b.jsonl").write_text('{"k": 10}\n{"k": 11}\n')
    got = sorted(r.k for r in files.read_valid_prefix(spark, str(tmp_path), "k BIGINT").collect())
    assert got == [1, 2, 10, 11]


def test_inventory_and_snapshot(spark, tmp_path):
    import os

    for name, n, at in (("conversations_m_1convs.jsonl", 1, 100), ("conversations_m_3convs.jsonl", 3, 200)):
        p = tmp_path / name
        p.write_text("".join('{"conversation_id": %d}\n\n' % k for k in range(n)))
        os.utime(p, (at, at))
    seen = files.file_inventory(spark, str(tmp_path)).collect()
    assert [(r.name, r.entries) for r in seen] == [("conversations_m_3convs.jsonl", 3), ("conversations_m_1convs.jsonl", 1)]
    newest = files.latest_snapshot(spark, str(tmp_path) + "/conversations_m_*convs.jsonl")
    assert newest.count() == 3
    items = spark.range(5).withColumnRenamed("id", "pos")
    assert [r.pos for r in files.skip_covered(items, newest, "pos").orderBy("pos").collect()] == [3, 4]


def test_metadata_must_match_conversations(spark):
    convs = spark.createDataFrame([(1,), (2,)], "conversation_id BIGINT")
    with pytest.raises(ValueError):
        files.attach_metadata(convs, spark.createDataFrame([(1, "a")], "conversation_id BIGINT, m STRING"))
    both = spark.createDataFrame([(1, "a"), (2, "b")], "conversation_id BIGINT, m STRING")
    assert files.attach_metadata(convs, both).count() == 2


def test_annotation_log_last_row_wins(spark):
    rows = [(1, 0, 1, ["x"]), (1, 0, 2, []), (1, 2, 1, ["a"]), (1, 2, 3, ["b"])]
    log = spark.createDataFrame(rows, "conv_idx BIGINT, turn_number BIGINT, seq BIGINT, extracted_claims ARRAY<STRING>")
    got = files.latest_annotations(log).collect()
    assert [(r.turn_number, r.extracted_claims) for r in got] == [(2, ["b"])]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a STRING, b STRING")


def test_kappa_edges(spark):
    same = A.agreement(pairs(spark, [("yes", "yes")] * 3), "a", "b").first()
    assert math.isnan(same.cohen_kappa) and same.band is None and same.agreement == 1.0
    few = A.agreement(pairs(spark, [("yes", "no"), ("na", "no")]), "a", "b").first()
    assert few.error and few.cohen_kappa is None and few.n_excluded == 1
    mixed = [("yes", "yes"), ("no", "no"), ("yes", "no"), ("no", "no")]
    k1 = A.agreement(pairs(spark, mixed), "a", "b").first().cohen_kappa
    k2 = A.agreement(pairs(spark, mixed), "b", "a").first().cohen_kappa
    assert k1 == pytest.approx(0.5) and k1 == k2
    self_k = A.agreement(pairs(spark, [("yes", "yes"), ("no", "no")]), "a", "b").first().cohen_kappa
    assert self_k == pytest.approx(1.0)


def test_metrics_without_valid_rows(spark):
    row = A.classification_metrics(pairs(spark, [("na", "yes")]), "a", "b").first()
    assert row.error and row.f1 == 0.0 and row.n_excluded == 1


def test_totals_equal_sum_of_turns(spark):
    from verdictlake.plans.fixtures import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    total = M.grounding_totals(i.judgments()).first()
    turns = M.grounding_by_turn(i.judgments()).agg(F.sum("total_facts"), F.sum("hallucinated_facts")).first()
    assert (total.valid_facts, total.hallucinated_facts) == tuple(turns)


def test_resume_is_idempotent(spark):
    from verdictlake.operators.setops import merge_results
    from verdictlake.plans.fixtures import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    convs = i.table("conversations").select("conv_id").distinct()
    once = sorted(map(tuple, merge_results(convs, i.judged(), i.judgments()).collect()))
    twice = sorted(map(tuple, merge_results(convs, i.judgments(), i.judgments()).collect()))
    assert once == twice
    assert resume.unjudged(i.claims(), i.judgments()).count() == 0


def test_model_hook_keeps_failures_as_rows(spark):
    def model(calls):
        if any("bad" in m[1]["content"] for m in calls):
            raise RuntimeError("no answer")
        return [("ok", {"total_tokens": 2})] * len(calls)

    df = spark.createDataFrame([("a", "fine"), ("b", "bad")], "claim_id STRING, prompt STRING").coalesce(1)
    out = {r.claim_id: r for r in O.infer(O.build_messages(df, "s"), model, batch_size=1).collect()}
    assert out["a"].response == "ok" and out["a"].token_usage["total_tokens"] == 2
    assert out["b"].response is None and "no answer" in out["b"].error


def test_flat_map_may_drop_and_multiply(spark):
    def worker(pdf):
        return pdf.loc[pdf.index.repeat(pdf["n"])][["n"]]

    df = spark.createDataFrame([(0,), (1,), (3,)], "n BIGINT")
    assert sorted(r.n for r in O.flat_map(df, worker, "n BIGINT").collect()) == [1, 3, 3, 3]


def test_dead_letters(spark):
    retry, dead = J.split_dead_letters(spark.createDataFrame([(1, 1), (2, 3)], "id BIGINT, attempt BIGINT"))
    assert [r.id for r in retry.collect()] == [1] and [r.id for r in dead.collect()] == [2]
