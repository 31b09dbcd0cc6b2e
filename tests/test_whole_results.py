"""Cases in which earlier rules lost rows or gave wrong verdicts."""

import csv
import tempfile

from pyspark.sql import functions as F

from verdictlake.functions import urls
from verdictlake.operators import agreement, ranking, resume, setops, stateful, web
from verdictlake.scale import position_in_group
from verdictlake.sources import files


def test_claims_that_share_an_id_in_two_conversations(spark):
    claims = spark.createDataFrame([("a", "x"), ("b", "x")], "conv_id string, claim_id string")
    judged = spark.createDataFrame([("a", "x", 0, 0, "Yes")], "conv_id string, claim_id string, turn int, claim_idx int, hallucination string")
    long = spark.createDataFrame([("a", "12345678aa"), ("b", "12345678bb")], "conv_id string, claim_id string")
    assert [r["conv_id"] for r in resume.unjudged(long, long.filter("conv_id = 'a'")).collect()] == ["b"]
    both = setops.merge_judgments(judged, judged.withColumn("conv_id", F.lit("b")))
    assert sorted(r["conv_id"] for r in both.collect()) == ["a", "b"]
    judge = judged.withColumns({c: F.lit("Yes") for c in ("reference_grounding", "content_grounding", "verification_error")})
    attached = agreement.attach_judges(claims, {"m": judge.withColumn("hallucination", F.lit("Yes"))})
    assert {r["conv_id"]: r["judge_m_hallucination"] for r in attached.collect()} == {"a": "Yes", "b": None}


def test_newest_snapshot_is_read_whole(spark):
    base = tempfile.mkdtemp()
    rows = spark.range(10).select(F.col("id").cast("string").alias("conversation_id"))
    rows.limit(3).write.json(f"{base}/conversations_1")
    rows.repartition(4).write.json(f"{base}/conversations_2")
    assert files.latest_snapshot(spark, f"{base}/conversations_*", "conversation_id string").count() == 10


def test_links_in_any_quoting_and_with_dot_segments(spark):
    html = """<a href="a.pdf">1</a> <A class='k' HREF = 'b/../c.pdf'>2</A> <a href=/x/./d.pdf>3</a> <a data-href="no.pdf">"""
    pages = spark.createDataFrame([(1, "http://h.org/p/q.html", html)], "page_id int, url string, html string")
    got = [r["link"] for r in web.extract_links(pages).orderBy("pos").collect()]
    assert got == ["http://h.org/p/a.pdf", "http://h.org/p/c.pdf", "http://h.org/x/d.pdf"]
    frame = spark.createDataFrame([("../../../e/..", "http://h.org/p/q")], "href string, base string")
    assert frame.select(urls.resolve(F.col("href"), F.col("base"))).first()[0] == "http://h.org/"


def test_blocks_that_only_begin_like_ads_stay(spark):
    html = '<div class="address">Main street</div><div class="admin-note">Note</div><div class="big ad">Buy</div>' + "<p>word</p>" * 60
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    text = web.page_text(pages).first()["content"]
    assert "Main street" in text and "Note" in text and "Buy" not in text


def test_skipped_and_failed_claims_give_no_verdict(spark):
    flags = ["hallucinated_import_detected", "hallucinated_install_detected", "hallucinated_function_usage_detected"]
    flags = list(stateful.FLAGS) or flags
    rows = [("c", 0, 0, "import", "ghost", "import ghost", True, None, False), ("c", 0, 1, "import", "lost", "import lost", False, "timeout", False),
            ("d", 0, 0, "import", "ghost", "import ghost", False, None, True), ("d", 0, 1, "import", "lost", "import lost", False, None, True)]
    frame = spark.createDataFrame(
        rows, "conv_id string, turn int, claim_idx int, element_type string, package_name string, code_snippet string, "
        "skipped_early_stopping boolean, error string, raised boolean")
    frame = frame.withColumns({flags[0]: F.col("raised"), flags[1]: F.lit(False), flags[2]: F.lit(False), "hallucination": F.lit("Yes"),
                               "reference_grounding": F.lit(""), "content_grounding": F.lit(""), "abstention": F.lit(""), "verification_error": F.lit("")})
    got = {(r["conv_id"], r["claim_idx"]): (r["reused"], r["hallucination"]) for r in stateful.reuse_verdicts(frame).collect()}
    assert got[("d", 0)] == (False, "Yes") and got[("d", 1)] == (False, "Yes")


def test_null_keys_are_numbered(spark):
    rows = spark.createDataFrame([(None, 1), (None, 5000), ("a", 2)], "k string, n bigint")
    assert sorted((r["k"] or "", r["p"]) for r in position_in_group(rows, ["k"], "n", "p").collect()) == [("", 1), ("", 2), ("a", 1)]


def test_claims_of_records_in_either_list(spark):
    base = tempfile.mkdtemp()
    lines = [
        '{"_type": "evaluation_result", "conversation_id": 1, "score": 1, "metadata": {"language": "R"}, "details": {"claim_evaluations": '
        '[{"claim_id": "", "hallucination": "No", "verification_error": false, "claim": {"turn_number": 3, "package_name": "p", "code_snippet": "c", "reference_name": "r"}}]}}',
        '{"_type": "evaluation_result", "conversation_id": 2, "score": 1, "details": {"facts": [{"claim_id": "f", "turn_idx": 2, '
        '"reference_name": "own", "claim": {"turn_number": 9, "language": "Go", "reference_name": "r"}}], "claim_evaluations": [{"claim_id": "not this"}]}}',
        '{"_type": "evaluation_result", "conversation_id": 3, "score": 1, "details": {"facts": [], "claim_evaluations": [{"claim_id": "not this"}]}}',
        '{"_type": "evaluation_result", "conversation_id": 4, "score": 1}']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{base}/e")
    rows = files.claims_of_evaluations(files.read_evaluations(spark, f"{base}/e")).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["turn"], r["claim_key"], r["reference_name"], r["language"], r["verification_error"]) for r in rows] == [
        (1, 3, "3|p|c", "r", "R", "false"), (2, 2, "f", "own", "Go", None)]


def test_large_samples_are_cut_without_gathering(spark):
    rows = spark.range(300_000).withColumnRenamed("id", "doc_id")
    picked = ranking.sample_n(rows, 200_000, 7, ["doc_id"])
    first = rows.orderBy(F.md5(F.concat_ws(":", F.lit(7), F.col("doc_id").cast("string"))), "doc_id").limit(200_000)
    assert picked.count() == 200_000 and picked.exceptAll(first).isEmpty()
    assert ranking.sample_n(rows, 0, 7, ["doc_id"]).isEmpty() and ranking.sample_n(rows.limit(5), 9, 7, ["doc_id"]).count() == 5


def test_next_slice_goes_on_after_what_each_language_has(spark):
    prompts = spark.createDataFrame([(k, "a" if k < 7 else None) for k in range(10)], "doc_id long, language string")
    done = prompts.filter("doc_id < 3")
    assert [r["doc_id"] for r in ranking.next_slice(prompts, done, 5, ["doc_id"]).orderBy("doc_id").collect()] == [3, 4, 7, 8, 9]
    assert [r["doc_id"] for r in ranking.next_slice(prompts, done, None, ["doc_id"]).orderBy("doc_id").collect()] == [3, 4, 5, 6, 7, 8, 9]


def test_one_csv_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    parts = ["plain", "two\nlines", 'say "hi", twice', "a,b", "\n\nopen", "windows\r\nbreak", '"', "é\u2003 \n\"\n\"", "x" * 300]
    rows = [(k, parts[k % 9] + str(k), (parts[(k * 7) % 9] + "\n") * (1 if k != 777 else 40_000)) for k in range(6000)]
    with open(tmp_path / "one.csv", "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
        out.writerow(["id", "note", "more\nthan a line"])
        out.writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = files.read_study_csv(spark, str(tmp_path / "one.csv"), "id BIGINT, note STRING, more STRING")
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 10
        assert sorted(tuple(r) for r in got.collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_direct_run_from_answers_to_report(spark, tmp_path):
    from verdictlake.operators import direct

    item = '{"package": "ghost", "function": "f", "code": "x", "reason": "none such"}'
    answers = [
        (1, 1, '```json\n{"has_hallucination": true, "hallucinated_imports": [%s, %s], "hallucinated_installs": [], "hallucinated_function_calls": [], "reasoning": "r"}\n```' % (item, item)),
        (1, 3, "no verdict"), (2, 1, 'I say {"has_hallucination": true, "reasoning": "flat"} so'), (3, 1, None)]
    convs = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4)], "conv_id BIGINT")
    records = direct.run_direct(spark, convs, spark.createDataFrame(answers, "conv_id BIGINT, turn BIGINT, response STRING"), f"{tmp_path}/records")
    got = {r.conversation_id: r for r in records.collect()}
    assert {k: (r.score, r.details.total_turns, r.details.overall_hallucinated_responses, r.details.total_claims, r.details.hallucinations) for k, r in got.items()} == {
        1: (0.5, 2, 1, 3, 2), 2: (0.0, 1, 1, 0, 0), 3: (1.0, 1, 0, 1, 0), 4: (1.0, 0, 0, 0, 0)}
    assert [c.claim.package_name for c in got[1].details.claim_evaluations] == ["ghost", "ghost", None]
    assert got[4].reasoning == "No assistant turns found" and "ghost import" in got[1].reasoning
    report = direct.direct_report(records).first()
    assert (report.total_conversations, report.total_responses, report.overall_hallucinated_responses, report.conversations_with_import) == (4, 4, 2, 1)
    assert (report.total_claims, report.hallucinated_claims, report.overall_hallucination_rate, report.mean_score) == (4, 2, 0.5, 0.625)
    assert direct.direct_report(records.limit(0)).first().total_claims == 0


def test_prefixes_are_cut_for_the_asked_turns_only(spark):
    from verdictlake.operators import turns

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}.{t}") for c in (1, 2) for t in (0, 1, 2, 5)]
    talk = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    refs = turns.prefix_references(talk)
    assert {(r.conv_id, r.turn): r.n_messages for r in refs.collect()}[(2, 5)] == 4
    asked = refs.filter("turn = 5 AND conv_id = 1")
    got = turns.conversation_prefix(talk, system="S", suffix="!", asked=asked).collect()
    assert [(r.conv_id, r.turn, [m.content for m in r.prefix]) for r in got] == [(1, 5, ["S", "m1.0!", "m1.1", "m1.2!", "m1.5"])]
    # No exchange carries a prefix: references and whole conversations meet, and the cut comes last.
    plan = turns.conversation_prefix(talk)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "prefix" in line for line in plan.splitlines())


def test_author_names_are_looked_up(spark):
    rows = [(1, ["a", "b", None], ["b", None], None, None), (2, ["a"], None, 4, 1), (3, ["x", "x"], ["x"], None, None)]
    frame = spark.createDataFrame(rows, "conv_id BIGINT, predicted_names ARRAY<STRING>, matched_names ARRAY<STRING>, predicted_count INT, matches INT")
    got = sorted(((r.conv_id, r.name, r.matched) for r in resume.author_matches(frame).collect()), key=repr)
    assert got == sorted([(1, "a", None), (1, "b", True), (1, None, None), (2, "a", None), (3, "x", True), (3, "x", True)], key=repr)
