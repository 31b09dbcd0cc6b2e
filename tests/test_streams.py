"""Keyed state of the streams: decisions batch by batch, expiry, and what a batch reads and keeps."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import stateful as Z
from verdictlake.streaming import jobs as J
from verdictlake.streaming import state as S

CLAIM = ("claim_id STRING, conv_id BIGINT, turn BIGINT, claim_idx BIGINT, element_type STRING, package_name STRING, code_snippet STRING, hallucination STRING, "
         "hallucinated_import_detected BOOLEAN, hallucinated_install_detected BOOLEAN, hallucinated_function_usage_detected BOOLEAN")
KINDS = ("import", "install", "function_call", "other")


def claim(conv, turn, idx, kind, package="p", flags=(False, False, False)):
    return (f"{conv}:{turn}:{idx}", conv, turn, idx, kind, package, "x", "No", *flags)


def feed(spark, base, schema, parts, start):
    """Run `start` once per part; the queries, finished."""
    out = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{base}/in/part={k}")
        query = start(spark.readStream.schema(schema).parquet(f"{base}/in/*"), f"{base}/ckpt")
        query.awaitTermination()
        out.append(query)
    return out


def mixed(n, batches):
    """Claims of three turns, one of them with most rows, by their place."""
    rows = []
    for idx in range(n):
        for conv, turn in ((1, 1), (1, 1), (2, 1), (2, 3))[idx % 2:]:
            h = idx * 7 + conv * 3 + turn + len(rows)
            rows.append(claim(conv, turn, len(rows), KINDS[h % 4], f"p{h % 5}", (h % 9 == 0, h % 11 == 0, h % 6 == 0)))
    size = -(-len(rows) // batches)
    return [rows[k:k + size] for k in range(0, len(rows), size)]


def test_twenty_batches_decide_as_one_table_and_read_only_themselves(spark, tmp_path):
    parts = mixed(60, 20)
    queries = feed(spark, tmp_path, CLAIM, parts, lambda rows, ckpt: J.stream_early_stop(rows, f"{tmp_path}/out", ckpt, once=True))
    assert len(queries) == 20
    whole = spark.createDataFrame([r for p in parts for r in p], CLAIM)
    want = {r.claim_id: r.skipped_early_stopping for r in Z.early_stop(whole).collect()}
    assert {r.claim_id: r.skipped_early_stopping for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and any(want.values())
    for query, rows in zip(queries, parts):
        last = [p for p in query.recentProgress if p["numInputRows"]][-1]
        # The rows of this batch only, once for the state and once for the decision; state is one row a turn.
        assert last["numInputRows"] == 2 * len(rows)
        assert last["stateOperators"][0]["numRowsTotal"] <= 3
        # A task sends at most one row per turn, own type and raised types, however many claims it holds.
        assert last["stateOperators"][0]["numRowsUpdated"] <= 3
    assert not glob.glob(f"{tmp_path}/state*")


def test_reuse_over_batches_equals_one_table(spark, tmp_path):
    parts = mixed(40, 4)
    feed(spark, tmp_path, CLAIM, parts, lambda rows, ckpt: J.stream_reuse(rows, f"{tmp_path}/out", ckpt, once=True))
    whole = spark.createDataFrame(sorted((r for p in parts for r in p), key=lambda r: r[3]), CLAIM)
    # Claims arrive by claim_idx while places also order by conversation, so a batch decides from what came so far.
    seen, want = [], {}
    for p in parts:
        seen += p
        first = Z.first_verdicts(spark.createDataFrame(seen, CLAIM))
        want |= {r.claim_id: (r.reused, r.package_exists) for r in Z.reuse_verdicts(spark.createDataFrame(p, CLAIM), first).collect()}
    got = {r.claim_id: (r.reused, r.package_exists) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and len(got) == whole.count() and any(v[0] for v in got.values())


def test_forgotten_turns_and_packages_start_anew(spark, tmp_path):
    first = [claim(1, 1, 0, "import", "p", (True, False, False))]
    second = [claim(1, 1, 1, "import", "p")]
    for ttl, skipped in ((S.DAY_MS, True), (1, False)):
        base = f"{tmp_path}/{ttl}"

        def stop(rows, ckpt):
            time.sleep(0.1)
            return J.stream_early_stop(rows, f"{base}/out", ckpt, ttl_ms=ttl, once=True)

        feed(spark, base, CLAIM, [first, second], stop)
        assert {r.claim_id: r.skipped_early_stopping for r in spark.read.parquet(f"{base}/out").collect()} == {"1:1:0": False, "1:1:1": skipped}
        feed(spark, f"{base}/r", CLAIM, [first, second], lambda rows, ckpt: J.stream_reuse(rows, f"{base}/reuse", ckpt, ttl_ms=ttl, once=True))
        assert {r.claim_id: r.reused for r in spark.read.parquet(f"{base}/reuse").collect()} == {"1:1:0": False, "1:1:1": skipped}


def test_scores_and_completions_forget(spark, tmp_path):
    schema = "conv_id BIGINT, hallucination STRING, input_use_fallback BOOLEAN, judge_used_websearch_fallback BOOLEAN, snippets_only BOOLEAN"
    parts = [[(1, "Yes", True, None, False), (1, "No", False, None, False), (2, "yes", False, None, True)], [(1, None, False, True, False)], [(2, "No", False, None, False)]]
    feed(spark, f"{tmp_path}/a", schema, parts, lambda rows, ckpt: J.stream_scores(rows, f"{tmp_path}/scores", ckpt, once=True))
    got = {r.conv_id: (r.total_claims, r.hallucinations, r.input_use_fallback_count, r.judge_used_websearch_fallback_count, r.snippets_only_count)
           for r in J.current_scores(spark, f"{tmp_path}/scores").collect()}
    assert got == {1: (3, 1, 1, 1, 0), 2: (2, 1, 0, 0, 1)}
    expected = spark.createDataFrame([(1, 3), (2, 5)], "conv_id BIGINT, expected BIGINT")
    queries = feed(spark, f"{tmp_path}/b", schema, parts, lambda rows, ckpt: J.stream_complete(rows, expected, f"{tmp_path}/done", ckpt, once=True))
    assert [(r.conv_id, r.total_claims, r.hallucinations, r.expected) for r in J.completed(spark, f"{tmp_path}/done").collect()] == [(1, 3, 1, 3)]
    # The complete conversation is in no state; the one still waiting is.
    assert [q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] for q in queries] == [2, 1, 1]


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("waits")
    schema = "claim_id STRING, ts TIMESTAMP, expected BIGINT, url STRING, content STRING, usable BOOLEAN"
    text = "a long text that must stay out of the state"

    def head(claim, at, n):
        return (claim, at, n, None, None, None)

    def pdf(claim, at, url, usable=True):
        return (claim, at, None, url, text, usable)

    parts = [
        [head("a", 0, 1), pdf("a", 10, "u"), head("b", 0, 2), pdf("b", 20, "v"), pdf("d", 0, "orphan"), head("z", 5, 0)],
        [pdf("early", 30, "w"), pdf("a", 40, "after a was given out"), head("f", 30, 2), pdf("f", 31, "x", False)],
        [head("early", 60, 1), pdf("f", 200, "y")],
        [pdf("b", 900, "late"), head("c", 880, 1)],
    ]
    stamped = [[(c, t, *r) for c, t, *r in p] for p in parts]
    out = []
    for k, p in enumerate(stamped):
        spark.createDataFrame(p, schema.replace("ts TIMESTAMP", "ts BIGINT")).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).write.parquet(f"{base}/in/part={k}")
        query = J.stream_attach_pdfs(spark.readStream.schema(schema).parquet(f"{base}/in/*"), f"{base}/out", f"{base}/ckpt", once=True)
        query.awaitTermination()
        out.append(query)
    return base, out, text


def test_claims_complete_time_out_and_drop_late_pdfs(spark, arrivals):
    base, _, _ = arrivals
    got = {(r.claim_id, r.expected, r.received, r.complete, r.url) for r in J.attached_pdfs(spark, f"{base}/out").collect()}
    assert got == {("a", 1, 1, True, "u"), ("z", 0, 0, True, None), ("early", 1, 1, True, "w"), ("f", 2, 2, True, "y"), ("b", 2, 1, False, "v")}


def test_texts_are_in_no_state_and_orphans_are_forgotten(arrivals):
    base, queries, text = arrivals
    for folder, _, names in os.walk(f"{base}/ckpt"):
        for name in names:
            with open(f"{folder}/{name}", "rb") as f:
                assert text.encode() not in f.read()
    # Only the claim that still waits for its PDF is kept.
    assert queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_detections_of_slots_equal_the_batch_walk(spark):
    rows = [claim(c, 1, k, KINDS[(k * 5 + c) % 4], "p", ((k + c) % 3 == 0, (k * c) % 4 == 1, (k + 2 * c) % 5 == 0)) for c in range(30) for k in range(c % 9 + 1)]
    judged = spark.createDataFrame(rows, CLAIM)
    want = {r.conv_id: [r._from_0, r._from_1, r._from_2] for r in Z.detections(Z.first_sightings(judged)).collect()}
    slots = judged.select("conv_id", "claim_idx", (Z.type_number(F.col("element_type")) * 8 + Z.raised_types(judged)).alias("slot")).collect()
    for conv in range(30):
        at = [None] * S.SLOTS
        for r in slots:
            if r.conv_id == conv and (at[r.slot] is None or at[r.slot] > r.claim_idx):
                at[r.slot] = r.claim_idx
        assert S.detected(at) == want.get(conv, [None] * 3)


class CountedState:
    """A handle and value state in memory that counts calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_claim_takes_few_state_calls():
    from pyspark.sql import Row

    from verdictlake.streaming.state import PdfWait

    def batch(*rows):
        return [tuple(r) for r in wait.handleInputRows(("a",), iter([Row(ms=ms, expected=e) for ms, e in rows]), None)]

    store = CountedState()
    wait = PdfWait(100)
    wait.init(store)
    assert batch((5, 0)) == [("a", 0, 0, True, 105)] and store.calls == ["get"]
    assert batch((5, 1), (7, None)) == [("a", 1, 1, True, 105)] and store.calls == ["get"] * 2
    store.calls.clear()
    assert batch((50, 2)) == [] and store.calls == ["get", "register", "update"] and store.timers == {150}
    store.calls.clear()
    assert batch((400, None)) == [] and store.calls == ["get"]
    assert batch((40, None)) == [] and store.timers == {140}
    assert batch((60, None)) == [("a", 2, 2, True, 140)] and store.value is None and not store.timers
    assert batch((10, None)) == [] and list(wait.handleExpiredTimer(("a",), None, None)) == []
    store.timers.clear()  # a timer that fires is gone
    assert batch((10, 3)) == [] and [tuple(r) for r in wait.handleExpiredTimer(("a",), None, None)] == [("a", 3, 0, False, 110)]
