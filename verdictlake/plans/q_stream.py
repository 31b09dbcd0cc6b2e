"""Queries: streaming jobs drained to their end, their batch twins, and the caller's hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.operators import hooks as O
from verdictlake.operators import metrics as M
from verdictlake.operators import stateful as Z
from verdictlake.plans.fixtures import Inputs, with_views
from verdictlake.plans.q_rank import REUSE_SQL, STOP_SQL, _packages
from verdictlake.plans.q_reports import FUN, IMP, INS
from verdictlake.plans.registry import query, rounded
from verdictlake.sources import files
from verdictlake.streaming import jobs as J


def _arrive(i: Inputs, df, parts: list[str], start) -> None:
    """Write the table part by part, as many files as it has tasks, and run the stream after each part.

    The stream goes on from its checkpoint, so each part is a micro-batch of its own.
    """
    path, checkpoint = files.scratch(i.spark, "arrivals"), files.scratch(i.spark, "ckpt")
    for k, condition in enumerate(parts):
        df.filter(condition).write.parquet(f"{path}/part={k}")
        _drain(start(i.spark.readStream.schema(df.schema).parquet(path + "/*"), checkpoint))


def _conversation_stream(i: Inputs):
    schema = i.table("conversations").schema
    return i.spark.readStream.schema(schema).parquet(f"{i.folder}/[c]onversations.parquet")


def _drain(query) -> None:
    query.awaitTermination()


@query("streamed_judgments", "H1", with_views("judgments_fx", "SELECT claim_id, conv_id, turn, hallucination, verification_error FROM judgments_fx"))
def streamed_judgments(i: Inputs):
    sink = files.scratch(i.spark, "judgments")
    rows = i.judgments(conversations=_conversation_stream(i)).select("claim_id", "conv_id", "turn", "hallucination", "verification_error")
    _drain(J.stream_judgments(rows, sink, files.scratch(i.spark, "ckpt"), once=True))
    return i.spark.read.schema(rows.schema).parquet(sink)


@query("streamed_scores", "H1", with_views("judgments_fx", """
SELECT conv_id, count(*) AS total_claims, count(*) FILTER (WHERE hallucination = 'Yes') AS hallucinations, count(*) FILTER (WHERE snippets_only) AS snippets_only_count,
  round(1.0 - count(*) FILTER (WHERE hallucination = 'Yes') / CAST(count(*) AS DOUBLE), 6) AS score FROM judgments_fx GROUP BY 1"""))
def streamed_scores(i: Inputs):
    sink = files.scratch(i.spark, "scores")
    _arrive(i, i.judgments(), ["claim_idx < 4", "claim_idx >= 4"], lambda rows, ckpt: J.stream_scores(rows, sink, ckpt, once=True))
    return rounded(J.current_scores(i.spark, sink).select("conv_id", "total_claims", "hallucinations", "snippets_only_count", "score"))


@query("streamed_completions", "H3", with_views("judged_fx cache_fx", """
, e AS (SELECT conv_id, count(*) AS expected FROM cache_fx GROUP BY 1), j AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE hallucination = 'Yes') AS y FROM judged_fx GROUP BY 1)
SELECT conv_id, n AS total_claims, y AS hallucinations, expected, round(1.0 - y / CAST(n AS DOUBLE), 6) AS score FROM j JOIN e USING (conv_id) WHERE n >= expected"""))
def streamed_completions(i: Inputs):
    expected = i.cache().groupBy("conv_id").agg(F.count("*").alias("expected"))
    sink = files.scratch(i.spark, "done")
    _arrive(i, i.judged(), ["claim_idx < 4", "claim_idx >= 4"], lambda rows, ckpt: J.stream_complete(rows, expected, sink, ckpt, once=True))
    return rounded(J.completed(i.spark, sink).select("conv_id", "total_claims", "hallucinations", "expected", "score"))


@query("streamed_early_stops", "H4", with_views("judgments_fx", STOP_SQL + """
SELECT claim_id, skip AS skipped_early_stopping FROM walk WHERE claim_id IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1))
def streamed_early_stops(i: Inputs):
    sink = files.scratch(i.spark, "stops")
    _arrive(i, i.judgments(), ["claim_idx < 3", "claim_idx >= 3 AND claim_idx < 6", "claim_idx >= 6"],
            lambda rows, ckpt: J.stream_early_stop(rows, sink, ckpt, once=True))
    return i.spark.read.parquet(sink).select("claim_id", "skipped_early_stopping")


@query("streamed_reuse", "H4", with_views("judgments_fx payload_fx", REUSE_SQL + """
SELECT claim_id, reused, CASE WHEN reused THEN ex END AS package_exists FROM u"""))
def streamed_reuse(i: Inputs):
    """Conversations arrive in order of their ids, a third at a time."""
    judged = _packages(i)
    top = i.table("conversations").agg(F.max("conv_id")).first()[0]
    a, b = top // 3, 2 * top // 3
    sink = files.scratch(i.spark, "reuse")
    _arrive(i, judged, [f"conv_id <= {a}", f"conv_id > {a} AND conv_id <= {b}", f"conv_id > {b}"],
            lambda rows, ckpt: J.stream_reuse(rows, sink, ckpt, once=True))
    return i.spark.read.parquet(sink).select("claim_id", "reused", "package_exists")


@query("streamed_pdf_waits", "H2", with_views("claims_fx", """
, c AS (SELECT claim_id, h, h % 3 AS expected FROM claims_fx),
p AS (SELECT claim_id, concat('u', k) AS url, (h + k) % 7 <> 0 AS usable FROM c, LATERAL (SELECT unnest([0, 1]) AS k) x WHERE k < expected AND NOT (k = 1 AND h % 4 = 0)),
g AS (SELECT claim_id, count(*) AS received FROM p GROUP BY 1)
SELECT c.claim_id, expected, coalesce(received, 0) AS received, coalesce(received, 0) >= expected AS complete, url
FROM c LEFT JOIN g USING (claim_id) LEFT JOIN (SELECT * FROM p WHERE usable) u ON u.claim_id = c.claim_id"""))
def streamed_pdf_waits(i: Inputs):
    """Contents and most PDFs in time; the second PDF of some claims comes a day late and is dropped."""
    c = i.claims().select("claim_id", "h")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") % 60)
    contents = c.select("claim_id", ts.alias("ts"), (F.col("h") % 3).alias("expected"))
    pdfs = c.select("claim_id", "h", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).filter("k < h % 3")
    late = (F.col("k") == 1) & (F.col("h") % 4 == 0)
    arrived = pdfs.select(
        "claim_id", F.when(late, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts + F.expr("INTERVAL 30 SECONDS")).alias("ts"),
        F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"), F.lit("text").alias("content"),
        ((F.col("h") + F.col("k")) % 7 != 0).alias("success"))
    sink = files.scratch(i.spark, "waits")
    _arrive(i, J.content_arrivals(contents, arrived), [
        "expected IS NOT NULL AND ts < timestamp_seconds(1700000030)", "ts < timestamp_seconds(1700001000) AND (expected IS NULL OR ts >= timestamp_seconds(1700000030))",
        "ts >= timestamp_seconds(1700001000)"], lambda rows, ckpt: J.stream_attach_pdfs(rows, sink, ckpt, once=True))
    return J.attached_pdfs(i.spark, sink).drop("content")


LOG_SQL = """WITH log AS (SELECT ts, concat('stage', CAST(user_id % 4 AS VARCHAR)) AS stage,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'in' WHEN 'click' THEN 'out' ELSE CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END END AS kind, value * 10 AS wait_ms FROM events),
m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, stage, count(*) FILTER (WHERE kind = 'in') AS enqueued, count(*) FILTER (WHERE kind = 'out') AS dequeued, count(*) FILTER (WHERE kind = 'failed') AS failed,
  round(coalesce(avg(wait_ms) FILTER (WHERE kind = 'out'), 0), 6) AS avg_wait_ms, round(coalesce(max(wait_ms) FILTER (WHERE kind = 'out'), 0), 6) AS max_wait_ms FROM log GROUP BY 1, 2)"""


def _log(events):
    return events.selectExpr(
        "ts", "concat('stage', CAST(user_id % 4 AS STRING)) AS stage",
        """CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'in' WHEN 'click' THEN 'out'
           ELSE CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END END AS kind""", "value * 10 AS wait_ms")


def _seconds(df):
    return df.withColumn("window_start", F.unix_seconds(F.col("window_start").cast("timestamp")))


@query("stage_metrics", "H5", LOG_SQL + """
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, stage, enqueued, dequeued, failed, avg_wait_ms, max_wait_ms,
  CAST(sum(enqueued - dequeued) OVER w AS BIGINT) AS depth, sum(enqueued - dequeued) OVER w > 50 AS bottleneck
FROM m WINDOW w AS (PARTITION BY stage ORDER BY window_start)""")
def stage_metrics(i: Inputs):
    return _seconds(rounded(J.with_depth(J.stage_metrics(_log(i.table("events"))))))


@query("streamed_stage_metrics", "H5", LOG_SQL + """
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, stage, enqueued, dequeued, failed, avg_wait_ms, max_wait_ms FROM m""")
def streamed_stage_metrics(i: Inputs):
    """Windows in update mode; the newest state of each window is read back."""
    events = i.spark.readStream.schema(i.table("events").schema).parquet(f"{i.folder}/[e]vents.parquet")
    sink = files.scratch(i.spark, "metrics")

    def save(changed, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _drain(J.stage_metrics(_log(events)).writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", files.scratch(i.spark, "ckpt")).trigger(availableNow=True).start())
    from verdictlake.scale import latest_per_key

    newest = latest_per_key(i.spark.read.parquet(sink), ["window_start", "stage"], ["batch"]).drop("batch")
    return _seconds(rounded(newest))


DEAD_SQL = """SELECT event_id, CAST(event_id % 5 + 1 AS BIGINT) AS attempt, CASE WHEN event_id % 5 + 1 > 3 THEN 'dead' ELSE 'retry' END AS route FROM events WHERE event_type = 'error'"""


def _failures(events):
    return events.filter("event_type = 'error'").select("event_id", (F.col("event_id") % 5).alias("attempt"))


@query("dead_letters", "H6", DEAD_SQL)
def dead_letters(i: Inputs):
    retry, dead = J.split_dead_letters(_failures(i.table("events")))
    return retry.withColumn("route", F.lit("retry")).unionByName(dead.withColumn("route", F.lit("dead")))


@query("streamed_dead_letters", "H6", DEAD_SQL)
def streamed_dead_letters(i: Inputs):
    events = i.spark.readStream.schema(i.table("events").schema).parquet(f"{i.folder}/[e]vents.parquet")
    retry, dead = files.scratch(i.spark, "retry"), files.scratch(i.spark, "dead")
    _drain(J.stream_dead_letters(_failures(events), retry, dead, files.scratch(i.spark, "ckpt"), once=True))
    read = i.spark.read.schema("event_id BIGINT, attempt BIGINT").parquet
    return read(retry + "/*").withColumn("route", F.lit("retry")).unionByName(
        read(dead + "/*").withColumn("route", F.lit("dead")))


# ---- hooks ---------------------------------------------------------------------------------


@query("hooked_evaluation", "I1 I3 I4", """
WITH t AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n, count(*) FILTER (WHERE role = 'assistant' AND length(text) % 2 = 0) AS y FROM conversations GROUP BY 1)
SELECT conv_id, n AS total_claims, y AS hallucinations, round(CASE WHEN n > 0 THEN 1.0 - y / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS score FROM t""")
def hooked_evaluation(i: Inputs):
    """A whole evaluation from steps: pass-through claims, a caller's model function, parsing, scores."""
    def model(calls):
        for messages in calls:
            yield ("Yes" if len(messages[1]["content"]) % 2 == 0 else "No"), {"total_tokens": 1}

    def judge(claims):
        asked = O.build_messages(claims.withColumn("claim_id", F.concat_ws(":", "conv_id", "turn")), "Judge.", "claim_text")
        answers = O.infer(asked, model, keys=("claim_id", "conv_id"))
        return answers.select("claim_id", "conv_id", F.col("response").alias("hallucination"),
                              *[F.lit(False).alias(f) for f in M.FALLBACKS])

    turns = i.table("conversations").filter("role = 'assistant'")
    judged = O.run_steps(turns, O.pass_through_extractor, judge)
    everyone = i.table("conversations").select("conv_id").distinct()
    return rounded(M.score_conversations(everyone, judged).select("conv_id", "total_claims", "hallucinations", "score"))
