"""Streaming forms of the stateful work.

Sinks are keyed by micro-batch, so a batch that is run again after a failure
replaces its own output. State is kept per key with an expiry (`state`), never read back
from what earlier batches wrote. `once=True` takes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictlake.functions import labels as L
from verdictlake.operators import stateful as Z
from verdictlake.operators.metrics import FALLBACKS
from verdictlake.operators.text import package_key
from verdictlake.scale import latest_per_key, write_through
from verdictlake.streaming import state as S

MAX_ATTEMPTS = 3
# How long contents wait for their PDFs, and the depth that marks a bottleneck.
PDF_WAIT_SECONDS = 300
DEPTH_WARNING = 50


def _start(writer, checkpoint: str, once: bool, every: str = "1 minute") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _start_expiring(writer, checkpoint: str, once: bool, every: str = "1 minute") -> StreamingQuery:
    """State that expires by the clock always has another batch to run, so `once` is a single batch."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def _both(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """A stream's rows and what the keyed state answers to them, as one stream of (row, answer)."""
    row, answer = rows.select(F.struct(*rows.columns).alias("row")), answers.select(F.struct(*answers.columns).alias("answer"))
    return row.unionByName(answer, allowMissingColumns=True)


def _parted(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts of a batch of `_both`, written once, since a second run would change the state again."""
    held = write_through(batch)
    return held.filter("row IS NOT NULL").select("row.*"), held.filter("answer IS NOT NULL").select("answer.*")


def _batch_path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"


# ---- judging tables ------------------------------------------------------------------------


def stream_judgments(source: DataFrame, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append new judgments to a parquet table; progress is durable and each row lands once."""
    return _start(source.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint, once)


def _claim_counts(judged: DataFrame, flags=()) -> tuple[DataFrame, list[str]]:
    """Claims as ones to be summed, reduced per map task: a hot conversation sends its key a few rows."""
    ones = judged.select("conv_id", F.lit(1).cast("bigint").alias("total_claims"), *[
        F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in (
            ("hallucinations", F.lower("hallucination") == "yes"), *[(f"{f}_count", F.col(f)) for f in flags])])
    return S.partial(ones, ["conv_id"], lambda g: g.sum()), ones.columns[1:]


def stream_scores(source: DataFrame, sink: str, checkpoint: str, ttl_ms: int = S.DAY_MS, once: bool = False) -> StreamingQuery:
    """Running counts per conversation; each batch writes the conversations it changed.

    A conversation without a claim for `ttl_ms` is forgotten; what was written stays.
    """
    counts, columns = _claim_counts(source, FALLBACKS)
    running = S.keyed(counts, ["conv_id"], S.Totals("conv_id", columns, ttl_ms), counts.schema)

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start_expiring(running.writeStream.outputMode("update").foreachBatch(save), checkpoint, once)


def current_scores(spark: SparkSession, sink: str) -> DataFrame:
    """Newest counts of every conversation, with its score."""
    rows = latest_per_key(spark.read.parquet(sink), ["conv_id"], ["batch"]).drop("batch")
    return rows.withColumn("score", F.lit(1.0) - L.rate(F.col("hallucinations"), F.col("total_claims")))


def stream_complete(
    judgments: DataFrame, expected: DataFrame, sink: str, checkpoint: str, ttl_ms: int = S.DAY_MS, once: bool = False
) -> StreamingQuery:
    """Conversations whose expected claims have all been judged, written when that happens.

    The state is two counts per conversation; it goes when the conversation is complete, or
    after `ttl_ms` without a claim. `expected` is a table of conv_id, expected; conversations
    that it does not list never complete and keep no state.
    """
    counts, columns = _claim_counts(judgments)
    known = counts.join(expected.select("conv_id", F.col("expected").cast("bigint").alias("expected")), "conv_id")
    done = S.keyed(known, ["conv_id"], S.Completion("conv_id", columns, ttl_ms), known.schema)

    def save(ready: DataFrame, batch_id: int) -> None:
        scored = ready.withColumn("score", F.lit(1.0) - L.rate(F.col("hallucinations"), F.col("total_claims")))
        scored.write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start_expiring(done.writeStream.outputMode("update").foreachBatch(save), checkpoint, once)


def completed(spark: SparkSession, sink: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(sink), ["conv_id"], ["batch"]).drop("batch")


# ---- early stopping and reuse --------------------------------------------------------------


def stream_early_stop(
    judged: DataFrame, sink: str, checkpoint: str, order: str = "claim_idx", ttl_ms: int = S.DAY_MS, once: bool = False
) -> StreamingQuery:
    """Early stopping over arriving claims of a turn, in their order.

    The state of a turn is its first sightings, 28 places at most. A batch sends each turn the
    minimums of its own claims and decides its claims by the turn's detections, in a batch
    join. A turn without a claim for `ttl_ms` starts anew.
    """
    slot = (Z.type_number(F.col("element_type")) * 8 + Z.raised_types(judged)).cast("int")
    seen = judged.select(*Z.TURN, slot.alias("slot"), F.col(order).cast("bigint").alias("at"))
    firsts = S.partial(seen, [*Z.TURN, "slot"], lambda g: g.min())
    answer = ", ".join([*(f"{k} {dict(judged.dtypes)[k]}" for k in Z.TURN), *(f"_from_{k} bigint" for k in range(3))])
    found = S.keyed(firsts, Z.TURN, S.Sightings(Z.TURN, ttl_ms), answer)

    def run(batch: DataFrame, batch_id: int) -> None:
        claims, detections = _parted(batch)
        Z.early_stop(claims, order, found=detections).write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start_expiring(_both(judged, found).writeStream.outputMode("update").foreachBatch(run), checkpoint, once)


def stream_reuse(judged: DataFrame, sink: str, checkpoint: str, ttl_ms: int = S.DAY_MS, once: bool = False) -> StreamingQuery:
    """Verdict reuse over arriving claims; the state of a package is its first verdict.

    A verdict that was neither given nor asked for within `ttl_ms` is forgotten, and the
    package is judged again.
    """
    usable, exists = Z.verdict_of(judged)
    seen = judged.select(
        package_key("package_name").alias("package_key"), *[F.col(c).cast("bigint").alias(c) for c in S.FirstVerdict.PLACE],
        F.coalesce(usable, F.lit(False)).alias("usable"), exists.alias("package_exists")).filter("package_key <> ''")
    firsts = S.partial(seen, ["package_key", "usable"], _earliest)
    found = S.keyed(firsts, ["package_key"], S.FirstVerdict(ttl_ms), seen.drop("usable").schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        claims, verdicts = _parted(batch)
        place = F.struct(*[F.col(c).cast(dict(claims.dtypes)[c]).alias(c) for c in S.FirstVerdict.PLACE])
        first = verdicts.select("package_key", place.alias("_place"), "package_exists")
        Z.reuse_verdicts(claims, first).write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start_expiring(_both(judged, found).writeStream.outputMode("update").foreachBatch(run), checkpoint, once)


def _earliest(groups):
    """The row of the least place in each group."""
    frame = groups.obj.sort_values(list(S.FirstVerdict.PLACE), kind="stable")
    return frame.drop_duplicates(["package_key", "usable"]).set_index(["package_key", "usable"])


# ---- contents waiting for PDFs -------------------------------------------------------------



def content_arrivals(contents: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Both inputs as one stream: contents (claim_id, ts, expected) and PDFs (claim_id, ts, url, content, success)."""
    none = F.lit(None)
    heads = contents.select("claim_id", "ts", F.col("expected").cast("bigint").alias("expected"),
                            none.cast("string").alias("url"), none.cast("string").alias("content"),
                            none.cast("boolean").alias("usable"))
    usable = F.col("success") & (F.coalesce("content", F.lit("")) != "")
    return heads.unionByName(pdfs.select(
        "claim_id", "ts", none.cast("bigint").alias("expected"), "url", "content", usable.alias("usable")))


def stream_attach_pdfs(
    arrivals: DataFrame, sink: str, checkpoint: str, wait_seconds: int = PDF_WAIT_SECONDS, delay: str = "5 minutes", once: bool = False
) -> StreamingQuery:
    """Claims as their PDFs become complete or time out, by event time; late PDFs are dropped.

    A claim is given out when its expected PDFs came, or when the newest event time less
    `delay` passes its first arrival plus the wait. The state of a claim is its counts and
    stamps; PDFs whose contents never come are forgotten when their wait is over. Texts go
    from the stream to the sink once and are in no state and no checkpoint. Rows more than
    `delay` behind the newest event time are dropped. `attached_pdfs` reads the result.
    """
    stamped = arrivals.filter("claim_id IS NOT NULL AND ts IS NOT NULL")
    timed = stamped.select("claim_id", "ts", "expected").withWatermark("ts", delay)
    narrow = timed.select("claim_id", "ts", F.unix_millis("ts").alias("ms"), "expected")
    given = S.keyed(narrow, ["claim_id"], S.PdfWait(wait_seconds * 1000),
                    f"claim_id {dict(arrivals.dtypes)['claim_id']}, expected bigint, received bigint, complete boolean, deadline bigint", "EventTime", plain=True)
    texts = stamped.filter("expected IS NULL AND usable").select("claim_id", F.unix_millis("ts").alias("ms"), "url", "content")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(sink, batch_id))

    return _start(_both(texts, given).writeStream.outputMode("update").foreachBatch(run), checkpoint, once)


def attached_pdfs(spark: SparkSession, sink: str) -> DataFrame:
    """Claims given out, with the usable PDFs that came within their wait and not after they were given out."""
    rows = spark.read.parquet(sink)
    out = rows.filter("answer IS NOT NULL").select("answer.*", F.col("batch").alias("_batch"))
    texts = rows.filter("row IS NOT NULL").select(F.col("row.claim_id").alias("_claim"), "row.ms", "row.url", "row.content", F.col("batch").alias("_came"))
    own = (F.col("claim_id") == F.col("_claim")) & (F.col("ms") <= F.col("deadline")) & (F.col("_came") <= F.col("_batch"))
    return out.join(texts, own, "left").select("claim_id", "expected", "received", "complete", "url", "content")


# ---- stage log -----------------------------------------------------------------------------


def stage_metrics(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per stage and tumbling window: rows in and out, failures, average and longest wait.

    `log` carries ts, stage, kind (in, out, failed) and wait_ms; batch or stream.
    """
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    kind = F.col("kind")
    out = log.groupBy(F.window("ts", window).alias("w"), "stage").agg(
        L.count_true(kind == "in").alias("enqueued"), L.count_true(kind == "out").alias("dequeued"),
        L.count_true(kind == "failed").alias("failed"),
        F.coalesce(F.avg(F.when(kind == "out", F.col("wait_ms"))), F.lit(0.0)).alias("avg_wait_ms"),
        F.coalesce(F.max(F.when(kind == "out", F.col("wait_ms"))), F.lit(0.0)).alias("max_wait_ms"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "enqueued", "dequeued", "failed",
                      "avg_wait_ms", "max_wait_ms")


def with_depth(metrics: DataFrame) -> DataFrame:
    """Queue depth at the end of each window (all rows in so far minus all out) and whether it is a bottleneck.

    Works on windowed counts: one row per stage and window.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy("stage").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.col("enqueued") - F.col("dequeued")).over(so_far)
    return metrics.withColumn("depth", depth).withColumn(
        "bottleneck", (F.col("depth") > DEPTH_WARNING) & (F.lower("stage") != "results"))


def split_dead_letters(df: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Failed rows to try again (with their next attempt number), and rows that used up their attempts."""
    counted = df.withColumn("attempt", F.col("attempt") + 1)
    again: Column = F.col("attempt") <= max_attempts
    return counted.filter(again), counted.filter(~again)


def stream_dead_letters(
    failures: DataFrame, retry_sink: str, dead_sink: str, checkpoint: str, max_attempts: int = MAX_ATTEMPTS,
    once: bool = False,
) -> StreamingQuery:
    """Route failed rows of a stream to the retry table or the dead-letter table."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            retry, dead = split_dead_letters(batch, max_attempts)
            retry.write.mode("overwrite").parquet(_batch_path(retry_sink, batch_id))
            dead.write.mode("overwrite").parquet(_batch_path(dead_sink, batch_id))
        finally:
            batch.unpersist()

    return _start(failures.writeStream.foreachBatch(run), checkpoint, once)
