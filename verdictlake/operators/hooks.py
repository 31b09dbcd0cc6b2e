"""Where a caller's own steps plug in: row workers, model calls, evaluators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, *steps: Step) -> DataFrame:
    """Apply table-to-table steps in order; they stay one plan."""
    for step in steps:
        df = df.transform(step)
    return df


def flat_map(df: DataFrame, worker: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A worker that turns a batch of rows into none, one or many rows each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = worker(batch)
            if len(out):
                yield out

    return df.mapInPandas(run, schema)


BatchFn = Callable[[list[list[dict]]], Iterable[tuple[str, dict[str, int]]]]


def infer(df: DataFrame, batch_fn: BatchFn, messages: str = "messages", keys: tuple[str, ...] = ("claim_id",),
          batch_size: int = 50) -> DataFrame:
    """Call the caller's model function on message lists, `batch_size` at a time, keeping the keys.

    `batch_fn` gets message lists and gives (text, usage) for each. A failing batch gives error rows, so
    one bad call does not lose the partition. Write the result before using it twice: it would be called again.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", response STRING, token_usage MAP<STRING, BIGINT>, error STRING"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at: at + batch_size]
                out = part[list(keys)].copy()
                calls = [[dict(m) if isinstance(m, dict) else m.asDict() for m in ms] for ms in part[messages]]
                try:
                    answers = list(batch_fn(calls))
                    out["response"] = [t for t, _ in answers]
                    out["token_usage"] = [dict(u) for _, u in answers]
                    out["error"] = None
                except Exception as e:  # the call is the caller's; its failure is data here
                    out["response"], out["token_usage"], out["error"] = None, None, str(e)
                yield out

    return df.select(*keys, messages).mapInPandas(run, schema)


def build_messages(df: DataFrame, system: str, prompt: str = "prompt", out: str = "messages") -> DataFrame:
    """System and user message of each row."""
    def message(role: str, content) -> F.Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.withColumn(out, F.array(message("system", F.lit(system)), message("user", F.col(prompt))))


def pass_through_extractor(turns: DataFrame) -> DataFrame:
    """Extractor that hands the whole turn on as its only claim."""
    return turns.select("conv_id", "turn", F.lit(0).cast("bigint").alias("claim_idx"), F.col("text").alias("claim_text"),
                        F.col("text").alias("original_statement"))


def evaluate(turns: DataFrame, extract: Step, judge: Step, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Extractor, judge and scorer, each a function of tables, over the turns of all conversations."""
    judgments = run_steps(turns, extract, judge)
    return score(turns.select("conv_id").distinct(), judgments)
