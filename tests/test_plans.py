"""Plans keep their shape: no products, no Python outside its named places, pruned and pushed-down scans."""

import re

import pytest

from verdictlake.operators import metrics as M
from verdictlake.operators import turns as T
from verdictlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"document_blocks", "hooked_evaluation", "selected_evidence", "evidence_texts", "page_links", "pdf_links", "page_texts", "page_texts_with_word_limit", "pdf_plan"}
# A window without partitions would pull all rows into one task. These scan one row per model or per range.
ONE_WINDOW = {"leaderboard_coding", "ordered_facts", "numbered_claims", "next_prompt_slice", "remaining_prompts"}
LONE_WINDOW = r"Window \[[^\n]*\n(?:[^\n]*(?:Project|InputAdapter|Sort )[^\n]*\n){0,4}[^\n]*Exchange SinglePartition"
BATCH = sorted(n for n in catalog.QUERIES if not n.startswith("streamed"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_and_no_stray_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)
    if name not in PYTHON:
        assert not re.search("ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas", text)
    if name not in ONE_WINDOW:
        assert not re.search(LONE_WINDOW, text)


def test_filters_and_columns_reach_the_scan(spark):
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    text = plan(T.assistant_turns(conversations, "stored").select("conv_id", "turn_number"))
    assert "EqualTo(role,assistant)" in text
    assert "text" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_report_reads_only_its_columns(spark, tmp_path):
    from verdictlake.plans.fixtures import Inputs

    path = str(tmp_path / "judgments")
    Inputs(spark, FOLDER).judgments().write.partitionBy("element_type").parquet(path)
    stored = spark.read.parquet(path)
    text = plan(M.grounding_totals(stored.filter("element_type = 'import'")))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "claim_id" not in schema and "reference_grounding" not in schema
    assert re.search(r"PartitionFilters: \[[^\]]*element_type", text)


def test_scores_shuffle_rows_only_after_partial_aggregation(spark):
    from verdictlake.plans.fixtures import Inputs

    i = Inputs(spark, FOLDER)
    convs = i.table("conversations").select("conv_id").distinct()
    text = plan(M.score_conversations(convs, i.judgments()))
    below = [line for line in text.splitlines() if "Exchange" in line or "partial_" in line]
    assert sum("Exchange hashpartitioning" in line for line in below) == 2 and any("partial_count" in line for line in below)


@pytest.mark.parametrize("name", ["fetch_plan", "fetched_with_snippets", "resolved_refs"])
def test_hits_of_a_claim_are_shuffled_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert sum("Exchange hashpartitioning(claim_id" in line for line in text.splitlines()) == 1
