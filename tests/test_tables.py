"""Clustered tables meet without a shuffle."""

from verdictlake.operators.resume import unjudged
from verdictlake.plans.fixtures import Inputs
from verdictlake.sources.tables import read_clustered, write_clustered


def test_resume_on_clustered_tables_needs_no_shuffle(spark, tmp_path):
    i = Inputs(spark, "/root/testdata/sf0.001")
    spark.sql("CREATE DATABASE IF NOT EXISTS lake LOCATION '%s'" % (tmp_path / "lake"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_clustered(i.claims(), "lake.claims", ["claim_id"], 4)
        write_clustered(i.judged(), "lake.judged", ["claim_id"], 4)
        out = unjudged(read_clustered(spark, "lake.claims"), read_clustered(spark, "lake.judged"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert out.count() == i.claims().count() - i.judged().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE lake CASCADE")
