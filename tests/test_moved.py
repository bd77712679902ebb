"""What the queries over the test tables move and hold: see the findings named in the commits."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia import queries
from evidentia.operators import verification
from evidentia.partitions import small_batches

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(spark):
    """The physical plan of a query where no table is sent unasked."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda rows: (queries.QUERIES[rows](spark, SF) if isinstance(rows, str) else rows)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_ablation_modes_ranks_once(plan_of):
    plan = plan_of("ablation_modes")
    assert "MapInArrow" not in plan and "tokens" not in plan and "Exchange hashpartitioning(doc_id#" not in plan


def test_grounding_report_finds_once(plan_of):
    assert "documents.parquet" not in plan_of("grounding_report")


def test_index_search_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(chunk_id#" not in plan_of("index_search")


def test_retrieval_metrics_finds_gold_once(plan_of):
    assert "documents.parquet" not in plan_of("retrieval_metrics")


def test_context_blocks_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("context_blocks")


def test_hybrid_source_filtered_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("hybrid_source_filtered")


def test_quotes_are_dealt_over_all_cores(spark, plan_of):
    rows = spark.createDataFrame([("a quote", "another body")], "q string, b string")
    assert "REPARTITION_BY_NUM" in plan_of(verification.verify_quotes(rows, "q", "b"))
    assert "documents.parquet" not in plan_of("quote_fuzzy")


def test_hybrid_topk_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("hybrid_topk")


def test_abstain_gate_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("abstain_gate")


def test_compare_authorities_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("compare_authorities")


def test_authority_prior_moves_no_document(plan_of):
    assert "Exchange hashpartitioning(doc_id#" not in plan_of("authority_prior")


def test_bm25_holds_no_more_for_longer_corpora(plan_of):
    assert "Exchange" not in plan_of("bm25_topk")


def test_page_batches_are_bounded_in_bytes(spark):
    @F.pandas_udf("long")
    def rows_of_batch(pages: pd.Series) -> pd.Series:
        return pd.Series([len(pages)] * len(pages))

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    queries.QUERIES["html_parse"](spark, SF)
    rows = spark.range(3000, numPartitions=1).select(rows_of_batch(F.repeat(F.lit("x"), 5000)).alias("n"))
    assert rows.agg(F.max("n")).first()[0] <= 1000
    small_batches(spark, 64 << 20)  # a smaller setting stays
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 2 << 20
