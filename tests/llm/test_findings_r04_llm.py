"""Findings of the fourth review: what the training-data operators broadcast."""

from pyspark.sql import functions as F

from chalkline.llm import simhash


def test_cells_of_a_small_table_are_not_broadcast(spark):
    """Each point becomes up to 66 cells, which the engine sizes as the point alone."""
    reps = spark.range(2000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"))
    plan = simhash.links(reps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "Broadcast" not in plan


def test_pipeline_stage_broadcasts_no_cells(spark, monkeypatch):
    plans = []
    written = simhash.written

    def kept(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, tag)

    monkeypatch.setattr(simhash, "written", kept)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.xxhash64(F.floor(F.col("id") / 2), F.lit(i)) for i in range(12))).alias("text"))
    assert simhash.keep_documents(docs).count() == 150
    links = next(plan for tag, plan in plans if tag == "links")
    assert "SortMergeJoin [cell" in links
