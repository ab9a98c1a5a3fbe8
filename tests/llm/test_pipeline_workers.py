"""A task of a pipeline stage hands its texts to one Python worker, not to several at once, which an executor would have to hold."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_one_python_step_in_the_last_job_of_a_stage(spark, name, stage):
    out = stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
