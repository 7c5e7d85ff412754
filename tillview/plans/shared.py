"""What several groups of queries share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillview.operators.relations import Relations
from tillview.session import kept_for_inputs, tune
from tillview.sources.transactions import benchmark_source


@kept_for_inputs
def _relations(sf_dir: str) -> Relations:
    spark = tune(SparkSession.active())
    return Relations(spark, benchmark_source(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    """One Relations per dataset and application, so the date range and the scores are computed once."""
    return _relations(spark, sf_dir)
