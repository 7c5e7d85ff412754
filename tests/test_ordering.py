import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillview.operators import ordering
from tillview.operators.ordering import ntile_of, quantile_bin_of, quantiles, ranked


def test_ranked_matches_full_sort(spark):
    df = spark.range(2003).select("id", (F.col("id") % 7).alias("v"), F.lit(1).alias("w"))
    got = ranked(df, [F.col("v").desc(), F.col("id")], total="n", running={"cum": "w"}).toPandas()
    want = got.sort_values(["v", "id"], ascending=[False, True]).reset_index(drop=True)
    assert list(want["rank"]) == list(range(1, 2004))
    assert (want["cum"] == want["rank"]).all() and (want["n"] == 2003).all()


def test_ranked_within_groups_spread_over_partitions(spark):
    df = spark.range(999).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"))
    got = ranked(df, [F.col("id").desc()], within=["g"]).toPandas()
    want = got.groupby("g")["id"].rank(ascending=False, method="first").astype(int)
    assert (got["rank"] == want).all()


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 13, 101])
def test_tiles(spark, n):
    df = spark.range(1, n + 1).select(
        "id",
        ntile_of(F.col("id"), F.lit(n), 5).alias("t"),
        quantile_bin_of(F.col("id"), F.lit(n), 5).alias("q"),
        F.expr("ntile(5) over (order by id)").alias("want"),
    )
    rows = df.collect()
    assert all(r["t"] == r["want"] for r in rows)
    if n > 1:
        want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert [r["q"] for r in sorted(rows)] == list(want)


@pytest.mark.parametrize("finish", [20_000, 50])
def test_quantiles_are_exact(spark, finish, monkeypatch):
    monkeypatch.setattr(ordering, "_FINISH_ROWS", finish)
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame(
        {
            "skew": rng.pareto(1.5, n).round(2),
            "third": np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 50, n)),
            "two": np.repeat([0.0, 1.0], n // 2),
            "flat": np.full(n, 3.0),
            "gaps": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n)),
        }
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(spark.createDataFrame(pdf).repartition(5), list(pdf), probs)
    for c in pdf:
        for p in probs:
            assert got[c][p] == pytest.approx(pdf[c].quantile(p), abs=1e-12), (c, p)


def test_quantiles_of_nothing(spark):
    got = quantiles(spark.createDataFrame([(None,)], "a double"), ["a"], [0.5])
    assert got["a"] == {"n": 0, "min": None, "max": None, 0.5: None}


def test_what_is_kept_follows_the_input_files(spark, tmp_path):
    from tillview.session import drop_staged, inputs, kept_for_inputs, stage

    folder, made = str(tmp_path), []

    @kept_for_inputs
    def count(at):
        made.append(at)
        return stage(spark.read.parquet(f"{at}/t.parquet"))

    spark.range(3).write.parquet(f"{folder}/t.parquet")
    first = inputs(spark, folder)
    assert count(spark, folder).count() == 3 and count(spark, folder).count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(f"{folder}/t.parquet")
    assert inputs(spark, folder) != first
    assert count(spark, folder).count() == 8 and len(made) == 2
    drop_staged(spark)
    assert count(spark, folder).count() == 8 and len(made) == 3
