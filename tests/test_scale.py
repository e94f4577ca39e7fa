"""Range-partitioned helpers against plain pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordqc.operators.scale import first_per, percentiles, ranked, running, top_k, with_totals


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 900
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < .7, "hot", rng.choice(list("abcdef"), n)), "o": rng.permutation(n),
                        "v": rng.integers(0, 50, n).astype("float64")})
    pdf.loc[rng.random(n) < .3, "v"] = np.nan
    return pdf


def test_running_matches_pandas(spark, data):
    df = spark.createDataFrame(data).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = running(df, ["k"], ["o"], rn=("row_number", None), total=("sum", "v"), before=("sum_before", "v"), top=("max", "v"),
                  top_before=("max_before", "v"), last=("last", "v"), last_before=("last_before", "v"), lag=("lag", "o")).toPandas()
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    want = data.sort_values(["k", "o"]).reset_index(drop=True)
    g = want.groupby("k")
    want["rn"] = g.cumcount() + 1
    want["top"] = g["v"].transform(lambda s: s.cummax().ffill())
    want["top_before"] = g["v"].transform(lambda s: s.cummax().ffill().shift())
    want["last"] = g["v"].ffill()
    want["last_before"] = g["v"].transform(lambda s: s.ffill().shift())
    want["lag"] = g["o"].shift()
    want["total"] = g["v"].transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0))
    want["before"] = g["v"].transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0).shift())
    for c in ("rn", "total", "before", "top", "top_before", "last", "last_before", "lag"):
        pd.testing.assert_series_equal(got[c].astype("float64"), want[c].astype("float64"), check_names=False, obj=c)


def test_the_hot_key_is_spread(spark, data):
    df = spark.createDataFrame(data[["k", "o"]])
    ids = df.repartitionByRange(F.col("k"), F.col("o")).withColumn("p", F.spark_partition_id()).where("k = 'hot'").select("p").distinct().count()
    assert ids > 1


def test_rank_is_the_same_for_any_input_order(spark, data):
    a = ranked(spark.createDataFrame(data[["k", "o"]]), ["k"], ["o"]).toPandas()
    b = ranked(spark.createDataFrame(data[["k", "o"]].sample(frac=1, random_state=1)).repartition(5), ["k"], ["o"]).toPandas()
    key = ["k", "o"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_percentiles_match_numpy(spark, data):
    df = spark.createDataFrame(data.dropna())
    got = percentiles(df, ["k"], "v", {"q1": .25, "q2": .5, "q3": .75, "lo": 0, "hi": 1}, "n").toPandas().set_index("k")
    for k, g in data.dropna().groupby("k"):
        assert got.loc[k, "n"] == len(g)
        np.testing.assert_allclose(got.loc[k, ["lo", "q1", "q2", "q3", "hi"]].astype(float), np.quantile(g["v"], [0, .25, .5, .75, 1]))


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, o int")
    assert sorted((r.o, r.rn) for r in ranked(df, ["k"], ["o"]).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert sorted((r.o, r.n) for r in with_totals(df, ["k"], F.count(F.lit(1)).alias("n")).collect()) == [(1, 2), (2, 2), (3, 1)]


def test_top_k_limits_groups_before_the_shuffle(spark, data):
    df = spark.createDataFrame(data[["k", "o"]])
    plan = top_k(df, ["k"], ["o"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > 0
    assert first_per(df, ["k"], ["o"]).count() == data["k"].nunique()
