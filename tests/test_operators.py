import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import evaluate, fuse, sample, sets, tabular


def test_positions_have_no_gaps_whatever_else_rows_hold(spark):
    df = spark.range(0, 60_000, 1, 5).select((F.col("id") * 7919 % 60_007).alias("k"), F.concat(F.lit("row "), F.col("id")).alias("more"))
    got = sets.numbered(df, F.col("k")).toPandas().sort_values("k")
    assert got["position"].tolist() == list(range(1, 60_001))


def test_ranks_are_by_hash_within_each_label(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 77 > 0, "usual").alias("label"), F.lit("x").alias("n_more"))
    got = sample.ranked(df, "label", "id", 3).toPandas()
    assert len(got) == df.filter("label is not null").count()
    import hashlib

    got["h"] = [hashlib.sha256(f"{i}|3".encode()).hexdigest() for i in got["id"]]
    for _, rows in got.groupby("label"):
        rows = rows.sort_values("h")
        assert rows["r"].tolist() == list(range(1, len(rows) + 1)) and set(rows["n"]) == {len(rows)}


def test_lags_and_interactions_equal_pandas(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"g": rng.integers(0, 4, 60), "t": np.arange(60), "x": rng.normal(size=60).round(3), "y": rng.normal(size=60).round(3)})
    got = tabular.interactions(tabular.lags(spark.createDataFrame(rows), "g", ["t"], ["x"]), ["x", "y"]).toPandas().sort_values("t").reset_index(drop=True)
    before = rows.groupby("g")["x"].shift(1)
    rolled = lambda n, least: before.groupby(rows["g"]).rolling(n, min_periods=least)
    flat = lambda s: s.reset_index(level=0, drop=True).sort_index()
    np.testing.assert_allclose(got["x_lag2"], rows.groupby("g")["x"].shift(2))
    np.testing.assert_allclose(got["x_roll5_mean"], flat(rolled(5, 1).mean()))
    np.testing.assert_allclose(got["x_roll5_std"], flat(rolled(5, 2).std()), atol=1e-9)
    np.testing.assert_allclose(got["x_delta_roll3"], rows["x"] - flat(rolled(3, 1).mean()))
    np.testing.assert_allclose(got["x_div_y"], rows["x"] / (rows["y"].abs() + 1e-6))
    assert {"x_plus_y", "x_minus_y", "x_mul_y"} <= set(got.columns)


def test_correlated_columns_go_and_constant_ones_stay(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * -3.0).alias("b"), F.lit(1.0).alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") + 0.5).alias("d"), F.rand(1).alias("e"), F.lit(None).cast("double").alias("f"))
    assert tabular.without_correlated(df, df.columns).columns == ["a", "c", "e", "f"]
    assert tabular.without_correlated(df.limit(0), df.columns).columns == df.columns


def test_mixed_sample_takes_no_row_twice_and_fills_up(spark):
    df = spark.range(30).select("id", (F.col("id") < 4).alias("odd"))
    got = sample.mixed(df, "id", 1, [("odd", F.col("odd"), 6), ("even", F.col("id") % 2 == 0, 5)], 20).toPandas()
    assert got["id"].is_unique and got["sample_strategy"].value_counts().to_dict() == {"random_fill": 11, "even": 5, "odd": 4}
    assert sample.mixed(df, "id", 1, [("odd", F.col("odd"), 6)], 50).count() == 30


def test_run_delta_keeps_groups_that_one_run_lacks(spark):
    old, new = (spark.createDataFrame(r, "g string, f double") for r in ([("a", 0.5), ("b", 0.2)], [("a", 0.4), ("c", 0.9)]))
    got = {r.g: (r.delta, r.status) for r in evaluate.run_delta(old, new, ["g"], ["f"]).collect()}
    assert got == {"a": (-0.1, "worse"), "b": (None, "missing"), "c": (None, "missing")}


def test_time_folds_are_equal_blocks_at_the_end(spark):
    got = tabular.time_folds(spark.range(25).select(F.lit("x").alias("more"), (100 - F.col("id")).alias("t")), [F.col("t")], 3).toPandas().sort_values("t")
    assert got["fold"].tolist() == [0] * 7 + [1] * 6 + [2] * 6 + [3] * 6
    assert {r.fold for r in tabular.time_folds(spark.range(2), [F.col("id")], 3).collect()} == {0}


def test_weights_are_chosen_on_the_other_folds(spark):
    rows = [(f, t, t, "support") for f in range(3) for t in ("support", "partial", "not_support") for _ in range(4)]  # the first model is right
    df = spark.createDataFrame(rows, "fold int, y string, good string, bad string")
    got = fuse.weighted_vote(df, "fold", "y", ["good", "bad"], fuse.weight_sets(spark, 2)).collect()
    assert sorted(r.fold for r in got) == [0, 1, 2] and all(r.accuracy == 1 and r.score == 1 for r in got)


def test_sections_hold_the_best_sentences_in_their_order(spark):
    sentences = ["none here", "a delay", "delay and claim", "x", "claim first, claim again, with words enough to count"]
    df = spark.createDataFrame([(sentences,), ([],), (None,), (["p", "q", "r"],)], "s array<string>")
    got = [r[0] for r in df.select(text.section_of(F.col("s"), ["claim"], [(["delay"], 4)], 200, start=1)).collect()]
    assert got == ["delay and claim claim first, claim again, with words enough to count", "", None, "q r"]
