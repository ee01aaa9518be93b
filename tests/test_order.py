import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import order, preprocess


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 10 else "b", float(np.round(rng.random(), 2)), int(rng.random() < 0.4)) for i in range(3000)]
    return rows, spark.createDataFrame([*rows, (5000, None, 0.5, 1), (5001, None, 0.25, 0)], "id long, g string, s double, y int")


def single_exchange(df) -> bool:
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(scores, parts):
    rows, df = scores
    got = {r["id"]: r["n"] for r in order.running(df, ["g"], [F.col("s"), F.col("id")], {"n": F.lit(1)}, parts).collect()}
    for g in ("a", "b"):
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            assert got[r[0]] == n + 1
    assert (got[5001], got[5000]) == (1, 2)


def test_quantiles_equal_numpy(scores):
    rows, df = scores
    at = [0.0, 0.1, 0.333, 0.5, 0.97, 1.0]
    made = order.quantiles(df, "s", at, ["g"])
    got = {(r["g"], r["q"]): r["value"] for r in made.collect()}
    for g in ("a", "b"):
        assert np.allclose([got[g, i] for i in range(6)], np.quantile([r[2] for r in rows if r[1] == g], at), atol=1e-12)
    assert got[None, 3] == 0.375 and not single_exchange(made)
    assert order.quantiles(df.limit(0), "s", at).count() == 0


def test_area_and_prefix(scores):
    rows, df = scores
    for g, got in ((r["g"], r["auc"]) for r in order.auc(df, F.col("y"), F.col("s"), ["g"]).collect()):
        one, zero = (np.array([r[2] for r in rows if r[1] == g and r[3] == y]) for y in (1, 0))
        if g:
            assert abs(got - ((one[:, None] > zero).mean() + (one[:, None] == zero).mean() / 2)) < 1e-12
        else:
            assert got == 1.0
    assert order.auc(df.filter("y = 1"), F.col("y"), F.col("s")).first()["auc"] is None
    made = order.longest_prefix(df, ["g"], [F.desc("s"), F.col("id")], F.col("y") == 1, 0.42, 5)
    for g, n in ((r["g"], r["n"]) for r in made.collect()):
        y = np.array([r[3] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))])
        assert g is None or n == np.flatnonzero(np.cumsum(y) / np.arange(1, len(y) + 1) >= 0.42).max() + 1
    assert not single_exchange(made)


def test_preprocessor_equals_numpy(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 3))
    x = np.column_stack((base, base[:, 0] * 2 + rng.normal(size=400) * 0.1, base @ [1, 1, 1], np.full(400, 3.0)))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[5, 1], x[6, 2] = np.inf, -np.inf
    names = ["a", "b", "c", "d", "e", "const"]
    df = spark.createDataFrame([(i, i % 4, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, fold int, " + ", ".join(f"{n} double" for n in names))
    df = df.withColumn("none", F.lit(None).cast("double"))
    got = preprocess.by_fold(df, [*names, "none"], "fold", [0, 1, 2, 3])
    rows = {r["id"]: r for r in got.collect()}
    x = np.column_stack((np.where(np.isinf(x), np.nan, x), np.full(400, np.nan)))
    for k in range(4):
        own, train = np.arange(400) % 4 == k, np.arange(400) % 4 != k
        pick = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]  # noqa: E731  the sketch is exact for so few rows
        fill = [pick(v[~np.isnan(v)], 0.5) if (~np.isnan(v)).any() else 0.0 for v in x[train].T]
        full = np.where(np.isnan(x), fill, x)
        clip = np.clip(full, [pick(v, 0.005) for v in full[train].T], [pick(v, 0.995) for v in full[train].T])
        std = clip[train].std(axis=0)
        z = (clip - clip[train].mean(axis=0)) / np.where(std > 1e-12, std, 1)
        values, vectors = np.linalg.eigh(z[train].T @ z[train] / train.sum())
        share = np.cumsum(values[::-1]) / values.sum()
        keep = max(2, int(np.searchsorted(share, 0.95) + 1))
        for i in np.flatnonzero(own)[:40]:
            r = rows[int(i)]
            assert np.allclose([r[c] for c in [*names, "none"]], clip[i])
            assert np.allclose(np.abs([r[f"pca_{j + 1}"] for j in range(keep)]), np.abs(z[i] @ vectors[:, ::-1][:, :keep]), atol=1e-8)
    assert got.filter("pca_2 is null").isEmpty() and preprocess.by_fold(df.limit(0), ["a", "b"], "fold", [0, 1]).count() == 0


def test_blend_areas_hold_their_bounds(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(700) < 0.3).astype(int)
    p = np.clip(np.stack([y * s + rng.normal(size=700) * 0.3 + 0.3 for s in (0.1, 0.3, 0.05)], axis=1), 0, 1)
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, p, strict=True)] + [(None, 0.1, 0.1, 0.1), (1, None, 0.1, 0.1)], "y int, a double, b double, c double")
    weights = np.vstack((np.ones(3), rng.dirichlet(np.ones(3), 40)))

    def exact(w):
        s = np.round(p @ w / w.sum(), 9)
        gaps = s[y == 1][:, None] - s[y == 0]
        return (gaps > 0).mean() + (gaps == 0).mean() / 2

    want = [exact(w) for w in weights]
    for r in preprocess.blend_areas(df, "y", ["a", "b", "c"], weights, bins=64).collect():
        assert abs(r["auc"] - want[r["candidate"]]) <= r["bound"] + 1e-9
    got = preprocess.blend(df, "y", ["a", "b", "c"], weights, bins=64).first()
    assert got["candidate"] == int(np.argmax(np.round(want, 9))) and abs(got["auc"] - max(want)) < 1e-8
    assert preprocess.blend(df.limit(0), "y", ["a", "b", "c"], weights).count() == 0
