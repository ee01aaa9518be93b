import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import topk as T


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        others = list(rows)
        if (q, x) in others:
            others.remove((q, x))
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), i) for i, y in others if len(x) == len(y))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6))
def test_threshold_search_is_exact(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    x, q, ids = rng.integers(-3, 4, (n, dims)), rng.integers(-3, 4, dims), rng.permutation(n)
    lists = np.argsort(x, axis=0, kind="stable").T
    at, score, depth = T.threshold_search(lists, x, ids, q, k, None)
    assert list(zip(ids[at].tolist(), score.tolist(), strict=True)) == [(i, s) for _, _, i, s in brute(list(zip(ids.tolist(), x.tolist(), strict=True)), [(-1, q.tolist())], k)]
    assert depth <= n


def test_stops_early_on_skewed_scores():
    x = np.arange(2000)[:, None] * np.ones((1, 4), np.int64)
    lists = np.argsort(x, axis=0, kind="stable").T
    assert T.threshold_search(lists, x, np.arange(2000), np.ones(4, np.int64), 5, None)[2] < 100


def test_top_k(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), [float(v) for v in rng.normal(size=4)]) for i in range(150)] + [(200, [0.5] * 4), (201, [0.5] * 4), (202, [0.5] * 4), (300, [0.0] * 4), (203, [9e30] * 4), (5, [1.0, 2.0]), (50, [2.0, 0.0, 1.0, 0.0]), (50, [2.0, 0.0, 1.0, 0.0]), (50, [0.0, 0.25, 1.0, 0.0])]
    bad = [(100, None), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (600, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in T.top_k(df, df.filter("vec_id % 50 = 0"), k=4).collect()]
    rows = [(i, [min(2**63 - 1, int(np.floor(1024 * c))) for c in v]) for i, v in good]
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, [r for r in rows if r[0] % 50 == 0], 4)]
    assert sorted(got) == sorted(want)
    assert T.top_k(df.limit(0), df, k=4).count() == 0
