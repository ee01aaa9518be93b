import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import negatives as N


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 5), st.sampled_from([1, 30, 10**6, 2**40]))
def test_intervals_hold_the_scores(seed, dims, levels, size):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-size, size + 1, (50, dims)), rng.integers(-size, size + 1, dims)
    x[0], x[1] = 0, q
    rows = frame(np.arange(50), np.zeros(50, np.int64), x, levels)
    low, high = N.Block(rows, levels).bounds(N.Asked(q, levels), np.arange(50), lambda lo, hi, at: np.ones(len(at), bool))[1:]
    scores = (x.astype(object) @ q.astype(object)).astype(float)
    order = np.lexsort((np.arange(50), np.zeros(50)))
    assert (low <= scores[order]).all() and (scores[order] <= high).all()


def frame(ids, labels, x, levels, copies=None):
    codes, align, rest = N.coded(x.astype(float), levels)
    return pd.DataFrame({"vec_id": ids, "label": labels, "copies": np.ones(len(ids), np.int64) if copies is None else copies, "vec": [r.astype("<i8").tobytes() for r in x], "codes": [r.tobytes() for r in codes], "align": [r.tobytes() for r in align], "rest": [r.tobytes() for r in rest]})


def test_rotations_keep_lengths_and_products():
    x = np.random.default_rng(1).normal(size=(20, 64))
    y = N.rotated(N.rotated(x, 0), 1)
    assert np.allclose(x @ x.T, y @ y.T)


def test_few_vectors_are_scored():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    block = N.Block(frame(np.arange(8000), rng.integers(0, 10, 8000), x, 4), 4)
    for i in range(20):
        query = block.x[i]
        asked = N.Asked(query, 4)
        best = block.positives(asked, query, int(block.labels[i]), i, 5)
        block.negatives(asked, query, int(block.labels[i]), [N.window_of(s, 30, 90) for _, s, _ in best], 10)
    assert block.scored < 0.25 * 20 * 8000


def brute(rows):
    out = []
    for at, (a, la, x) in enumerate(rows):
        if a % 100:
            continue
        scored = [(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), b, lb == la) for j, (b, lb, y) in enumerate(rows) if j != at and len(x) == len(y)]
        for s, b, _ in sorted((r for r in scored if r[2]), key=lambda r: (-r[0], r[1]))[:5]:
            fits = sorted((r for r in scored if not r[2] and 30 * s <= 100 * r[0] <= 90 * s), key=lambda r: (-r[0], r[1]))[:10]
            out += [(a, b, i + 1, n, s, t) for i, (t, n, _) in enumerate(fits)]
    return [tuple(max(-(2**63), min(2**63 - 1, v)) for v in r) for r in out]


@pytest.mark.parametrize("block", [8192, 60])
def test_equal_to_brute_force(spark, block):
    rng = np.random.default_rng(7)
    good = [(int(i), int(rng.integers(0, 4)), [float(v) for v in rng.normal(size=6)]) for i in range(0, 900, 3)]
    good += [(100, 1, [0.5] * 6)] * 3 + [(i, 2, [0.25] * 6) for i in range(1000, 1030)] + [(7, 1, [0.4] * 6)] * 12
    good += [(200, 3, [1.0, 2.0]), (201, 3, [0.5, 1.0]), (202, 1, [0.25, 0.5]), (300, 1, []), (301, 1, []), (302, 2, []), (400, 1, [9e30] * 3), (401, 1, [9e30] * 3), (402, 2, [3e16] * 3), (500, 3, [0.0] * 6)]
    bad = [(600, None, [1.0] * 6), (700, 1, None), (800, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, 1, [float("nan")] * 6), (900, 1, [float("-inf")] * 6), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame([(i, lab, v, 1) for i, lab, v in good + bad], "vec_id long, label int, embedding array<double>, rank int")
    got = sorted(map(tuple, N.hard_negatives(df, "vec_id % 100 = 0", block=block, at_once=3 if block == 60 else 1024).collect()))
    ints = [(i, lab, [max(-(2**63), min(2**63 - 1, int(np.floor(256 * c)))) for c in v]) for i, lab, v in good]
    assert got == sorted(brute(ints)) and len(got) > 300
    assert N.hard_negatives(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_query_equals_sql(spark, tmp_path):
    rng, path = np.random.default_rng(9), str(tmp_path)
    rows = [(i, int(rng.integers(0, 10)), [float(np.float32(v)) for v in rng.normal(size=16) / 4]) for i in range(1200)]
    rows += [(300, 4, rows[301][2]), (300, 4, rows[301][2]), (14, None, rows[0][2])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    got = N.op13_hard_negatives(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    want = con.sql(N.OP13_SQL)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
