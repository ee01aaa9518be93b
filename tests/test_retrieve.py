import numpy as np
import pytest

from sluice.operators import retrieve


def brute(left, right, k, group=False):
    out = []
    for q, s, _ in left:
        scored = {}
        for m, t, g in right:
            both = len(set(s) & set(t))
            if m != q and both:
                scored.setdefault(g if group else 0, []).append((-round(both / (len(set(s)) + len(set(t)) - both) + 1e-15, 6), m))
        out += [(q, g, m, -x, i + 1) for g, rows in scored.items() for i, (x, m) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def made(n, seed, own):
    """Rows with words of every frequency, one in all rows, and some words of their own."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = {f"w{int(w)}" for w in rng.zipf(1.3, int(rng.integers(1, 9))) if w < 500} | {"all"} | ({f"own{i}"} if rng.random() < own else set())
        rows.append((i, sorted(words), int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("cap,own", [(1000, 0.5), (5, 0.9), (1, 0.2)])
def test_nearest_equals_brute_force(spark, cap, own):
    rows = made(180, cap, own)
    df = spark.createDataFrame(rows, "id long, items array<string>, g int").repartition(3)
    got = sorted((r["query"], 0, r["match"], r["similarity"], r["rank"]) for r in retrieve.nearest_by_items(df, df, "id", "items", 4, cap=cap).collect())
    assert got == brute(rows, rows, 4)
    if cap == 5:
        got = sorted((r["query"], r["g"], r["match"], r["similarity"], r["rank"]) for r in retrieve.nearest_by_items(df, df, "id", "items", 2, "g", cap).collect())
        assert got == brute(rows, rows, 2, True)


def test_an_item_in_all_rows_makes_no_quadratic_list(spark):
    """20,000 rows that share one item and nothing else: the pairs that are met grow with classes, not rows."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "array('all', concat('own', id)) as items")
    got = retrieve.nearest_by_items(df, df, "id", "items", 3, cap=100)
    rows = {}
    for r in got.filter("query in (0, 7, 19999)").collect():
        rows.setdefault(r["query"], []).append((r["rank"], r["match"], r["similarity"]))
    third = round(1 / 3, 6)
    assert {q: sorted(x) for q, x in rows.items()} == {0: [(1, 1, third), (2, 2, third), (3, 3, third)], 7: [(1, 0, third), (2, 1, third), (3, 2, third)], 19999: [(1, 0, third), (2, 1, third), (3, 2, third)]}
    assert got.count() == 3 * n


@pytest.mark.parametrize("least", [0.1, 0.35, 0.8])
def test_pairs_above_a_bar(spark, least):
    rows = made(120, 9, 0.4) + [(500, [], 0), (501, None, 0), (None, ["all"], 0)]
    df = spark.createDataFrame(rows, "id long, items array<string>, g int")
    got = sorted(map(tuple, retrieve.pairs_above(df, df, "id", "items", least).collect()))
    real = [r for r in rows[:120]]
    want = sorted((q, m, round(len(set(s) & set(t)) / len(set(s) | set(t)) + 1e-15, 6)) for q, s, _ in real for m, t, _ in real if q != m and round(len(set(s) & set(t)) / len(set(s) | set(t)) + 1e-15, 6) >= least)
    assert got == want
    assert retrieve.nearest_by_items(df.limit(0), df, "id", "items", 2).count() == 0 and retrieve.nearest_by_items(df, df.limit(0), "id", "items", 2).count() == 0
