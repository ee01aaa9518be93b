import random
import re

import numpy as np
import pyarrow as pa

from sluice.llm import jaccard as J
from sluice.llm.shingles import shingle_sets


def brute(rows, width, num, den):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(d, shingles(t)) for d, t in rows]
    at = {d: d for d, _ in sets if d is not None}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                at[hi] = lo
    return sorted((d is None, d or 0, len(s), None if d is None else root(d)) for d, s in sets)


def corpus(seed):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(60)]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 9, 12, 21, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                text[rng.choice([0, -1, rng.randrange(len(text))])] = rng.choice(words)
            rows.append((" " if rng.random() < 0.5 else "\n\t").join(text).upper() if rng.random() < 0.2 else " ".join(text))
    common = rng.choices(words, k=30)
    rows += [" ".join(rng.choices(words, k=25) + common) for _ in range(10)]
    rng.shuffle(rows)
    return [*enumerate(rows), (500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "one two"), (None, "one"), (None, None)]


def test_join_equals_brute_force(spark):
    for seed, (width, num, den) in enumerate([(3, 90, 100), (5, 80, 100)]):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, key string")
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.join(df, width, num, den).collect())
        assert got == brute(rows, width, num, den)
    assert J.join(df.limit(0)).count() == 0


def test_small_sets_list_a_common_subset():
    counts = np.zeros(1 << J.COUNTER_BITS, np.int64)
    raw = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    a, b = (shingle_sets(*raw(" ".join(map(str, r))), 3)[0] for r in (range(30), range(1, 31)))
    assert len(np.intersect1d(a, b)) * 100 >= 90 * len(np.union1d(a, b))
    for x in (60, 1):
        assert set(J.keys_of(a, counts, 0, x, 90, 100)[0]) & set(J.keys_of(b, counts, 0, x, 90, 100)[0])


def test_boundary_follows_cost():
    assert J.boundary({12: 10}, 1.0, 90, 100) <= 12 < J.boundary({12: 10}, 50.0, 90, 100)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 40, 700):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.unique(np.concatenate((x[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64))))
        x = np.unique(x)
        assert sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(J.parity(x).view(np.uint64), J.parity(y).view(np.uint64), strict=True)) <= len(np.setxor1d(x, y))


def by_matrix(sets, num, den):
    """Component of each set, from all overlaps at once."""
    words = {w: k for k, w in enumerate(sorted({w for s in sets for w in s}))}
    known = [w for w in words if sum(w in s for s in sets[:50]) > 1] or list(words)
    shared = {w: k for k, w in enumerate(known)}  # the tests' other words stand in one set each
    x = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        x[i, [shared[w] for w in s if w in shared]] = 1
    n, both = np.array([len(s) for s in sets]), x @ x.T
    linked = den * both >= num * (n[:, None] + n[None] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        least = np.array([label[row].min() for row in linked])
        if (least == label).all():
            return label
        label = least


def components_of(spark, sets, num, den):
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string")
    return [r.component_id for r in J.join(df, 1, num, den).orderBy("doc_id").collect()]


def test_near_copies_that_resemble_only_their_centre(spark):
    rng = random.Random(5)
    centre, sets = [f"c{i:03d}" for i in range(100)], []
    for i in range(3000):
        text = list(centre)
        for k, p in enumerate(rng.sample(range(100), rng.choice([3, 4, 5, 6, 7]))):
            text[p] = f"own{i}x{k}"
        sets.append(set(text))
    want = by_matrix(sets, 90, 100)
    got = components_of(spark, sets, 90, 100)
    assert got == want.tolist() and 50 < len(set(got)) < 3000


def test_lists_longer_than_a_chain(spark):
    rng = random.Random(6)
    words = [f"hot{i:02d}" for i in range(40)]
    sets = [set(rng.sample(words, 30)) for _ in range(2300)]
    counts = np.full(1 << J.COUNTER_BITS, 0, np.int64)
    assert min(sum(w in s for s in sets) for w in words) > J.CHAIN
    counts[:] = 2 * J.CHAIN
    assert J.keys_of(np.arange(30, dtype=np.uint64), counts, 0, 1, 80, 100)[1].min() > 1
    assert components_of(spark, sets, 80, 100) == by_matrix(sets, 80, 100).tolist()


def test_joining_leaves_no_component_alone():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(60, 46, replace=False)).astype(np.uint64) for _ in range(60)]
    bits, n = np.stack([J.parity(s) for s in sets]).view(np.uint64), np.array([len(s) for s in sets])
    side = (np.arange(60) % 2).astype(np.int32)
    for sides in (side, np.zeros(60, np.int32)):
        every = J.joining(np.arange(60), n, np.arange(60), bits, sides, 60, 100, True)
        few = J.joining(np.arange(60), n, np.arange(60), bits, sides, 60, 100, False)
        near = {(a, b) for a in range(60) for b in range(a) if sides[a] != sides[b] or not sides.any() if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
        assert near and near <= {(b, a) for a, b in every.tolist()} and len(few) < 60
        assert {tuple(x) for x in few.tolist()} <= {tuple(x) for x in every.tolist()}


def test_tallies_bound_what_one_set_alone_has(spark):
    rng = np.random.default_rng(5)
    for n, m in [(1001, 1100), (1500, 6000), (5000, 5200), (40_000, 41_000)]:
        pool = rng.integers(0, 2**63, 2 * n + m, dtype=np.uint64)
        for shared in (0, n // 2, n):
            a, b = pool[:n], np.concatenate([pool[n - shared : n], pool[n : n + m - shared]])
            alone = len(np.setxor1d(a, b))
            least = J.apart_at_least(J.tally(a), J.tally(b))
            assert least <= alone and (n > m - 300 or least >= m - n)
            if not shared and n > m - 1100:
                assert least * 190 > (n + m) * 10  # so much that sets without common shingles are told apart
    assert J.apart_at_least(J.tally(pool[:40_000]), J.tally(pool[:40_000])) == 0


def test_large_texts_with_a_common_passage(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(300)]
    texts = []
    for k in range(12):
        base = passage + [f"w{rng.randrange(10**6)}" for _ in range(5000 + 20 * k)]
        texts.append(base)
        if k % 3 == 0:
            near = list(base)
            for i in rng.sample(range(len(near)), 60):
                near[i] = "other"
            texts.append(near)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, num, den in [(3, 90, 100), (5, 80, 100)]:
        got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in J.join(df, width, num, den).collect())
        assert got == brute(rows, width, num, den)


def test_filters_take_one_python_function_in_a_stage(spark, monkeypatch):
    """Two in a stage double the workers of an executor, which all stay in memory and get the counters of shingles."""
    plans, made = [], J.key_filter

    def noted(keys, *rest):
        plans.append(keys._jdf.queryExecution().executedPlan().toString())
        return made(keys, *rest)

    monkeypatch.setattr(J, "key_filter", noted)
    docs = spark.createDataFrame([(d, "x") for d in range(3000)], "doc_id long, text string")
    members = docs.selectExpr("doc_id", "doc_id - doc_id % 3 as class_id")
    _, standing = J.one_of_each(docs, members.select("class_id").distinct(), members)
    stands = standing(pa.array([*range(3000), None], pa.int64()))
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
    assert stands[:3000:3].all() and not stands[3000]
    assert stands[:3000].sum() < 1050  # a copy passes now and then
    firsts = np.arange(0, 3000, 3)
    of = spark.createDataFrame([(int(k),) for k in firsts], "k long")
    third = made(of.filter("k < 900"), 300)
    assert (made(of, 1000, third) == made(of.filter("k < 900"), 1000)).mean() > 0.999
    assert made(of, 1000, np.zeros_like(third)).sum() == 0
