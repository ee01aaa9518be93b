import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import decontaminate as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.lists(st.integers(0, 5), max_size=60))
def test_lcs(a, b):
    assert D.lcs_length(D.masks_of(a), len(a), b) == plain_lcs(a, b)


def test_find(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(1500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.randint(9, 70)) + ". " + say(5) + ".") for i in range(30)]
    docs, want = [(1000 + i, say(rng.randint(1, 400))) for i in range(150)], set()
    for i, text in items[:20]:
        w = text.split()
        for d, changed in ((i, 0), (100 + i, max(1, len(w) // 12))):
            v = list(w)
            for k in rng.sample(range(len(w)), changed):
                v[k] = rng.choice(words)
            docs.append((d, say(rng.randint(0, 90)) + "\n" + " ".join(v).upper() + " " + say(rng.randint(0, 90))))
            want.add((d, i))
    docs += [(2000, None), (2001, ""), (None, items[3][1]), (2002, "the " * 3000)]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.find(df, bench).collect()}
    found = want & set(got)
    assert len(found) >= 0.9 * len(want) and {k for k in want if k[0] < 100} - found == set()
    assert set(got) - want == {(None, 3)}
    assert D.find(df.limit(0), bench).count() == 0 and D.find(df, bench.limit(0)).count() == 0


def test_singular_vectors(monkeypatch):
    rng = np.random.default_rng(0)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4], 32)) for i in range(200)]
    data = [t.encode() for t in texts]
    t = D.Text(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))

    def total(_, shape, add, rows=0):
        out = np.zeros(shape)
        add(out, t)
        return out

    monkeypatch.setattr(D, "total", total)
    v = np.stack([D.latent_terms(None, rank=4)[0][t.slots[a:b]].sum(0) for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = v @ v.T
    same = np.arange(200)[:, None] % 4 == np.arange(200)[None] % 4
    assert close[same].mean() > 0.9 and abs(close[~same]).mean() < 0.2


def whole_items(items):
    """Items for check() alone."""
    return D.Items(items, (np.ones((1 << D.SLOT_BITS, 1), np.float32), np.ones(1 << D.SLOT_BITS)), 8)


def one_text(text):
    data = text.lower().encode()
    return D.Text(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def test_find_all_that_the_checks_accept(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(1500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.randint(12, 70)) + ". " + say(6) + ".", None) for i in range(60)]
    docs, want = [(10_000 + i, say(rng.randint(1, 300))) for i in range(100)], set()
    block = whole_items(items)
    for i, text, _ in items:
        for share in (10, 20, 30):
            w = text.split()
            for k in rng.sample(range(len(w)), round(len(w) * share / 100)):
                w[k] = rng.choice(words)
            docs.append((100 * share + i, " ".join([say(rng.randint(30, 90)), *w, say(rng.randint(30, 90))])))
            t = one_text(docs[-1][1])
            if D.check(t, block, i, 0, len(t.words), 0.8, 0.6):
                want.add((docs[-1][0], i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x[:2] for x in items], "item_id long, text string")
    assert [sum(d // 1000 == n for d, _ in want) > 5 for n in (1, 2, 3)] == [True] * 3
    assert {(r.doc_id, r.item_id) for r in D.find(df, bench).collect()} == want


@pytest.mark.parametrize("share", [4, 60])
def test_find_reworded_items(spark, share):
    """Items with 65 to 90 % of their words kept; one item stands in a quarter of all documents, or in few."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    say = lambda n: rng.choices(words, weights=[1 / (k + 3) for k in range(len(words))], k=n)
    items = [(i, " ".join(say(34)) + ". " + " ".join(say(6)) + ".", None) for i in range(10)]
    block, docs, want = whole_items(items), [(10_000 + i, " ".join(say(rng.randint(50, 300)))) for i in range(600)], {}
    for kept in (90, 80, 70, 65):
        for i, text, _ in items:
            for k in range(share if i == 0 else 4):
                w = text.split()
                for place in rng.sample(range(34), round(34 * (100 - kept) / 100)):
                    w[place] = rng.choice(words)
                docs.append((len(docs), " ".join([*say(rng.randint(20, 120)), *w, *say(rng.randint(20, 120))])))
                t = one_text(docs[-1][1])
                if D.check(t, block, i, 0, len(t.words), 0.8, 0.6):
                    want.setdefault((kept, i == 0), set()).add((docs[-1][0], i))
    got = {(r.doc_id, r.item_id) for r in D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x[:2] for x in items], "item_id long, text string")).collect()}
    for (kept, hot), pairs in want.items():
        assert len(pairs & got) >= 0.9 * len(pairs), (kept, hot)
    assert {k for k, hot in want if hot} >= {90, 80, 70} and len(want) >= 7


def test_find_short_and_long_items(spark):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    say = lambda n: rng.choices(words, k=n)
    short, long = [say(n) for n in (1, 3, 7)], say(295)
    short[0] = ["zyx"]
    items = [*enumerate(" ".join(w) for w in short), (9, " ".join(long) + ". " + "the answer is plain. " + "indeed so said all.")]
    tail = " ".join(items[3][1].split()[100:])
    docs = [(k, " ".join([*say(40), *w, *say(40)])) for k, w in enumerate(short)] + [(9, " ".join(say(60)) + " " + tail), (20, " ".join([*say(9), *short[2][:6], *say(9)])), (21, " ".join([*say(50), *long[:120], *say(50)]))]
    docs += [(100 + i, " ".join(say(200))) for i in range(50)] + [(None, "zyx"), (1, " ".join(short[1]))]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (2, items[2][1])]], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in D.find(df, bench).collect())
    assert got == [(False, 0, 0), (False, 1, 1), (False, 1, 1), (False, 2, 2), (False, 2, 2), (False, 9, 9), (True, 0, 0)]
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in D.without_items(df, bench).collect())
    assert left == [(False, 20), (False, 21), *((False, 100 + i) for i in range(50))]


def test_anchors_bound():
    rng = np.random.default_rng(0)
    for n in (8, 13, 40):
        own = rng.integers(0, 30, n).astype(np.uint64)
        rare, k = D.anchors(own, rng.integers(1, 9, n), 0.6)
        for _ in range(50):
            kept = rng.choice(n, int(np.ceil(0.6 * n)), replace=False)
            assert np.isin(own[kept], rare).sum() >= k
