import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import divergence as D


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 300), st.sampled_from([0.0, 0.01, 0.2, 0.9]))
def test_trees_give_the_distances_of_the_full_matrix(seed, groups, columns, density):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 10**6, groups)
    full = np.repeat(base[:, None], columns, 1)
    row, col = np.nonzero(rng.random((groups, columns)) < density)
    value = rng.integers(1, 10**9, len(row))
    full[row, col] = value
    got = D.compared(0, 0, pd.DataFrame({"gid": np.arange(groups), "base": base}), pd.DataFrame({"gid": row, "col": col, "p": value}), columns)
    want = {(i, j): int(np.abs(full[i] - full[j]).sum()) for i in range(groups) for j in range(i + 1, groups)}
    assert {(a, b): v for a, b, v in got.itertuples(index=False)} == want


def test_pairs_between_two_ranges():
    rng = np.random.default_rng(1)
    base, full = rng.integers(1, 99, 29), np.zeros((29, 70), np.int64)
    full[:] = base[:, None]
    row, col = np.nonzero(rng.random((29, 70)) < 0.05)
    full[row, col] = value = rng.integers(1, 10**6, len(row))
    got = D.compared(0, 1, pd.DataFrame({"gid": np.arange(29), "base": base}), pd.DataFrame({"gid": row, "col": col, "p": value}), 70, 16)
    assert {(a, b): v for a, b, v in got.itertuples(index=False)} == {(i, j): int(np.abs(full[i] - full[j]).sum()) for i in range(16) for j in range(16, 29)}


def test_all_zero_quadrants_are_priced_not_visited(monkeypatch):
    seen, cells = [], D.Quadtree.cells
    monkeypatch.setattr(D.Quadtree, "cells", lambda self, leaf, tile: (seen.append(len(leaf)), cells(self, leaf, tile))[1])
    groups = pd.DataFrame({"gid": np.arange(400), "base": np.arange(400) + 1})
    entries = pd.DataFrame({"gid": np.arange(8), "col": np.arange(8), "p": np.full(8, 1000)})
    D.compared(0, 0, groups, entries, 50_000)
    assert sum(seen) / 2 < 200  # of 1,275 pairs of tiles by 1,563 tiles of columns


WORDS = ["Étude", "the", "THE", "été", "a_b", "x1y2", "naïve", "日本", "q", "zebra"]


def corpus(spark, path):
    rng = np.random.default_rng(4)
    weights = rng.dirichlet(np.ones(len(WORDS)), 5)
    rows = []
    for i in range(400):
        s = int(rng.integers(0, 5)) if rng.random() < 0.6 else 0
        rows.append((i, " ".join(rng.choice(WORDS, int(rng.integers(0, 12)), p=weights[s])), ["en", "de", None][i % 3], None if s == 4 else f"s{s}", 0, i))
    rows += [(500, None, "en", "silent", 0, 1), (501, "", "xx", "one", 0, 1), (502, "rare words", "xx", "two", 0, 1), (502, "rare words", "xx", "two", 0, 1), (503, "12 34 --", "yy", "alone", 0, 1), (None, "the the", None, "s0", 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, term int").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_sql(spark, tmp_path, small):
    path = str(tmp_path)
    corpus(spark, path)
    got = D.op12_source_divergence(spark, path)
    if small:  # many blocks and ranges
        got = D.audit(spark.read.parquet(f"{path}/documents.parquet"), in_range=2, entries=8)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.sql(D.OP12_SQL)
    assert want.columns == got.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 50
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert D.audit(empty).count() == 0


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 100)
    text = "one two. " * 5000 + "x" * 1000 + " One"
    assert sum(len(D.TERM.findall(p)) for p in D.slices(text.lower().encode())) == 10_002
    df = spark.createDataFrame([("en", "a", text)], "lang string, source string, text string")
    got = {r["term"]: (r["n"], r["docs"]) for r in D.term_counts(df).collect()}
    assert got == {None: (0, 1), "one": (5001, 1), "two": (5000, 1), "x" * 1000: (1, 1)}


def test_counts_beyond_64_bits_of_product(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**12 + 7, 3 * 10**13 + 1, 1000)], "n long, t long, v long")
    got = df.select(D.frequency(F.col("n"), F.col("t"), F.col("v"), 10**9, 5)).first()[0]
    assert got == 1 + 10**9 * (10**12 + 12) // (3 * 10**13 + 1 + 5000)
