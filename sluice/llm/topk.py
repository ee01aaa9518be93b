"""Exact top k by inner product with Fagin's threshold algorithm (operator 10).

Vectors are dealt into blocks of bounded size. A block keeps, for every dimension, its vectors
sorted by that component. A query walks all lists at once, each from the end that its sign prefers,
scores what it has not seen, and stops when the sum of the best scores that the lists can still
offer is below its k-th score (it goes on while they are equal, since ties count). The
stated query set meets every block; blocks give k rows a query, and the k best of them remain.

Components are scaled to integers floor(scale * x), so that scores are exact; a component or
score beyond 64 bits is held at their end. Defined cases: vectors null, or with a null or non-finite component, take no
part; vectors meet only vectors of their own length; equal scores go by smaller vec_id, a null
vec_id takes no part; a query's own row is left out, which is one row of its vec_id and its vector, so
that further rows of its vec_id, and further copies of it, count; query rows of one vec_id each give
their own k results; an empty table gives no rows; further columns are not read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table

#: Vectors in a block, and queries that meet it in one task.
BLOCK, QUERIES_AT_ONCE = 4096, 2048


def threshold_search(lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best (own: a position to leave out), and the depth that was reached.

    lists: for each dimension, the positions of the vectors from the smallest component up.
    """
    n, dims = vectors.shape
    use = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    if own is not None:
        seen[own] = True
    at, score = np.zeros(0, np.int64), np.zeros(0, query.dtype)
    depth, step = 0, max(4, -(-2 * k // max(1, len(use))))
    while depth < n:
        to = min(n, depth + step)
        rows = np.concatenate([lists[d, n - to : n - depth] if query[d] > 0 else lists[d, depth:to] for d in use]) if len(use) else np.arange(n)
        rows = np.unique(rows)
        rows = rows[~seen[rows]]
        seen[rows] = True
        at, score = np.concatenate((at, rows)), np.concatenate((score, vectors[rows] @ query))
        best = np.lexsort((ids[at], -score))[:k]
        at, score = at[best], score[best]
        depth, step = to, step * 2
        if not len(use):
            return at, score, n
        edge = [vectors[lists[d, n - to if query[d] > 0 else to - 1], d] for d in use]
        if len(at) == k and sum(int(a) * int(b) for a, b in zip(edge, query[use], strict=True)) < int(score[-1]):
            break
    return at, score, depth


def scaled(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v: components as integers; rows that take no part are left out."""
    rows = picked(vectors, id_column, vector_column).toDF("vec_id", "v").filter("vec_id is not null and v is not null")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return rows.filter(finite).select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors but itself."""
    rows, asked = scaled(vectors, scale, id_column, vector_column), scaled(queries, scale, id_column, vector_column)
    # Equal queries are asked once; `query` tells those of one vec_id apart.
    asked = asked.groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("copies")).withColumn("query", F.md5(F.to_json(F.struct("v"))))
    blocks, groups = (max(1, -(-df.count() // most)) for df, most in ((rows, BLOCK), (asked, QUERIES_AT_ONCE)))
    # A block meets a group of queries in one task: dealt by hash, each side sent to as many blocks as the other has.
    left = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = asked.select("vec_id", "query", "copies", "v", F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"))

    def search(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(wanted):
            x, q = np.stack(block["v"].to_numpy()), np.stack(wanted["v"].to_numpy())
            if x.shape[1] * max(1, float(np.abs(x.astype(float)).max(initial=0))) * max(1, float(np.abs(q.astype(float)).max(initial=0))) >= 2**63:
                x, q = x.astype(object), q.astype(object)  # integers of any size
            ids, lists = block["vec_id"].to_numpy(), np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
            for asks, name, copies, query in zip(wanted["vec_id"].tolist(), wanted["query"], wanted["copies"].tolist(), q, strict=True):
                own = next((i for i in np.flatnonzero(ids == asks).tolist() if (x[i] == query).all()), None)
                at, score, _ = threshold_search(lists, x, ids, query, k, own)
                out.append(pd.DataFrame({"query_id": asks, "query": name, "copies": copies, "vec_id": ids[at], "score": [max(-(2**63), min(2**63 - 1, int(s))) for s in score]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query": [], "copies": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query": "str", "copies": "int32", "vec_id": "int64", "score": "int64"})

    keys = ["dims", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, query string, copies int, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each embedding whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
