"""Hard negatives by rotated one-bit codes with residual intervals and exact scores (operator 13).

An index holds for every vector, at each of a few levels, the signs of its randomly rotated form (one bit a
dimension) and its alignment, which is the inner product with its own sign vector; what the alignment leaves is
orthogonal to the signs and is rotated and coded at the next level. A query's rotated forms are cut
into bit planes, so that popcounts give its inner product with the signs. Alignment times that product is the
estimate; what is left of the vector and the part of the query orthogonal to the signs bound the error by
Cauchy and Schwarz, the planes' rounding adds a known width. These intervals always hold, so vectors whose
interval misses what is asked for go, level by level, and those that remain are scored in whole numbers.

Equal rows are counted first and travel as one. Vectors are dealt into blocks of bounded size and anchors into
groups; the stated anchor set meets every block, a block gives its best rows, the best of them remain.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part;
vectors meet only vectors of their own length; equal scores go by smaller id; of an anchor's own row one copy is left
out, so further rows of its id, and further copies, count, and each copy gives its own results; a
component beyond 64 bits is held at their end, and so is a score that is returned; a positive score of 0 or less has
negatives only where the bounds leave some (at 0: scores of 0); an empty table gives no rows; further columns are not read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table, written
from .topk import scaled

#: Vectors in a block, anchors that meet it in one task, and bits of a query's component.
BLOCK, ANCHORS, PLANES = 8192, 1024, 8
#: More than any score: 64 bits twice, and 2^20 components.
SHIFT = 10**45
INDEX = "vec_id long, label int, copies int, dims int, vec binary, codes binary, align binary, rest binary"


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """Rows of a width that is a power of two, turned by random signs and Hadamard's matrix, twice."""
    n, width = x.shape
    signs = np.random.default_rng(1000 * level + width).integers(0, 2, (2, width)) * 2.0 - 1
    for s in signs:
        x, step = x * s, 1
        while step < width:
            x = x.reshape(n, -1, 2, step)
            x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """As floats, with zeros up to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def coded(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vector, level, word), alignments and lengths of what each level leaves (vector, level)."""
    left, codes, align, rest = padded(x), [], [], []
    for level in range(levels):
        left = rotated(left, level)
        sign = left >= 0
        a = np.abs(left).sum(axis=1) / np.sqrt(left.shape[1])
        left = left - a[:, None] * np.where(sign, 1.0, -1.0) / np.sqrt(left.shape[1])
        codes.append(words(sign))
        align.append(a)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(align, axis=1), np.stack(rest, axis=1)


class Asked:
    """A query's rotated forms as bit planes."""

    def __init__(self, query: np.ndarray, levels: int):
        form, self.planes, self.low, self.step, self.total = padded(query[None, :]), [], [], [], []
        self.width, self.size = form.shape[1], float(np.sqrt((form * form).sum()))
        for level in range(levels):
            form = rotated(form, level)
            low, high = form.min(), form.max()
            step = (high - low) / (2**PLANES - 1) or 1.0
            whole = np.rint((form[0] - low) / step).astype(np.int64)
            self.planes.append(words((whole[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool)))
            self.low.append(low)
            self.step.append(step)
            self.total.append(float(form.sum()))

    def along(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Inner products with the sign vectors (of length 1) of a level, by popcounts."""
        own = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        high = sum(np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j for j, plane in enumerate(self.planes[level]))
        return (2 * (self.low[level] * own + self.step[level] * high) - self.total[level]) / np.sqrt(self.width)


class Block:
    """Coded vectors of one length, by label."""

    def __init__(self, rows: pd.DataFrame, levels: int):
        order = np.lexsort((rows["vec_id"].to_numpy(), rows["label"].to_numpy()))
        at = lambda name, kind: np.frombuffer(b"".join(rows[name].iloc[order]), kind)
        n = len(order)
        self.ids, self.labels, self.copies = (rows[c].to_numpy()[order] for c in ("vec_id", "label", "copies"))
        self.raw = rows["vec"].to_numpy()[order]
        self.x = at("vec", "<i8").reshape(n, -1)
        self.codes = at("codes", "<u8").reshape(n, levels, -1)
        self.align, self.rest = at("align", "<f8").reshape(n, levels), at("rest", "<f8").reshape(n, levels)
        self.levels, self.scored = levels, 0
        self.most = float(np.abs(self.x.astype(float)).max(initial=0))
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))

    def bounds(self, asked: Asked, rows: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose interval `wanted(low, high)` still lets pass after each level, and their intervals."""
        estimate, width = np.zeros(len(rows)), np.zeros(len(rows))
        low, high = estimate, estimate
        for level in range(self.levels):
            along = asked.along(self.codes[rows, level], level)
            a = self.align[rows, level]
            estimate = estimate + a * along
            rounding = asked.step[level] * np.sqrt(asked.width) / 2
            width = width + a * rounding
            # The signs are orthogonal to what is left, so only the query's part beside them counts.
            beside = np.sqrt(np.maximum(0.0, asked.size**2 - np.maximum(0.0, np.abs(along) - rounding) ** 2))
            error = width + self.rest[rows, level] * beside + 1e-9 * self.norm[rows] * asked.size + 1e-6
            low, high = estimate - error, estimate + error
            keep = wanted(low, high, rows)
            rows, estimate, width, low, high = rows[keep], estimate[keep], width[keep], low[keep], high[keep]
        return rows, low, high

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products as whole numbers of any size."""
        self.scored += len(rows)
        if max(1, self.x.shape[1]) * max(1.0, self.most) * max(1.0, float(np.abs(query.astype(float)).max(initial=0))) < 2**62:
            return self.x[rows] @ query
        return self.x[rows].astype(object) @ query.astype(object) if self.x.shape[1] else np.zeros(len(rows), object)

    def own(self, vec_id: int, label: int, raw: bytes) -> int | None:
        return next((i for i in np.flatnonzero((self.ids == vec_id) & (self.labels == label)).tolist() if self.raw[i] == raw), None)

    def positives(self, asked: Asked, query: np.ndarray, label: int, own: int | None, k: int) -> list[tuple[int, int, int]]:
        """row, score, copies of the best rows of the label, k of them where there are so many."""
        copies = self.copies.copy()
        if own is not None:
            copies[own] -= 1
        rows = np.arange(*np.searchsorted(self.labels, [label, label + 1]))
        rows = rows[copies[rows] > 0]

        def wanted(low, high, at):
            return high >= floor_of(low, copies[at], k)

        rows, _, _ = self.bounds(asked, rows, wanted)
        score = self.scores(query, rows)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return [(int(rows[i]), int(score[i]), int(copies[rows[i]])) for i in best]

    def negatives(self, asked: Asked, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int, int]]]:
        """For each window of scores: row, score, copies of the best rows of other labels within it."""
        open_ = [(lo, hi) for lo, hi in windows if lo <= hi]
        if not open_:
            return [[] for _ in windows]
        least, most = min(lo for lo, _ in open_), max(hi for _, hi in open_)
        a, b = np.searchsorted(self.labels, [label, label + 1])
        rows = np.concatenate((np.arange(a), np.arange(b, len(self.labels))))
        rows, low, high = self.bounds(asked, rows, lambda lo, hi, at: (hi >= least) & (lo <= most))
        middle, known, score = (low + high) / 2, np.zeros(len(rows), bool), np.zeros(len(rows), object)
        order, copies = np.argsort(-middle, kind="stable"), self.copies[rows]

        def learn(at):
            new = at[~known[at]]
            score[new], known[new] = self.scores(query, rows[new]), True

        out = []
        for lo, hi in windows:
            if lo > hi:
                out.append([])
                continue
            # The likeliest rows first: what they reach is a floor for the others.
            first = np.searchsorted(-middle[order], -hi)
            learn(order[first : first + 2 * k])
            inside = lambda at: at[[lo <= s <= hi for s in score[at]]]
            got = inside(np.flatnonzero(known))
            floor = max(lo, floor_of(score[got].astype(float), copies[got], k))
            learn(np.flatnonzero((high >= floor) & (low <= hi)))
            got = inside(np.flatnonzero(known))
            best = sorted((-score[i], int(self.ids[rows[i]]), int(rows[i]), int(copies[i])) for i in got.tolist())[:k]
            out.append([(row, -int(s), c) for s, _, row, c in best])
        return out


def floor_of(values: np.ndarray, copies: np.ndarray, k: int) -> float:
    """What the k-th best row has at least, with copies; minus infinity where there are fewer."""
    if copies.sum() < k:
        return -np.inf
    top = np.argpartition(-values, min(k, len(values) - 1))[:k] if len(values) > k else np.arange(len(values))
    top = top[np.argsort(-values[top], kind="stable")]
    return float(values[top][np.searchsorted(np.cumsum(copies[top]), k)])


def held(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def sortable(score: int) -> str:
    """A score of any size as a string whose order is the score's; less SHIFT it is the score again."""
    return f"{score + SHIFT:046d}"


def window_of(positive: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * positive <= 100 * s <= most * positive."""
    return -((-least * positive) // 100), most * positive // 100


def index(vectors: DataFrame, scale: int, levels: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """INDEX: the rows that take part, equal ones as one, with their codes."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    rows = picked(vectors, id_column, vector_column, label_column).toDF("vec_id", "v", "label").filter("label is not null")
    keyed = rows.select(F.struct("vec_id", F.col("label").cast("int").alias("label")).alias("key"), "vec_id", "v").filter("vec_id is not null").select("key", "v")
    rows = scaled(keyed, scale, "key", "v").select("vec_id.vec_id", "vec_id.label", "v").groupBy("vec_id", "label", "v").agg(F.count("*").cast("int").alias("copies"))

    def code(batches):
        for b in batches:
            v = b.column(3)
            flat, size = np.asarray(v.flatten()).astype("<i8"), np.asarray(pa.compute.list_value_length(v))
            start = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                x = flat[start[at][:, None] + np.arange(dims)]
                codes, align, rest = coded(x.astype(float), levels)
                blob = lambda a, kind: pa.array([r.astype(kind).tobytes() for r in a], pa.binary())
                columns = [b.column(i).take(pa.array(at)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), dims), pa.int32()), blob(x, "<i8"), blob(codes, "<u8"), blob(align, "<f8"), blob(rest, "<f8")], names)

    return rows.select("vec_id", "label", "copies", "v").mapInArrow(code, INDEX)


def meeting(rows: DataFrame, anchors: DataFrame, search, schema: str, blocks: int, groups: int) -> DataFrame:
    """Every block of rows with every group of anchors: search(block rows, anchors) gives rows of the schema."""
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = right.toDF(*right.columns)
    keys = ["dims", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def hard_negatives(
    vectors: DataFrame, anchors, k_positive: int = 5, k_negative: int = 10, least: int = 30, most: int = 90, scale: int = 256, levels: int = 4,
    block: int = BLOCK, at_once: int = ANCHORS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: a condition on vec_id.

    Negatives score from `least` to `most` hundredths of the positive.
    """
    rows = written(index(vectors, scale, levels, id_column, vector_column, label_column), "negatives-index")
    asking = rows.filter(anchors).select("vec_id", "label", "copies", "dims", "vec")
    blocks, groups = (max(1, -(-df.count() // n)) for df, n in ((rows, block), (asking, at_once)))

    def near(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(wanted):
            there = Block(found, levels)
            for a in wanted.itertuples():
                query = np.frombuffer(a.vec, "<i8")
                best = there.positives(Asked(query, levels), query, a.label, there.own(a.vec_id, a.label, a.vec), k_positive)
                out += [(a.vec_id, a.label, a.vec, int(there.ids[i]), held(s), sortable(s), min(c, k_positive)) for i, s, c in best]
        return pd.DataFrame(out, columns=["vec_id", "label", "vec", "positive_id", "positive_score", "positive", "n"])

    own = ["vec_id", "label", "vec"]
    found = meeting(rows, asking, near, "vec_id long, label int, vec binary, positive_id long, positive_score long, positive string, n int", blocks, groups)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("positive"), "positive_id")))
    positives = written(found.filter(F.col("place") <= k_positive).select(*own, "place", "positive_id", "positive_score", "positive"), "negatives-positives")
    # The few positives of an anchor, at most k_positive.
    scores = positives.groupBy(*own).agg(F.collect_set("positive").alias("positives"))

    def mine(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(wanted):
            there = Block(found, levels)
            for a in wanted.itertuples():
                query = np.frombuffer(a.vec, "<i8")
                each = there.negatives(Asked(query, levels), query, a.label, [window_of(int(p) - SHIFT, least, most) for p in a.positives], k_negative)
                out += [(a.vec_id, a.label, a.vec, p, int(there.ids[i]), held(s), sortable(s), min(c, k_negative)) for p, best in zip(a.positives, each, strict=True) for i, s, c in best]
        return pd.DataFrame(out, columns=["vec_id", "label", "vec", "positive", "negative_id", "negative_score", "negative", "n"])

    found = meeting(rows, asking.drop("copies").join(scores, own), mine, "vec_id long, label int, vec binary, positive string, negative_id long, negative_score long, negative string, n int", blocks, groups)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).withColumn("rank", F.row_number().over(Window.partitionBy(*own, "positive").orderBy(F.desc("negative"), "negative_id")))
    # An anchor's copies each give their own results.
    copies = asking.select(*own, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    out = found.filter(F.col("rank") <= k_negative).drop("copy", "n").join(positives, [*own, "positive"]).join(copies, own)
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of the embeddings whose vec_id is divisible by 100, against all others; every seventh label is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, "vec_id % 100 = 0")


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
      FROM v a JOIN v c ON a.row <> c.row AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT row, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY row, place ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (row) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
