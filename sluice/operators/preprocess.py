"""Fill, clip, standardise and rotate numeric columns by the figures of a training part (2-L), and blends of scores."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import auc


def _number(name: str) -> Column:
    """A column as a double; infinite values and NaN are missing."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


@dataclass
class Preprocessor:
    """Figures of a training part: medians, quantile bounds, means, deviations and principal axes; all of the size of the columns, not of the rows."""

    columns: list[str]
    fill: list[float]
    low: list[float]
    high: list[float]
    mean: list[float]
    std: list[float]
    axes: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995, explained: float = 0.95, most: int = 12, accuracy: int = 100_000) -> "Preprocessor":
        """Quantiles by a sketch that merges: the value returned has a rank within rows / accuracy of the one asked for.

        A column without values is filled with 0. Axes are those of the correlations, as many as explain the given
        share (2 at least, `most` at most), none for fewer than two columns.
        """
        n = len(columns)
        first = df.agg(*[F.percentile_approx(_number(c), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        fill = [float(first[f"m{i}"] or 0.0) for i in range(n)]
        filled = [F.coalesce(_number(c), F.lit(v)) for c, v in zip(columns, fill, strict=True)]
        ends = df.agg(*[F.percentile_approx(x, [low, high], accuracy).alias(f"q{i}") for i, x in enumerate(filled)]).first()
        bounds = [ends[f"q{i}"] or [0.0, 0.0] for i in range(n)]
        made = cls(columns, fill, [b[0] for b in bounds], [b[1] for b in bounds], [0.0] * n, [1.0] * n, np.zeros((0, n)))
        if n < 2 or ends is None or not all(ends[f"q{i}"] for i in range(n)):
            return made
        rows = df.select(array_to_vector(F.array(*made.clipped())).alias("x"))
        figures = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")).first()["s"]
        size = figures["count"]
        std = np.sqrt(figures["variance"].toArray() * (size - 1) / size)
        made.mean, made.std = figures["mean"].toArray().tolist(), np.where(std > 0, std, 1.0).tolist()
        gram = Correlation.corr(rows, "x").first()[0].toArray() if size > 1 else np.zeros((n, n))
        gram = np.where(np.isfinite(gram), gram, 0.0)
        gram[std == 0] = gram[:, std == 0] = 0.0
        values, vectors = np.linalg.eigh(gram)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
        share = np.cumsum(values[: min(most, n)]) / max(values.sum(), 1e-300)
        keep = max(2, min(int(np.searchsorted(share, explained) + 1), most, n))
        # An axis and its opposite are the same: the entry of largest size is positive.
        axes = vectors[:keep]
        made.axes = axes * np.where(axes[np.arange(keep), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        return made

    def clipped(self) -> list[Column]:
        return [F.least(F.greatest(F.coalesce(_number(c), F.lit(f)), F.lit(a)), F.lit(b)) for c, f, a, b in zip(self.columns, self.fill, self.low, self.high, strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its columns filled and clipped, and pca_1, pca_2 ... beside them."""
        out = df.withColumns({c: x for c, x in zip(self.columns, self.clipped(), strict=True)})
        scaled = [(F.col(f"`{c}`") - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)]
        return out.withColumns({f"pca_{k + 1}": sum((x * float(a) for x, a in zip(scaled[1:], axis[1:], strict=True)), scaled[0] * float(axis[0])) for k, axis in enumerate(self.axes)})


def by_fold(df: DataFrame, columns: list[str], fold: str, folds: list[int], **how) -> DataFrame:
    """Each fold's rows as the figures of the other folds make them. Folds may keep different numbers of axes: further ones are null."""
    out = None
    for k in folds:
        one = Preprocessor.fit(df.filter(F.col(fold) != k), columns, **how).transform(df.filter(F.col(fold) == k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return df.limit(0) if out is None else out


def blend_areas(df: DataFrame, label: str, models: list[str], weights: np.ndarray, bins: int = 4096) -> DataFrame:
    """candidate, auc, bound for each row of weights, in one pass: blended scores of 0 to 1 are counted by bins.

    Counts of tasks add up, so that nothing but (candidates x bins) counts is shuffled. Pairs within a bin
    count half; `bound` is half their share, which is what the area can be off by.
    """
    share = np.asarray(weights, float) / np.asarray(weights, float).sum(axis=1, keepdims=True)

    def count(batches):
        sums = np.zeros((len(share), bins, 2), np.int64)
        for b in batches:
            y = np.asarray(b.column(0)).astype(np.int64)
            scores = np.stack([np.asarray(b.column(i + 1)) for i in range(len(models))], axis=1)
            for k in range(0, len(y), 1 << 12):
                at = np.clip((scores[k : k + (1 << 12)] @ share.T * bins).astype(np.int64), 0, bins - 1)
                for i in range(len(share)):
                    sums[i] += np.bincount(at[:, i] * 2 + y[k : k + (1 << 12)], minlength=2 * bins).reshape(bins, 2)
        i, j = np.nonzero(sums.sum(axis=2))
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums[a, b, 1]), pa.array(sums[a, b, 0])], ["candidate", "bin", "p", "q"])

    rows = df.select(F.col(label).cast("int").alias("y"), *[F.col(m).cast("double").alias(m) for m in models]).dropna()
    cells = rows.mapInArrow(count, "candidate long, bin long, p long, q long").groupBy("candidate", "bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # A row for each bin, in an array of bounded size.
    each = cells.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("bin", "p", "q"))).alias("cells"), F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    state = F.struct(F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("wins"), F.lit(0.0).alias("ties"))
    step = lambda s, x: F.struct((s["below"] + x["q"]).alias("below"), (s["wins"] + x["p"] * (s["below"] + x["q"] / 2)).alias("wins"), (s["ties"] + x["p"] * x["q"] / 2).alias("ties"))
    walked = each.withColumn("w", F.aggregate("cells", state, step))
    pairs = F.col("ps") * F.col("qs")
    return walked.select("candidate", F.try_divide("w.wins", pairs).alias("auc"), F.try_divide("w.ties", pairs).alias("bound"))


def blend(df: DataFrame, label: str, models: list[str], weights: np.ndarray, bins: int = 4096) -> DataFrame:
    """candidate, auc of the weights with the largest area: candidates that their bounds leave are measured exactly, ties go to the earlier one.

    The candidates are given, a row each reaches the driver.
    """
    areas = [r for r in blend_areas(df, label, models, weights, bins).collect() if r["auc"] is not None]
    best = max((r["auc"] - r["bound"] for r in areas), default=0.0)
    left = sorted(r["candidate"] for r in areas if r["auc"] + r["bound"] >= best - 1e-12)
    total = np.asarray(weights, float).sum(axis=1)
    score = lambda c: sum((F.col(m).cast("double") * float(w) for m, w in zip(models[1:], weights[c][1:], strict=True)), F.col(models[0]).cast("double") * float(weights[c][0])) / float(total[c])
    scored = F.array(*[F.struct(F.lit(int(c)).alias("candidate"), score(c).alias("s")) for c in left]) if left else F.array().cast("array<struct<candidate:int,s:double>>")
    rows = df.select(F.col(label).cast("int").alias("y"), *models).dropna().select("y", F.inline(scored))
    exact = auc(rows, F.col("y"), F.col("s"), ["candidate"]).select("candidate", F.round("auc", 9).alias("auc"))
    return exact.agg(F.max_by(F.struct("candidate", "auc"), F.struct("auc", -F.col("candidate"))).alias("b")).filter("b is not null").select("b.*")
