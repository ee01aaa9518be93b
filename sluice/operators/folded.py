"""Text classifiers out of fold: one table of counts for all folds and models, fits side by side (2-K).

Grams are hashed into a fixed width, so the counts of a text do not depend on the training part; what does
(document frequencies, means, class weights) is summed by fold in one pass, and a training part's
figures are the total less those of the folds that it leaves out. A model that leaves out folds j and k
scores rows of j for the outer fold k and rows of k for the outer fold j, so that nested predictions of five
folds take ten fits more, not twenty.

Defined cases: rows without id, fold or a known label are left out, a null text is empty, null numbers are 0;
a class or a fold without rows is allowed; an empty table has no folds, so nothing is fitted and no rows come back.
"""

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from .fuse import argmax, normalised
from .labels import OUTCOMES
from .sets import _stored

#: Slots that grams are hashed into, and documents that a slot must be in.
WIDTH, LEAST_DF = 1 << 17, 2
#: Bytes of features that fits side by side may hold in the executors' storage; beyond it they follow one another.
HELD = 4 << 30
MODELS = ("word_logistic", "char_logistic", "char_bayes", "char_svm", "hybrid_logistic")
#: Columns of predictions.
LONG = ("id", "fold", "outer", "model_name", "y_true", "probs", "margins")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def word_grams(text: Column) -> Column:
    """Lower-case words and pairs of neighbours."""

    def both(words: Column) -> Column:
        pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
        return F.concat(words, pairs)

    return T.once(words_of(text), both)


def flat(text: Column) -> Column:
    """The text in lower case with single spaces."""
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """All runs of `low` to `high` characters of the flat text, in time linear in its length."""
    return F.concat(*[F.regexp_extract_all(flat(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)])


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)


def gram_counts(text: bytes, width: int, low: int = 2, high: int = 5, block: int = 1 << 16) -> np.ndarray:
    """How many of a UTF-8 text's runs of `low` to `high` characters HashingTF puts into each slot: MurmurHash3 of all runs at once."""
    raw = np.frombuffer(text + bytes(4 * high + 4), np.uint8)
    starts = np.append(np.flatnonzero((raw[: len(text)] & 0xC0) != 0x80), len(text))
    counts = np.zeros(width, np.int64)
    for at in range(0, max(len(starts) - 1, 0), block):
        own = starts[at : at + block + high]
        part = raw[own[0] : own[-1] + 4 * high + 4].astype(np.uint32)
        word = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        own, slots = own - own[0], []
        for n in range(low, high + 1):
            first = own[: min(block, len(own) - n)] if len(own) > n else own[:0]
            size = own[n : n + len(first)] - first
            h = np.full(len(first), 42, np.uint32)
            for i in range(int(size.max(initial=0)) // 4):
                k = h ^ _mixed(word[first + 4 * i])
                k = ((k << np.uint32(13)) | (k >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
                h = np.where(size >= 4 * i + 4, k, h)
            if size.max(initial=0) > n or n % 4:
                tail = (np.uint32(1) << (8 * (size & 3)).astype(np.uint32)) - np.uint32(1)
                h = h ^ _mixed(word[first + (size & ~3)] & tail)
            h = h ^ size.astype(np.uint32)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            slots.append((h ^ (h >> np.uint32(16))).view(np.int32) % width)
        counts += np.bincount(np.concatenate(slots), minlength=width)
    return counts


def hashed_grams(text: Column, width: int) -> Column:
    """HashingTF of char_grams() of a flat text, as the struct that a sparse vector is stored as."""

    @F.arrow_udf(VectorUDT.sqlType())
    def made(column: pa.Array) -> pa.Array:
        slots, counts, ends = [], [], [0]
        for one in column:
            found = gram_counts(one.as_py().encode(), width)
            slots.append(np.flatnonzero(found).astype(np.int32))
            counts.append(found[slots[-1]].astype(np.float64))
            ends.append(ends[-1] + len(slots[-1]))
        at = pa.array(ends, pa.int32())
        arrays = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([*v, np.zeros(0, t)]), a)) for v, t, a in ((slots, np.int32, pa.int32()), (counts, np.float64, pa.float64()))]
        return pa.StructArray.from_arrays([pa.array(np.zeros(len(column), np.int8)), pa.array(np.full(len(column), width, np.int32)), *arrays], ["type", "size", "indices", "values"])

    return made(text)


def labelled_rows(rows: DataFrame, numeric: list[str], key: str, text: str = "text", label: str = "label", fold: str = "fold", labels: tuple[str, ...] = OUTCOMES, by: Iterable[str] = ()) -> DataFrame:
    """id, fold, y_true, label (its place), _text, dense, the columns `by`, of rows with an id, a fold and a known label."""
    place = F.coalesce(*[F.when(F.col(label) == c, float(i)) for i, c in enumerate(labels)])
    body = F.coalesce(F.col(text), F.lit(""))
    number = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0))
    dense = F.array(*[number(c) for c in numeric]) if numeric else F.array(F.lit(0.0))
    made = rows.select(F.col(key).alias("id"), F.col(fold).cast("int").alias("fold"), F.col(label).alias("y_true"), place.alias("label"), body.alias("_text"), dense.alias("dense"), *by)
    return made.filter("id is not null and fold is not null and label is not null")


def feature_table(rows: DataFrame, numeric: list[str], key: str, text: str = "text", label: str = "label", fold: str = "fold", labels: tuple[str, ...] = OUTCOMES, width: int = WIDTH, grams: Iterable[str] = ("words", "chars"), by: Iterable[str] = ()) -> DataFrame:
    """id, fold, y_true, label (its place), words, chars (hashed counts; those named in `grams`), dense, the columns `by`: stored once by these and the fold, read by every fit."""
    grams, by = tuple(grams), tuple(by)
    made = labelled_rows(rows, numeric, key, text, label, fold, labels, by)
    if "words" in grams:
        made = HashingTF(inputCol="_grams", outputCol="words", numFeatures=width).transform(made.withColumn("_grams", word_grams(F.col("_text")))).drop("_grams")
    if "chars" in grams:
        made = made.withColumn("chars", hashed_grams(flat(F.col("_text")), width))
    made = made.drop("_text")
    return _stored(made, *by, "fold", schema=StructType([StructField(f.name, VectorUDT() if f.name == "chars" else f.dataType) for f in made.schema.fields]), ascending=tuple(f"{c}.indices" for c in grams))


def column_of(kind: str) -> str:
    return "words" if kind in ("word_logistic", "hybrid_logistic") else "chars"


class Parts:
    """What a training part must know, for every choice of folds to leave out; a row for each fold and label reaches the driver."""

    def __init__(self, table: DataFrame, labels: tuple[str, ...] = OUTCOMES):
        self.labels, self.rows, self.df, self.dense = labels, {}, {c: {} for c in ("words", "chars") if c in table.columns}, {}
        for r in table.groupBy("fold", "label").count().collect():  # read without the vectors
            self.rows[r["fold"], int(r["label"])] = r["count"]
        for r in table.groupBy("fold").agg(*[Summarizer.numNonZeros(F.col(c)).alias(c) for c in self.df], Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("dense")).alias("d")).collect():
            for c in self.df:
                self.df[c][r["fold"]] = r[c].toArray()
            n = r["d"]["count"]
            self.dense[r["fold"]] = (n, r["d"]["mean"].toArray(), r["d"]["variance"].toArray() * (n - 1))
        self.folds = sorted(self.dense)

    def weights(self, out: Iterable[int]) -> list[float]:
        """Rows / (classes * rows of the class), of the classes that the part has."""
        sizes = [sum(n for (f, c), n in self.rows.items() if c == i and f not in out) for i in range(len(self.labels))]
        there = sum(1 for n in sizes if n)
        return [sum(sizes) / (there * n) if n else 1.0 for n in sizes]

    def inverse_df(self, column: str, out: Iterable[int]) -> np.ndarray:
        """ln((1 + n) / (1 + df)) + 1; 0 for grams of too few texts."""
        left = [f for f in self.folds if f not in out]
        df, n = sum(self.df[column][f] for f in left), sum(self.dense[f][0] for f in left)
        return np.where(df >= LEAST_DF, np.log((1 + n) / (1 + df)) + 1, 0.0)

    def scale(self, out: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations (of the population; 1 where it is 0) of the numbers, merged over folds."""
        n, mean, square = 0, 0.0, 0.0
        for f in self.folds:
            if f not in out:
                m, at, s = self.dense[f]
                gap, both = at - mean, n + m
                mean, square, n = mean + gap * m / both, square + s + gap * gap * n * m / both, both
        std = np.sqrt(square / max(n, 1))
        return mean, np.where(std > 0, std, 1.0)

    def held(self, kinds: Iterable[str]) -> int:
        """Bytes of the features of the largest kind: an index and a value for each slot of a text."""
        return max((12 * int(sum(v.sum() for v in self.df[column_of(kind)].values())) for kind in kinds if column_of(kind) in self.df), default=0)

    def stages(self, kind: str, out: tuple[int, ...]) -> list:
        column = column_of(kind)
        text = "text_features" if kind == "hybrid_logistic" else "features"
        made = [ElementwiseProduct(scalingVec=Vectors.dense(self.inverse_df(column, out)), inputCol=column, outputCol="_weighted"), Normalizer(inputCol="_weighted", outputCol=text)]
        return [*made, VectorAssembler(inputCols=[text, "numbers"], outputCol="features")] if kind == "hybrid_logistic" else made

    def features(self, table: DataFrame, kind: str, out: tuple[int, ...]) -> DataFrame:
        """`features` of a kind of model and `weight`, as the part that leaves out these folds has them."""
        mean, std = self.scale(out)
        arrays = [F.array(*[F.lit(float(x)) for x in v]) for v in (mean, std)]
        numbers = array_to_vector(F.transform("dense", lambda x, i: (x - F.get(arrays[0], i)) / F.get(arrays[1], i)))
        weight = F.get(F.array(*[F.lit(float(w)) for w in self.weights(out)]), F.col("label").cast("int"))
        return PipelineModel(self.stages(kind, out)).transform(table.withColumns({"numbers": numbers, "weight": weight}))


def scorer(kind: str, train: DataFrame, iterations: int, classes: list[int]):
    """A function that adds `probability` (but for char_svm) and `margins`, arrays by label, to rows with features.

    Margin models are fitted a class at a time on the rows as they stand: MLlib holds one copy of their features, where
    OneVsRest would hold one more of the whole table.
    """
    if kind != "char_svm":
        model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=0.001) if kind.endswith("logistic") else NaiveBayes(smoothing=0.2, weightCol="weight")
        model = model.fit(train)
        return lambda rows: model.transform(rows).withColumns({"probability": vector_to_array("probability"), "margins": vector_to_array("rawPrediction")})
    binary = lambda c: (F.col("label") == float(c)).cast("double").alias("_own", metadata={"ml_attr": {"type": "binary"}})
    models = {c: LinearSVC(labelCol="_own", weightCol="weight", rawPredictionCol=f"_margin{c}", predictionCol=f"_place{c}", maxIter=iterations, regParam=0.001).fit(train.select("features", "weight", binary(c))) for c in classes}

    def scored(rows):
        for model in models.values():
            rows = model.transform(rows)
        return rows.withColumn("margins", F.array(*[F.get(vector_to_array(f"_margin{c}"), F.lit(1)) if c in models else F.lit(0.0) for c in range(max(classes, default=-1) + 1)]))

    return scored


def softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def level_one(table: DataFrame, parts: Parts, kinds: Iterable[str] = MODELS, nested: Iterable[str] = (), iterations: int = 20, at_once: int = 8) -> DataFrame:
    """LONG: each row's probabilities by models of other folds; outer = fold, or for the `nested` kinds any other outer fold too.

    No model has seen a row that it scores, nor any row of the outer fold. At most `at_once` fits stand side by side, fewer
    where the features that MLlib holds for each would be more than HELD bytes together.
    """
    outs = [(kind, (k,)) for kind in kinds for k in parts.folds] + [(kind, pair) for kind in nested for pair in combinations(parts.folds, 2)]

    def one(job):
        kind, out = job
        rows = parts.features(table, kind, out)
        classes = [c for c in range(len(parts.labels)) if any(n for (f, i), n in parts.rows.items() if i == c and f not in out)]
        scored = scorer(kind, rows.filter(~F.col("fold").isin(*out)), iterations, classes)
        outer = F.lit(out[0]) if len(out) == 1 else F.when(F.col("fold") == out[0], out[1]).otherwise(out[0])
        made = scored(rows.filter(F.col("fold").isin(*out)))
        probs = softmax(F.col("margins")) if kind == "char_svm" else F.col("probability")
        return made.select("id", "fold", outer.cast("int").alias("outer"), F.lit(kind).alias("model_name"), "y_true", _wide(probs, parts).alias("probs"), _wide(F.col("margins"), parts).alias("margins"), "label", "dense")

    at_once = max(1, min(at_once, HELD // max(parts.held(kinds), 1)))
    outs = [o for o in outs if len(parts.folds) > len(o[1])]
    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(one, outs))
    if not made:
        return no_scores(table)
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return _stored(out)


def no_scores(table: DataFrame) -> DataFrame:
    """level_one() of no model."""
    empty = F.array().cast("array<double>")
    return table.limit(0).select("id", "fold", F.col("fold").alias("outer"), F.lit("").alias("model_name"), "y_true", empty.alias("probs"), empty.alias("margins"), "label", "dense")


def _wide(values: Column, parts: Parts) -> Column:
    """An entry for each label: a model does not know labels beyond the last one that it met."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(parts.labels) - 1)), lambda i: F.coalesce(F.get(values, i), F.lit(0.0)))


def calibrated(long: DataFrame, parts: Parts, kind: str = "char_svm", name: str = "char_svm_calibrated", at_once: int = 8) -> DataFrame:
    """LONG of a margin model with probabilities by a logistic calibrator: of an outer fold, fitted on the margins of the other folds' rows, each by a model that had seen neither.

    long: of level_one() with the kind among `nested`.
    """
    rows = long.filter(F.col("model_name") == kind).withColumn("features", array_to_vector("margins"))

    def one(k):
        own = rows.filter(F.col("outer") == k)
        model = LogisticRegression(maxIter=50, regParam=1e-4).fit(own.filter(F.col("fold") != k))
        made = model.transform(own.filter(F.col("fold") == k))
        return made.select("id", "fold", "outer", F.lit(name).alias("model_name"), "y_true", _wide(vector_to_array("probability"), parts).alias("probs"), "margins")

    return _united(one, parts.folds if len(parts.folds) > 2 else [], long, at_once)


def stacked(long: DataFrame, parts: Parts, kinds: Iterable[str], name: str = "stacked", at_once: int = 8) -> DataFrame:
    """LONG of a second model over one-hot labels and confidences of the first ones, and the numbers, scaled by the deviations of its training rows.

    For an outer fold it learns from rows of other folds as models scored them that had seen neither those rows nor the
    outer fold. long: of level_one() with all kinds among `nested`.
    """
    kinds = list(kinds)
    best = lambda p: F.array_position(p, F.array_max(p)) - 1
    wide = long.filter(F.col("model_name").isin(*kinds)).groupBy("id", "fold", "outer", "y_true", "label", "dense").agg(*[F.max(F.when(F.col("model_name") == m, F.col("probs"))).alias(m) for m in kinds])
    flags = [F.when(best(F.col(m)) == i, 1.0).otherwise(0.0) for m in kinds for i in range(len(parts.labels))]
    wide = wide.withColumn("raw", F.concat(F.array(*flags, *[F.array_max(m) for m in kinds]), "dense"))
    wide = _stored(wide)

    def one(k):
        own = wide.filter(F.col("outer") == k)
        train = own.filter(F.col("fold") != k)
        var = train.agg(Summarizer.variance(array_to_vector("raw"))).first()[0].toArray()
        std = F.array(*[F.lit(float(np.sqrt(v)) if v > 0 else 1.0) for v in var])
        weight = F.get(F.array(*[F.lit(float(w)) for w in parts.weights((k,))]), F.col("label").cast("int"))
        ready = own.withColumns({"features": array_to_vector(F.transform("raw", lambda x, i: x / F.get(std, i))), "weight": weight})
        model = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01).fit(ready.filter(F.col("fold") != k))
        made = model.transform(ready.filter(F.col("fold") == k))
        return made.select("id", "fold", "outer", F.lit(name).alias("model_name"), "y_true", _wide(vector_to_array("probability"), parts).alias("probs"), _wide(vector_to_array("rawPrediction"), parts).alias("margins"))

    return _united(one, parts.folds if len(parts.folds) > 2 else [], long, at_once)


def _united(one, folds: list[int], long: DataFrame, at_once: int) -> DataFrame:
    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(one, folds))
    out = long.limit(0).select(*LONG)
    for df in made:
        out = out.unionByName(df)
    return out


def majority(table: DataFrame, parts: Parts) -> DataFrame:
    """LONG of the label that most rows of the other folds have, with one-hot probabilities; ties go to the earlier label."""
    out = None
    for k in parts.folds:
        sizes = [sum(n for (f, c), n in parts.rows.items() if c == i and f != k) for i in range(len(parts.labels))]
        probs = F.array(*[F.lit(float(i == int(np.argmax(sizes)))) for i in range(len(sizes))])
        one = table.filter(F.col("fold") == k).select("id", "fold", F.col("fold").alias("outer"), F.lit("majority").alias("model_name"), "y_true", probs.alias("probs"), probs.alias("margins"))
        out = one if out is None else out.unionByName(one)
    return table.limit(0).select("id", "fold", F.col("fold").alias("outer"), F.lit("").alias("model_name"), "y_true", F.array().cast("array<double>").alias("probs"), F.array().cast("array<double>").alias("margins")) if out is None else out


def predictions(long: DataFrame, labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """id, fold, model_name, y_true, y_pred, confidence and a probability for each label, 6 digits: the rows of the outer folds themselves."""
    own = long.filter("fold = outer")
    probs = normalised([F.get("probs", F.lit(i)) for i in range(len(labels))])
    named = [F.round(p, 6).alias(f"{c}_prob") for c, p in zip(labels, probs, strict=True)]
    return own.select("id", "fold", "model_name", "y_true", argmax(probs, labels).alias("y_pred"), F.round(F.greatest(*probs), 6).alias("confidence"), *named)
