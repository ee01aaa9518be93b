"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression (operator 4).

Features of a whole text: densities of two lexicons (a fixed seed, and word beginnings learned from
labelled rows by log-odds), how many hits stand near a second person, rates of capitals, of
punctuation and of obfuscation (digits or symbols within words, letters three times in a row).
Labels are learned from a sample of at most `sample` labelled rows outside the held-out part. The
calibration sees margins of rows that words and trees had not seen: each third of the sample is judged by
those of the other two (thirds whose rest lacks a label are left out; if all are, margins of the
sample itself serve). The words and trees that score documents come from all of the sample. All documents are scored in one pass.

Defined cases: null and empty texts have all features 0 and get a score like any other; a row with a
null doc_id is scored and not held out; labels of several rows of one doc_id count as toxic if one
is; a null label teaches nothing; without both labels in the sample every score is the mean label
(0 without any); repeated rows are scored each; an empty table gives no rows; further columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import picked, row_slices, small_batches, table, utf8_of, written

#: Plain insults, and second persons, of the four languages.
SEED = "awful clown coward disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash ugly vermin worthless dumm idiotin trottel versager abschaum crétin débile imbécile ordure raclure idiota imbécil basura inútil estúpido".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta vous votre vos tú ti usted ustedes vosotros su".split()
FEATURES = ("learned_density", "learned_hits", "seed_density", "near_second", "capitals", "shouted", "exclaimed", "asked", "punctuation", "digits_within", "symbols_within", "drawn_out", "words")
#: Lengths in bytes of the word beginnings that a lexicon may hold; shorter words count whole.
BEGINNINGS = (4, 5, 6, 7, 8)
NEAR = 5
#: Parts of the sample for the calibration.
FOLDS = 3


def _kinds() -> np.ndarray:
    """0 white space, 1 letter (other bytes of UTF-8 too), 2 digit, 3 punctuation or symbol."""
    kind = np.full(256, 1, np.uint8)
    kind[:33], kind[0x7F] = 0, 0
    kind[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
    kind[48:58] = 2
    return kind


KIND = _kinds()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def packed(word: bytes, size: int = 8) -> int:
    return int.from_bytes(word[:size].ljust(8, b"\0"), "little")


class Words:
    """The words of many texts: white space apart, symbols and digits at both ends left out."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.raw, self.ends, n = raw, ends, len(ends) - 1
        self.low, self.kind = LOWER[raw], KIND[raw]
        solid = self.kind == 1
        text = self.kind > 0
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        start = text & (np.concatenate(([True], ~text[:-1])) | first[:-1]) if len(raw) else text
        self.at = np.flatnonzero(start)
        stop = np.flatnonzero(text & (np.concatenate((~text[1:], [True])) | first[1:])) + 1 if len(raw) else self.at
        letters = np.concatenate(([0], np.cumsum(solid)))
        # from the first to the last letter of each run of solid bytes
        where = np.flatnonzero(solid)
        keep = letters[stop] > letters[self.at]
        self.at, stop = self.at[keep], stop[keep]
        self.start = where[letters[self.at]] if len(self.at) else self.at
        self.stop = where[letters[stop] - 1] + 1 if len(stop) else stop
        self.row = np.searchsorted(ends, self.start, "right") - 1
        self.n = np.bincount(self.row, minlength=n)[:n]
        size = self.stop - self.start
        padded = np.concatenate((self.low, np.zeros(8, np.uint8))).astype(np.uint64)
        self.key = np.zeros(len(self.start), np.uint64)
        for k in range(8):
            self.key |= np.where(size > k, padded[self.start + k], 0).astype(np.uint64) << np.uint64(8 * k)
        self.size = size

    def beginnings(self):
        """(length, keys, words) for every length; a word of at most 8 bytes also counts whole (length 0)."""
        for k in BEGINNINGS:
            which = np.flatnonzero(self.size >= k)
            yield k, self.key[which] & np.uint64((1 << 8 * k) - 1), which
        which = np.flatnonzero((self.size >= 3) & (self.size <= 8))
        yield 0, self.key[which], which


def lexicon_hits(words: Words, lexicon: dict[int, np.ndarray]) -> np.ndarray:
    hit = np.zeros(len(words.key), bool)
    for k, keys, which in words.beginnings():
        known = lexicon.get(k)
        if known is not None and len(known):
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit[which[known[i] == keys]] = True
    return hit


def seed_lexicon(words: list[str]) -> dict[int, np.ndarray]:
    raw = [w.encode() for w in words]
    short, long = [packed(w) for w in raw if len(w) <= 8], [packed(w) for w in raw if len(w) > 8]
    return {0: np.array(sorted(short), np.uint64), 8: np.array(sorted(set(long)), np.uint64)}


SEED_KEYS, SECOND_KEYS = seed_lexicon(SEED), np.array(sorted(packed(w.encode()) for w in SECOND), np.uint64)


def features(raw: np.ndarray, ends: np.ndarray, learned: dict[int, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, w = len(ends) - 1, Words(raw, ends)
    out = np.zeros((n, len(FEATURES)))
    if not len(w.key):
        return out
    count = lambda rows: np.bincount(rows, minlength=n)[:n].astype(float)
    byte_row = np.repeat(np.arange(n), np.diff(ends))
    many, size = np.maximum(w.n, 1), np.maximum(np.diff(ends), 1)
    hit, seed = lexicon_hits(w, learned), lexicon_hits(w, SEED_KEYS)
    either = np.flatnonzero(hit | seed)
    second = np.concatenate(([0], np.cumsum(np.isin(w.key, SECOND_KEYS))))
    bound = np.searchsorted(w.row, np.arange(n + 1))
    low, high = np.maximum(either - NEAR, bound[w.row[either]]), np.minimum(either + NEAR + 1, bound[w.row[either] + 1])
    near = either[second[high] > second[low]]
    upper = (raw >= 65) & (raw <= 90)
    uppers = np.concatenate(([0], np.cumsum(upper)))
    shouted = (w.size >= 3) & (uppers[w.stop] - uppers[w.start] == w.size)
    inner = [np.concatenate(([0], np.cumsum(w.kind == k))) for k in (2, 3)]
    digits, symbols = (x[w.stop] - x[w.start] > 0 for x in inner)
    drawn = np.flatnonzero((w.low[2:] == w.low[1:-1]) & (w.low[1:-1] == w.low[:-2]) & (w.kind[2:] == 1)) if len(raw) > 2 else np.zeros(0, int)
    columns = (
        count(w.row[hit]) / many, np.log1p(count(w.row[hit])), count(w.row[seed]) / many, count(w.row[near]) / many, count(byte_row[upper]) / size, count(w.row[shouted]) / many,
        count(byte_row[raw == 33]) / size, count(byte_row[raw == 63]) / size, count(byte_row[w.kind == 3]) / size, count(w.row[digits]) / many, count(w.row[symbols]) / many, count(byte_row[drawn]) / size, np.log1p(w.n),
    )
    out[:] = np.column_stack(columns)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, label, part: at most `sample` labelled rows outside the held-out part, chosen by a hash of doc_id."""
    known = picked(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1.0).otherwise(0.0)).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = picked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `sample`
    return texts.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(FOLDS)))


def learn_lexicon(rows: DataFrame, most: int = 4000, least: int = 6, odds: float = 2.5, errors: float = 1.5) -> dict[int, np.ndarray]:
    """Word beginnings that at least `least` toxic texts hold, and whose log-odds less `errors` standard errors reach `odds`; the `most` best."""

    def count(batches):
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            raw, ends = utf8_of(b.column(0))
            for i, j in row_slices(ends):
                w, parts = Words(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]), []
                for k, keys, which in w.beginnings():
                    pair = np.unique(np.column_stack((keys, w.row[which].astype(np.uint64))), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
                    one, inverse = np.unique(pair[:, 0], return_inverse=True)
                    parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(one), k, np.int32)), pa.array(one.view(np.int64)), pa.array(np.bincount(inverse, label[i:j][pair[:, 1].astype(int)], len(one)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(one)).astype(np.int64))], ["k", "key", "toxic", "n"]))
                yield from parts

    total = rows.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    counts = rows.select("text", "label").mapInArrow(count, "k int, key long, toxic long, n long").groupBy("k", "key").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    bad, good = float(total["toxic"] or 0) + 1, float(total["n"] - (total["toxic"] or 0)) + 1
    has, lacks = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    score = F.log(has / bad) - F.log(lacks / good) - errors * F.sqrt(1 / has + 1 / lacks)
    with small_batches(rows.sparkSession):
        best = counts.filter(F.col("toxic") >= least).withColumn("score", score).filter(F.col("score") >= odds).orderBy(F.desc("score"), F.desc("toxic"), "k", "key").limit(most).collect()
    out: dict[int, list[int]] = {}
    for r in best:
        out.setdefault(r["k"], []).append(r["key"])
    return {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in out.items()}


def featured(docs: DataFrame, learned: dict[int, np.ndarray], others: list[str]) -> DataFrame:
    """Columns `others` (the text may be one of them) and the features of `text`."""
    rows = picked(docs, *dict.fromkeys(["text", *others]))
    places = [rows.columns.index(c) for c in others]

    def score(batches):
        for b in batches:
            raw, ends = utf8_of(b.column(0))
            for i, j in row_slices(ends):
                x = features(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], learned)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in places], lists], [*others, "features"])

    return rows.mapInArrow(score, StructType([*[rows.schema[c] for c in places], StructField("features", ArrayType(DoubleType()))]))


def scorer(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 3):
    """Learns from labelled rows; the function that is returned adds `score` to documents, which keep the given columns."""
    rows = written(labelled_sample(docs, labels, sample), "toxicity-sample")
    total = rows.agg(F.avg("label").alias("mean"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    base = float(total["mean"] or 0.0)
    if total["low"] == total["high"]:
        return lambda df, others: picked(df, *others).withColumn("score", F.lit(base))
    def trees_of(part: DataFrame, learned: dict[int, np.ndarray], name: str):
        """Boosted trees of these rows; the function that is returned adds `margin` to documents with other columns."""
        train = written(featured(part, learned, ["label"]).withColumn("x", array_to_vector("features")), name)
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(train)

        def margin(df: DataFrame, others: list[str]) -> DataFrame:
            found = model.transform(featured(df, learned, others).withColumn("x", array_to_vector("features")))
            return found.select(*others, vector_to_array("probability")[1].alias("margin"))

        return margin

    sums = None
    for k in range(FOLDS):
        fit, held = rows.filter(F.col("part") != k), rows.filter(F.col("part") == k)
        if fit.agg(F.count_distinct("label")).first()[0] == 2:
            one = trees_of(fit, learn_lexicon(fit), "toxicity-fold")(held, ["label"]).groupBy("margin").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
            sums = one if sums is None else sums.union(one)
    margin = trees_of(rows, learn_lexicon(rows), "toxicity-features")
    if sums is None:
        sums = margin(rows, ["label"]).groupBy("margin").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    # Equal margins as one row, however many texts have them.
    sums = sums.groupBy("margin").agg((F.sum("bad") / F.sum("n")).alias("label"), F.sum("n").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated", weightCol="weight").fit(written(sums, "toxicity-margins"))

    def score(df: DataFrame, others: list[str]) -> DataFrame:
        scored = steps.transform(margin(df, others))
        return scored.select(*others, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("score"))

    return score


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated score of every document; predicted where it reaches 0.7."""
    docs = table(spark, sf_dir, "documents")
    scored = scorer(docs, table(spark, sf_dir, "labels"))(docs, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

