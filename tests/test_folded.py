import threading

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from sluice.operators import evaluate, folded
from sluice.operators.labels import OUTCOMES

WORDS = ["claim", "delay", "notice", "site", "cost", "order", "weather", "drawing", "extra", "labour", "plant", "court"]


def cases(n=150, seed=3, random_label=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = int(rng.choice(3, p=[0.5, 0.3, 0.2]))
        own = ["granted sum", "reduced part", "refused claim"][c].split()
        text = " ".join(rng.choice(WORDS, 12).tolist() + (own if rng.random() < 0.85 else []))
        label = OUTCOMES[int(rng.integers(0, 3))] if random_label else OUTCOMES[c]
        rows.append((i, text, label, i % 3, float(c) + float(rng.normal()), float(rng.normal() * 50)))
    return rows


SCHEMA = "case_id long, text string, label string, fold int, a double, b double"


@pytest.fixture(scope="module")
def fitted(spark):
    table = folded.feature_table(spark.createDataFrame(cases(), SCHEMA).coalesce(2), ["a", "b"], "case_id", width=1 << 12)
    parts = folded.Parts(table)
    return table, parts, folded.level_one(table, parts, nested=("char_svm", "word_logistic", "char_bayes"), iterations=6)


def metric(df):
    return {r["model_name"]: (r["n"], r["macro_f1"]) for r in evaluate.scores(df, ["model_name"]).collect()}


def test_a_row_for_each_case_and_model_and_each_beats_the_majority(fitted):
    table, parts, long = fitted
    rows = long.select(*folded.LONG).unionByName(folded.calibrated(long, parts)).unionByName(folded.stacked(long, parts, ("word_logistic", "char_bayes"))).unionByName(folded.majority(table, parts))
    pred = folded.predictions(rows)
    assert pred.groupBy("id", "model_name").count().filter("count <> 1").isEmpty()
    scores = metric(pred)
    assert set(scores) == {*folded.MODELS, "char_svm_calibrated", "stacked", "majority"} and {n for n, _ in scores.values()} == {150}
    assert all(f > scores["majority"][1] + 0.2 for m, (_, f) in scores.items() if m != "majority")
    assert pred.filter(F.abs(F.col("support_prob") + F.col("partial_prob") + F.col("not_support_prob") - 1) > 1e-5).isEmpty()


def test_no_model_saw_what_it_scores(spark):
    """Each text has a word of its own, and labels are drawn: a model that had seen a row would know its label."""
    rows = [(i, f"{t} only{i} only{i} only{i}", *rest) for i, t, *rest in cases(200, 8, random_label=True)]
    table = folded.feature_table(spark.createDataFrame(rows, SCHEMA), [], "case_id", width=1 << 14)
    parts = folded.Parts(table)
    long = folded.level_one(table, parts, ("char_bayes",), ("char_bayes",))
    hits = long.groupBy((F.col("fold") == F.col("outer")).alias("own")).agg(F.avg((F.array_position("probs", F.array_max("probs")) - 1 == F.col("label")).cast("int")).alias("hit"), F.count("*").alias("n"))
    got = {r["own"]: (r["hit"], r["n"]) for r in hits.collect()}
    assert got[True][1] == 200 and got[False][1] == 400
    assert got[True][0] < 0.5 and got[False][0] < 0.5  # a third is chance
    stack = metric(folded.predictions(folded.stacked(long, parts, ("char_bayes",))))
    assert stack["stacked"][1] < 0.5


def test_calibration_lowers_the_loss(fitted):
    _, parts, long = fitted
    loss = lambda df: df.agg(F.avg(evaluate.negative_log(F.col("y_true"), [F.get("probs", F.lit(i)) for i in range(3)]))).first()[0]
    own = long.filter("model_name = 'char_svm' and fold = outer")
    assert loss(folded.calibrated(long, parts)) < loss(own)


def test_hybrid_features_equal_numpy(spark):
    rows = cases(50, 4)
    table = folded.feature_table(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "case_id", width=1 << 16)
    parts = folded.Parts(table)
    got = {r["id"]: r["features"].toArray() for r in parts.features(table, "hybrid_logistic", (0, 2)).collect()}
    counts = {r["id"]: r["words"].toArray() for r in table.collect()}
    train = [r for r in rows if r[3] not in (0, 2)]
    df = sum((counts[r[0]] > 0).astype(float) for r in train)
    idf = np.where(df >= 2, np.log((1 + len(train)) / (1 + df)) + 1, 0)
    numbers = np.array([r[4:6] for r in rows])
    base = np.array([r[4:6] for r in train])
    scaled = (numbers - base.mean(axis=0)) / base.std(axis=0)
    for r, own in zip(rows, scaled, strict=True):
        x = counts[r[0]] * idf
        want = np.concatenate((x / np.linalg.norm(x), own))
        assert np.allclose(got[r[0]], want)


def test_grams(spark):
    df = spark.createDataFrame([("Ab  é",), ("",), ("One two, one",)], "t string")
    words, chars = zip(*[(r[0], r[1]) for r in df.select(folded.word_grams(F.col("t")), folded.char_grams(F.col("t"), 2, 3)).collect()], strict=True)
    assert words == (["ab", "é", "ab é"], [], ["one", "two", "one", "one two", "two one"])
    assert chars[0] == ["ab", "b ", " é", "ab ", "b é"] and chars[1] == []


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, "support", 0, None, float("nan")), (2, "", "partial", 1, 1.0, 2.0), (None, "x", "support", 0, 1.0, 1.0), (3, "x", None, 0, 1.0, 1.0), (4, "x", "other", 0, 1.0, 1.0), (5, "x y", "support", 1, 0.0, 0.0), (6, "x y", "partial", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = folded.feature_table(df, ["a", "b"], "case_id", width=64)
    parts = folded.Parts(table)
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 5, 6] and parts.folds == [0, 1]
    assert folded.predictions(folded.level_one(table, parts, ("hybrid_logistic",))).count() == 4
    none = folded.feature_table(df.limit(0), ["a"], "case_id", width=64)
    parts = folded.Parts(none)
    long = folded.level_one(none, parts)
    assert folded.predictions(long).count() == 0 and folded.majority(none, parts).count() == 0 and folded.stacked(long, parts, ("char_bayes",)).count() == 0


def test_gram_counts_are_those_of_hashing_tf(spark):
    texts = ["", "a", "ab", "Äß é ñ — 漢字かな  x\n", "hello  world\n\tfoo bar" * 30, "é" * 70_000 + "yz", None]
    df = spark.createDataFrame([(i, t, "support", i % 2) for i, t in enumerate(texts)], "case_id long, text string, label string, fold int")
    plain = df.select("case_id", folded.char_grams(F.coalesce("text", F.lit(""))).alias("grams"))
    for width in (1 << 13, 1000):
        want = {r["case_id"]: r["o"] for r in HashingTF(inputCol="grams", outputCol="o", numFeatures=width).transform(plain).collect()}
        table = folded.feature_table(df, [], "case_id", width=width, grams=("chars",))
        assert "words" not in table.columns and {r["id"]: r["chars"] for r in table.collect()} == want
    assert folded.gram_counts("a😀b".encode(), 64, 2, 2).sum() == 2  # runs of characters, not of halves of one


def test_a_stored_table_is_a_fraction_of_its_vectors_bytes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, " ".join(rng.choice(WORDS, 300)), "support", i % 2) for i in range(200)], "case_id long, text string, label string, fold int")
    table = folded.feature_table(df.coalesce(2), [], "case_id", width=1 << 13)
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    size = sum(len(open(f, "rb").read()) for f in files)
    slots = sum(v.sum() for by in folded.Parts(table).df.values() for v in by.values())
    assert files and all("/fold=" in f for f in files) and size * 2 < 12 * slots


def test_fits_follow_one_another_where_their_features_are_large(spark, monkeypatch):
    table = folded.feature_table(spark.createDataFrame(cases(40), SCHEMA).coalesce(1), [], "case_id", width=256, grams=("chars",))
    parts, lock, now, most = folded.Parts(table), threading.Lock(), [0], [0]
    assert parts.held(("char_svm",)) == 12 * sum(len(r["chars"].indices) for r in table.collect())
    plain = folded.scorer

    def counted(*args):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return plain(*args)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(folded, "scorer", counted)
    monkeypatch.setattr(folded, "HELD", 1)
    folded.level_one(table, parts, ("char_svm",), iterations=2)
    assert most == [1]


def test_margins_are_those_of_one_against_the_rest(spark):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    table = folded.feature_table(spark.createDataFrame(cases(80), SCHEMA).coalesce(1), [], "case_id", width=512, grams=("chars",))
    rows = folded.Parts(table).features(table, "char_svm", (0,))
    train = rows.filter("fold <> 0")
    got = {r["id"]: r["margins"] for r in folded.scorer("char_svm", train, 4, [0, 1, 2])(rows.filter("fold = 0")).collect()}
    want = OneVsRest(classifier=LinearSVC(maxIter=4, regParam=0.001), weightCol="weight").fit(train).transform(rows.filter("fold = 0"))
    assert len(got) > 20 and all(np.allclose(got[r["id"]], r["rawPrediction"].toArray(), atol=1e-9) for r in want.collect())
