"""Queries that train models or resample (2-K, 2-J, 2-H): no SQL can express them."""

from pyspark.sql import functions as F

from ..operators import evaluate, folded, joint, models
from ..operators.sample import folds
from .evaluation import predictions
from .registry import query, table

C = F.col


def labelled(spark, d):
    rows = table(spark, d, "labels").select("doc_id", C("toxic").cast("double").alias("label")).filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return folds(rows, "label", "doc_id", 7, 2).join(table(spark, d, "documents").select("doc_id", "text").filter("text is not null"), "doc_id")


@query("k2_logistic_regression")
def k2(spark, d):
    return models.out_of_fold(labelled(spark, d), "logistic", 2)


@query("k4_naive_bayes")
def k4(spark, d):
    return models.out_of_fold(labelled(spark, d), "bayes", 2)


@query("k3_linear_svm")
def k3(spark, d):
    return models.out_of_fold(labelled(spark, d), "svm", 2)


NUMERIC = ("chars", "words", "lines", "digits", "capitals", "commas", "questions", "shouts", "quotes", "mean_word")


def cases(spark, d, k=5):
    """Labelled documents with three outcomes, ten numbers and a fold."""
    label = F.when(F.max("toxic") == 1, "not_support").when(F.max("quality") == 1, "support").otherwise("partial")
    rows = table(spark, d, "labels").filter("doc_id is not null").groupBy("doc_id").agg(label.alias("label"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    numbers = {"chars": F.length("text").cast("double"), "words": count(r"\S+"), "lines": count(r"\n"), "digits": count(r"[0-9]"), "capitals": count(r"\p{Lu}"), "commas": count(","), "questions": count(r"\?"), "shouts": count("!"), "quotes": count("[\"']")}
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").dropDuplicates(["doc_id"])
    found = folds(rows, "label", "doc_id", 7, k).join(docs, "doc_id").withColumns(numbers)  # counted in labelled texts only
    return found.withColumn("mean_word", C("chars") / F.greatest(C("words"), F.lit(1.0)))


@query("k18_out_of_fold")
def k18(spark, d):
    """Every labelled document by every model of the other folds, the margin model with and without calibration, and the majority."""
    rows = joint.packed(cases(spark, d), list(NUMERIC), "doc_id", width=1 << 13)
    parts = joint.Parts(rows, width=1 << 13)
    long = joint.level_one(rows, parts, nested=("char_svm",), iterations=5)
    return folded.predictions(long.select(*folded.LONG).unionByName(folded.calibrated(long, parts)).unionByName(folded.majority(rows, parts)))


@query("k17_stacking")
def k17(spark, d):
    """A second model over what two models of other folds say, and the ten numbers, with the two models beside it."""
    rows = folded.feature_table(cases(spark, d, 3), list(NUMERIC), "doc_id", width=1 << 15)
    parts, kinds = folded.Parts(rows), ("word_logistic", "char_bayes")
    long = folded.level_one(rows, parts, kinds, kinds, iterations=8)
    return folded.predictions(long.select(*folded.LONG).unionByName(folded.stacked(long, parts, kinds)))


@query("k6_hybrid_features")
def k6(spark, d):
    """Metrics of words and standardised numbers together, and of words alone."""
    rows = folded.feature_table(cases(spark, d, 2), list(NUMERIC), "doc_id", width=1 << 15, grams=("words",))
    parts = folded.Parts(rows)
    long = folded.level_one(rows, parts, ("word_logistic", "hybrid_logistic"), iterations=8)
    return evaluate.scores(folded.predictions(long.select(*folded.LONG)), ["model_name"])


@query("j7_bootstrap_interval")
def j7(spark, d):
    """Percentile interval of the accuracy over 100 Poisson resamples, drawn by hashes."""
    rows = predictions(spark, d).select("vec_id", (C("y_true") == C("y_pred")).cast("int").alias("ok"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("round"))
    u = (F.pmod(F.xxhash64("vec_id", "round"), F.lit(1_000_000)) + 0.5) / 1_000_000
    draws = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    each = rows.withColumn("w", draws).groupBy("round").agg((F.sum(C("w") * C("ok")) / F.sum("w")).alias("accuracy"))
    return each.agg(F.round(F.percentile("accuracy", 0.025), 6).alias("low"), F.round(F.percentile("accuracy", 0.975), 6).alias("high"))


@query("j18_leakage_sentinel")
def j18(spark, d):
    """Macro-F1 of a model of first halves, and of one of whole texts: what the second half adds."""
    rows, out = labelled(spark, d), None
    names = {"true": "y_true", "pred": "y_pred"}
    for mode, text in (("first_half", F.left("text", F.floor(F.length("text") / 2).cast("int"))), ("whole", C("text"))):
        got = models.out_of_fold(rows.withColumn("text", text), "bayes", 2).select(F.lit(mode).alias("mode"), C("label").cast("int").cast("string").alias("y_true"), C("y_pred").cast("string").alias("y_pred"))
        out = got if out is None else out.union(got)
    return evaluate.scores(out, ["mode"], ("0", "1"), **names)


@query("j18_sentinel_flags")
def j18_flags(spark, d):
    """Macro-F1 by text mode, how far each is above the first half's, and whether that is more than .005."""
    half = F.floor(F.length("text") / 2).cast("int")
    modes = {"first_half": F.left("text", half), "second_half": F.substr("text", half + 1, F.length("text")), "whole": C("text")}
    rows = cases(spark, d, 2).select("doc_id", "label", "fold", F.explode(F.map_from_arrays(F.array(*map(F.lit, modes)), F.array(*modes.values()))).alias("mode", "text"))
    found = folded.feature_table(rows, [], "doc_id", width=1 << 15, grams=("chars",), by=("mode",))
    out = None
    for mode in modes:
        own = found.filter(C("mode") == mode)
        long = folded.level_one(own, folded.Parts(own), ("char_bayes",))
        got = folded.predictions(long.select(*folded.LONG)).select(F.lit(mode).alias("mode"), "y_true", "y_pred")
        out = got if out is None else out.unionByName(got)
    return evaluate.inflation(evaluate.scores(out, ["mode"]), [], "mode", "first_half")
