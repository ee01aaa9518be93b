"""Defined results of records, views and choices for nulls, empty tables, ties and clashing names."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import evaluate, features, fuse, labels, pools, sample

C = F.col
PARTS = "id long, kind string, a double, b int, place int"


def chosen(df, preferred, n, eligible=None):
    got = pools.representatives(df, "kind", preferred, ["a", "b"], "id", n, F.lit(True) if eligible is None else eligible)
    return [r.id for r in got.orderBy("position").collect()]


def test_representatives(spark):
    rows = [(1, "x", 0.5, 1, 7), (2, "x", 0.9, 1, 7), (3, "y", 0.9, 1, 7), (4, "y", 0.9, 2, 7), (5, None, None, None, 7), (6, "z", 1.0, 0, 7), (7, "z", 1.0, 0, 7)]
    df = spark.createDataFrame(rows, PARTS)
    assert chosen(df, ["y", "none", "x"], 4) == [4, 2, 6, 7]
    assert chosen(df, ["y", "x"], 1) == [4] and chosen(df, [], 9) == [6, 7, 4, 2, 3, 1, 5]
    assert chosen(df, ["x"], 3, C("place") > 7) == [2, 6, 7] and chosen(df, ["x"], 3, C("kind") == "y") == [4, 3]
    assert chosen(df.limit(0), ["x"], 3) == []


def test_minority_views(spark):
    df = spark.createDataFrame([(1, "Late. Fine!\nVery late", 1), (2, None, 1), (3, "Late.", 0), (4, "ok", 1)], "id long, text string, made int")
    got = {r.id: (r.source_key, r.text, r.made) for r in sample.minority_views(df, "id", "text", C("made") == 1, F.left("text", F.lit(4)), F.lit(None).cast("string"), ["ate"]).collect()}
    assert got == {"1__aug1": (1, "Late\nevidence: ", 1), "1__aug2": (1, "Late.\nVery late", 1), "2__aug1": (2, "\nevidence: ", 1), "4__aug1": (4, "ok\nevidence: ", 1)}
    assert sample.minority_views(df.limit(0), "id", "text", F.lit(True), C("text"), C("text"), ["x"]).count() == 0


def test_record_checks_and_replies_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("Case ID: 7\nA: 中文 won\nB:  \n", "support"), (" ", "odd")], "r string, l string")
    checks = features.record_checks(C("r"), C("l"), "Case ID", ["A", "B"], 2, ["won"], labels.OUTCOMES)
    got = [tuple(r) for r in df.select(*checks).collect()]
    empty = ("", True, False, False, 2, "A|B", False, "", 1, 0)
    assert got == [(*empty, 0, False), ("7", False, True, True, 1, "B", True, "won", 7, 2, 26, True), (*empty, 1, False)]
    said = df.select(F.lit(None).cast("map<string,string>").alias("m"), "r").select(*labels.response_record(C("m"), C("r"), F.lit(None), {"owner": ["o"]})).first()
    assert (said.outcome_label, said.primary_responsible_party, said.responsibility_type, said.uncertainty_flag, said.span_count, said.valid_rate) == ("unknown", "unknown", "uncertain", 1, 0, 0.0)


def test_trace_of_nulls(spark):
    words = dict.fromkeys(("issue", "basis", "procedure", "records", "repair", "keep"), "w")
    null = F.lit(None)
    trace = fuse.reasoning_trace(C("id"), null, null, F.array(), null.cast(f"array<{features.UNIT}>"), F.lit("uncertain"), null, null, null.cast("double"), null, words, "e", ["x"])
    got = spark.range(1).select(trace.alias("t")).first().t
    assert got.rule_basis == [] and got.application_findings == [] and got.management_action == ["w"] and got.leakage_check == 1 and got.high_dispute_flag == 1


def test_recomputed_and_risks(spark):
    pred = spark.createDataFrame([("a", "support", "support"), ("a", "partial", "support"), ("b", "partial", "partial")], "g string, y_true string, y_pred string")
    told = spark.createDataFrame([("a", 0.5, None, None), ("c", 1.0, 1.0, 1.0)], "g string, accuracy double, macro_f1 double, weighted_f1 double")
    got = {r.g: (r.n, r.metric_match, r.traceability_status) for r in evaluate.recomputed(pred, told, ["g"]).collect()}
    assert got == {"a": (2, 1, "complete"), "b": (1, 1, "complete"), "c": (0, 0, "unverifiable")}
    runs = spark.createDataFrame([("new", "pre", 0.5), ("old", "both", 0.56), ("odd", None, None)], "run string, mode string, f double")
    risks = {r.old_run: (r.score_inflation_risk, r.impact_band, r.impact) for r in evaluate.run_risks(runs, "run", "new", {"m": ("mode", ["both"])}, "f").collect()}
    assert risks == {"old": ("yes", "large", pytest.approx(0.06)), "odd": ("unclear", "unknown", None)}
    assert evaluate.run_risks(runs, "run", "none", {"m": ("mode", [])}, "f").count() == 0


def test_pools_of_nulls(spark):
    null = F.lit(None).cast("int")
    assert tuple(spark.range(1).select(*pools.lexical_pools(null, null, null, null.cast("boolean"), null, null, null)).first()) == (0, 0, 0, 0)
