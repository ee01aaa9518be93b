import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.operators import evaluate, fuse, labels, pools, sample, tabular
from sluice.operators.labels import OUTCOMES

C = F.col


def macro(true, pred):
    out = []
    for c in OUTCOMES:
        tp, n = sum(t == c == p for t, p in zip(true, pred, strict=True)), sum(t == c for t in true) + sum(p == c for p in pred)
        out.append(2 * tp / n if n else 0.0)
    return sum(out) / 3


def test_bootstrap_interval_is_close_to_resampling(spark):
    rng = np.random.default_rng(1)
    true = rng.choice(OUTCOMES, 600, p=[0.5, 0.3, 0.2])
    pred = np.where(rng.random(600) < 0.7, true, rng.choice(OUTCOMES, 600))
    df = spark.createDataFrame([("m", str(t), str(p)) for t, p in zip(true, pred, strict=True)] + [("m", "unknown", "support")], "m string, y_true string, y_pred string")
    got = evaluate.bootstrap_macro_f1(df, ["m"], 600).first()
    drawn = [macro(true[i], pred[i]) for i in (rng.integers(0, 600, 600) for _ in range(600))]
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert abs(got["macro_f1"] - macro(true, pred)) < 1e-6 and abs(got["low"] - low) < 0.015 and abs(got["high"] - high) < 0.015
    assert tuple(got) == tuple(evaluate.bootstrap_macro_f1(df.repartition(5), ["m"], 600).first()), "the same draws on any layout"
    assert evaluate.bootstrap_macro_f1(df.limit(0), ["m"]).count() == 0


def test_majority_breaks_ties_by_mean_confidence(spark):
    rows = [(1, "support", 0.5), (1, "partial", 0.9), (2, "partial", 0.4), (2, "partial", 0.2), (2, "support", 0.99), (3, "odd", 1.0), (3, None, 1.0), (4, "support", None), (4, "nothing", 0.1), (5, "not_support", 0.5), (5, "partial", 0.5)]
    df = spark.createDataFrame(rows, "c long, l string, p double")
    got = {r["c"]: tuple(r)[1:] for r in fuse.majority(df, "c", "l", C("p")).collect()}
    assert got == {1: ("partial", 0.9, 0.5), 2: ("partial", 0.3, 0.666667), 3: ("unknown", 0.0, 0.0), 4: ("support", 0.0, 1.0), 5: ("partial", 0.5, 0.5)}
    assert fuse.majority(df.limit(0), "c", "l", C("p")).count() == 0


def test_consensus_and_switch(spark):
    rows = [(["partial", "support", "support", "unknown"],), (["partial", "support"],), (["unknown", None],), ([],)]
    df = spark.createDataFrame(rows, "v array<string>").withColumn("g", fuse.consensus(C("v")))
    assert [tuple(r["g"]) for r in df.collect()] == [("support", 0.5), ("partial", 0.5), (None, 0.0), (None, 0.0)]
    says = lambda base, agreement, top, margin: fuse.switched(F.lit(base), F.lit("support"), F.lit(agreement), F.lit(top), F.lit(margin))
    assert tuple(spark.range(1).select(says("partial", 0.5, "support", 0.08), says("support", 0.9, "support", 0.9), says("partial", 0.4, "support", 0.9), says("partial", 0.9, "partial", 0.9), says("partial", 0.9, "support", 0.07), says("partial", 0.9, None, 0.9)).first()) == (True, False, False, False, False, False)


@pytest.mark.parametrize(
    "case,bucket,reason",
    [
        ({"frozen": True}, "frozen_test", "candidate_or_frozen_test_excluded"), ({"dup": True}, "discarded", "duplicate_case"), ({"status": "timeout"}, "discarded", "api_not_available"), ({"status": None}, "strong_label_train_candidate", ""),
        ({"label": "unknown"}, "discarded", "invalid_or_unknown_label"), ({"label": None}, "discarded", "invalid_or_unknown_label"), ({"length": 10}, "discarded", "short_pre_decision_text"), ({"substantive": 0}, "rag_only", "no_substantive_decision_content"),
        ({"substantive": 0, "rel": 0.5}, "discarded", "no_substantive_decision_content"), ({"procedural": 1}, "discarded", "procedural_only"), ({}, "strong_label_train_candidate", ""), ({"review": 1}, "weak_label_candidate", ""), ({"rel": 0.6}, "rag_only", ""), ({"rel": 0.1}, "discarded", ""),
    ],
)
def test_existing_label_rules(spark, case, bucket, reason):
    c = {"frozen": False, "dup": False, "status": "api_available", "label": "support", "length": 3000, "substantive": 1, "procedural": 0, "review": 0, "rel": 1.0} | case
    x = {k: F.lit(v) for k, v in c.items()}
    score = labels.existing_label_score(x["rel"], x["substantive"], F.lit(1.0), F.lit(0.9), F.lit(1), F.lit(1.0), F.lit(1.0), x["length"])
    made = labels.existing_label_bucket(score, x["label"], x["frozen"], x["dup"], x["status"], x["rel"], x["substantive"], x["procedural"], F.lit(1.0), x["review"], F.lit(0.9), x["length"])
    assert tuple(spark.range(1).select(made.alias("m")).first()["m"]) == (bucket, reason)


def test_contradictions_look_at_eight_items(spark):
    rows = [("support", "fine", [("support", "no")]), ("not_support", "yes", []), ("partial", "", None), ("unknown", "no", [("x", "yes")]), (None, None, [(None, None)] * 8 + [("support", "no")]), ("unknown", "no", [])]
    df = spark.createDataFrame(rows, "l string, r string, i array<struct<label:string,evidence:string>>")
    got = [tuple(r["f"]) for r in df.select(labels.contradictions(C("l"), C("r"), C("i"), ["yes"], ["no"], ["some"]).alias("f")).collect()]
    assert got == [("item_support_but_not_kw", "support_but_not_keywords"), ("not_support_but_support_keywords",), ("partial_without_partial_markers",), ("unknown_but_has_disposition_keywords",), (), ()]


def test_label_queue_counts_and_order(spark):
    rows = [(1, "a", False, 900), (2, "a", False, 900), (3, "b", True, 900), (4, "b", False, 900), (5, None, False, 100), (6, "c", None, 950), (7, "d", False, 950)]
    df = spark.createDataFrame(rows, "id long, h string, known boolean, chars long")
    queue, report = pools.label_queue(df, [("known", C("known"))], [("short", C("chars") < 500)], "h", "id", [F.desc("chars")])
    assert [(r["id"], r["position"]) for r in queue.orderBy("position").collect()] == [(6, 1), (7, 2), (1, 3)]
    assert [(r["metric"], r["value"]) for r in report.orderBy("place").collect()] == [("source_rows", 7), ("queue_rows", 3), ("known", 1), ("repeated_text", 2), ("short", 1)]
    ranked = pools.ranked_pool(df, [C("chars") > 500, ~F.coalesce(C("known"), F.lit(False))], "h", "id", C("chars") * 1.0)
    assert [(r["id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(6, 1), (7, 2), (1, 3), (4, 4)]


def test_training_pairs_keep_splits_apart(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randint(0, 30)}", rng.choice(["x", "y", "z"]), rng.randint(0, 2)) for i in range(3000)] + [(9000, None, "x", 1), (None, "s1", "x", 1), (5, "s1", "x", 1)]
    rows[-1] = rows[5]
    df = spark.createDataFrame(rows, "k long, s string, c string, r int")
    got = sample.training_pairs(df, "k", "s", "c", "r", 3).collect()
    of = {r[0]: r[1:] for r in rows[:3000]}
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("positive", "near", "hard", "random")}
    assert len(kinds["positive"]) == 3000 and all(len(v) > 200 for v in kinds.values())
    negatives = len(got) - 3000
    assert 0.2 < negatives / len(got) <= 0.32
    assert all(r["key"] != r["match"] and r["label"] == 0 for k in ("near", "hard", "random") for r in kinds[k])
    assert all(of[r["key"]][1] == of[r["match"]][1] for r in kinds["near"]) and all(of[r["key"]][0] == of[r["match"]][0] and of[r["key"]][2] != of[r["match"]][2] for r in kinds["hard"]) and all(of[r["key"]][1] != of[r["match"]][1] for r in kinds["random"])
    train, held = ({x for r in got if r["split"] == s for x in (r["key"], r["match"])} for s in ("train", "validation"))
    assert not train & held and held
    assert len({(r["category"], r["match"], r["key"]) for r in got}) == len(got)
    assert sample.training_pairs(df.limit(0), "k", "s", "c", "r", 3).count() == 0


def test_row_statistics_and_useless_columns(spark):
    rows = [(1, 1.0, None, float("inf"), 3.0, 2.0), (2, float("nan"), None, 5.0, 3.0, 4.0), (3, None, None, None, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, none double, b double, same double, c double")
    got = {r["id"]: tuple(r)[-7:] for r in tabular.row_statistics(df, ["a", "none", "b", "c"]).collect()}
    assert got[1] == (1.5, pytest.approx(0.5**0.5), 1.0, 2.0, 1.5, 2, 1.5) and got[2][:1] == (4.5,) and got[3] == (None, None, None, None, None, 4, None)
    assert {r["name"]: r["dropped"] for r in tabular.useless(df, ["a", "none", "b", "same", "c"]).collect()} == {"a": False, "none": True, "b": False, "same": True, "c": False}
    kept = tabular.without_useless(df, ["a", "none", "b", "same", "c"])
    assert kept.columns == ["id", "a", "b", "c"] and kept.first()["b"] is None


def test_abstraction_rules(spark):
    rules = [("a", r"\d+", "numbers {0}"), ("a", "x", "an x"), ("a", "y", "a y"), ("b", "z", "a z")]
    df = spark.createDataFrame([("7 x y 8 7 9 10",), ("z",), (None,), ("",)], "t string")
    got = [tuple(r["s"]) for r in df.select(T.abstracted(C("t"), rules, {"a": 2, "b": 1}, {"a": "none", "b": "-"}).alias("s")).collect()]
    assert got == [("numbers 7, 8, 9; an x", "-"), ("none", "a z"), ("none", "-"), ("none", "-")]


def test_ablation_replaces_columns_by_setting(spark):
    df = spark.createDataFrame([("support", 1), ("partial", 0), ("unknown", 1)], "y_true string, x int")
    score = lambda d: d.withColumn("y_pred", F.when(C("x") == 1, "support").otherwise("partial"))
    got = {r["setting"]: tuple(r)[1:] for r in evaluate.ablation(df, {"full": {}, "none": {"x": F.lit(0)}}, score, {"share": "x"}).collect()}
    assert got == {"full": (1.0, 0.666667, 1.0, 0.666667), "none": (0.5, 0.222222, 0.333333, 0.0)}
