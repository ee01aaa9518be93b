"""Text, features and labels on a small corpus with Chinese judgments of our own wording."""

import time

from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.operators import evaluate, features, fuse, labels, pools, sample
from sluice.operators import sets as S

ZH = "原告主张工期延误。被告辩称已通知监理！二〇一九年竣工；\n会议纪要证明停工。本院认为应部分支持。"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_sentences_keep_their_places(spark):
    got = one(spark, T.sentences(F.col("t"), "。！；\n"), t="  " + ZH)
    assert all(("  " + ZH)[s.span_start : s.span_end] == s.text for s in got) and len(got) == 5


def test_years(spark):
    assert one(spark, T.case_year(F.col("t")), t=ZH) == 2019
    assert one(spark, T.case_year(F.col("t")), t="案号(2021)") == 2021 and one(spark, T.case_year(F.col("t")), t="1899年") is None
    assert one(spark, T.first_year(F.col("t")), t="0001 9999 1987") == 1987


def test_ids_and_blanks(spark):
    assert [one(spark, T.plain_id(F.col("t")), t=t) for t in ("12.0", "nan", "x7", None)] == ["12", "", "x7", ""]
    assert one(spark, T.first_filled(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"


def test_split_and_compaction(spark):
    s = one(spark, T.split_at_anchor(F.col("t"), ["本院认为", "判决如下"]), t=ZH)
    assert s.pre.endswith("停工。") and s.post.startswith("本院认为") and s.confidence == 0.9
    assert one(spark, T.split_at_anchor(F.col("t"), ["x"]), t="0123456789").pre == "0123456"
    assert one(spark, T.compact(F.col("t"), 20, 0.5, 0.4, ["k"], "."), t="aaaaaaaaaa" + "bb." + "kkkkk." + "ckckc." + "zzk.") == "aaaaaaaaaa\nkkkkk.ckc"


def test_chain(spark):
    roles = {"notice": ["通知"], "cause": ["延误"], "again": ["监理"], "none": ["火星"]}
    chain = one(spark, features.evidence_chain(T.sentences(F.col("t"), "。！；\n"), roles), t=ZH)
    assert [(u.role, u.span_start >= 0, u.duplicate) for u in chain] == [("notice", True, 0), ("cause", True, 0), ("again", True, 1), ("none", False, 0)]
    m = one(spark, features.chain_metrics(features.evidence_chain(T.sentences(F.col("t"), "。！；\n"), roles)), t=ZH)
    assert (m.valid, m.duplicate, m.missing) == (0.75, 0.25, 0.25)


def test_labels(spark):
    assert [one(spark, labels.outcome(F.col("t"), contained=labels.CONTAINED), t=t) for t in (" Partial_Support ", "部分予以支持", "不予支持", "支持", None)] == ["partial", "partial", "not_support", "support", "unknown"]
    reply = 'text ```json\n{"outcome_label": "support", "confidence": 0.8}\n```'
    assert one(spark, labels.model_json(F.col("t")), t=reply) == '{"outcome_label": "support", "confidence": 0.8}' and one(spark, labels.model_json(F.col("t")), t="none") is None
    assert [one(spark, labels.clamp(F.col("t"), 0.5), t=t) for t in ("1.7", "-3", "x", None)] == [1.0, 0.0, 0.5, 0.5]
    spans = one(spark, labels.span_checks(F.col("t"), F.array(F.lit("停工"), F.lit("absent"), F.lit("停工"))), t=ZH)
    assert [(s.start, s.valid, s.duplicate) for s in spans] == [(ZH.index("停工"), 1, 0), (-1, 0, 0), (ZH.index("停工"), 1, 1)]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "support", "support"), ("a", "partial", "partial"), ("a", "not_support", "partial"), ("a", "support", "??")], "g string, y_true string, y_pred string")
    r = evaluate.scores(rows, ["g"]).first()
    assert (r.n, r.accuracy, r.macro_f1) == (3, 0.666667, round((1 + 2 / 3) / 3, 6))
    assert evaluate.kappa(spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "y"), ("y", None)], "a string, b string"), "a", "b").first().kappa == 0.4


def test_invariants(spark):
    ids = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("label"))
    split = sample.stratified(ids, "label", "id", 1, F.floor(F.col("n") * 0.2)).cache()
    assert split.count() == 200 and split.filter("split = 'dev'").count() == 39
    assert {r["count"] for r in sample.balanced(ids, "label", "id", 1).groupBy("label").count().collect()} == {66}
    probs = fuse.normalised([F.lit(0.2), F.lit(0.2), F.lit(0.6)])
    assert abs(one(spark, sum(probs[1:], probs[0]), t="") - 1) < 1e-12 and one(spark, fuse.argmax([F.lit(0.4), F.lit(0.4), F.lit(0.2)]), t="") == "support"
    assert S.numbered(spark.range(50), F.col("id")).filter("position <> id + 1").count() == 0
    assert pools.funnel(ids, [("all", F.lit(True)), ("even", F.col("id") % 2 == 0)]).collect()[1].n == 100


def test_offsets_of_long_arrays(spark):
    sizes = [k % 7 for k in range(1000)]
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.createDataFrame([(sizes[:n],)], "s array<int>").select(T.offsets(F.col("s")).alias("o")).first().o
        assert got == [sum(sizes[:i]) for i in range(n)]


def test_sentences_of_a_long_text(spark):
    text = " A short one. " * 50_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(F.size(T.sentences(F.col("t"))).alias("n"), F.get(T.sentences(F.col("t")), 40_000).alias("s")).first()
    assert got.n == 50_000 and text[got.s.span_start : got.s.span_end] == got.s.text == "A short one." and got.s.span_start == 40_000 * 14 + 1
    assert time.time() - began < 60
