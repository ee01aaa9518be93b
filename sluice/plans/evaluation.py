"""Queries on metrics and audits (2-J). Predictions are made of labels, embeddings and documents alike in both engines."""

from pyspark.sql import functions as F

from ..operators import evaluate as O
from ..operators import order
from .registry import query, table

C = F.col
#: y_true by the label of a vector, y_pred and probabilities by its components.
PRED = """p0 AS (SELECT vec_id, label, 0.2::DOUBLE + abs(embedding[1]::DOUBLE) AS a, 0.2::DOUBLE + abs(embedding[2]::DOUBLE) AS b, 0.2::DOUBLE + abs(embedding[3]::DOUBLE) AS c FROM embeddings),
 p AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'partial' ELSE 'not_support' END AS y_true, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc, vec_id % 5 AS fold, CASE WHEN vec_id % 2 = 0 THEN 'tree' ELSE 'linear' END AS model_name FROM p0),
 pred AS (SELECT *, CASE WHEN pa >= pb AND pa >= pc THEN 'support' WHEN pb >= pc THEN 'partial' ELSE 'not_support' END AS y_pred, greatest(pa, pb, pc) AS confidence FROM p)"""
GROUP_F1 = """cls AS (SELECT g, c AS label, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS tp, count(*) FILTER (WHERE y_pred = c) AS pp, count(*) FILTER (WHERE y_true = c) AS sp FROM rows_ CROSS JOIN (VALUES ('support'), ('partial'), ('not_support')) l(c) GROUP BY g, c),
 f AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS pr, CASE WHEN sp = 0 THEN 0 ELSE tp / sp END AS re, CASE WHEN pp + sp = 0 THEN 0 ELSE 2 * tp / (pp + sp) END AS f1 FROM cls),
 m AS (SELECT g, sum(sp)::BIGINT AS n, round(sum(tp) / sum(sp), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sp) / sum(sp), 6) AS weighted_f1 FROM f GROUP BY g)"""


def scored(group: str, select: str, where: str = "TRUE") -> str:
    return f"WITH {PRED}, rows_ AS (SELECT {group} AS g, y_true, y_pred FROM pred WHERE {where}), {GROUP_F1} {select}"


def predictions(spark, d):
    part = lambda i: F.lit(0.2) + F.abs(F.get("embedding", F.lit(i)).cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    total = C("a") + C("b") + C("c")
    rows = rows.select("vec_id", F.when(C("label") % 3 == 0, "support").when(C("label") % 3 == 1, "partial").otherwise("not_support").alias("y_true"), (C("a") / total).alias("pa"), (C("b") / total).alias("pb"), (C("c") / total).alias("pc"), (C("vec_id") % 5).alias("fold"), F.when(C("vec_id") % 2 == 0, "tree").otherwise("linear").alias("model_name"))
    pred = F.when((C("pa") >= C("pb")) & (C("pa") >= C("pc")), "support").when(C("pb") >= C("pc"), "partial").otherwise("not_support")
    return rows.withColumn("y_pred", pred).withColumn("confidence", F.greatest("pa", "pb", "pc"))


def probs():
    return [C("pa"), C("pb"), C("pc")]


@query("j1_confusion", f"WITH {PRED} SELECT model_name, a.c AS y_true, b.c AS y_pred, count(*) FILTER (WHERE p.y_true = a.c AND p.y_pred = b.c) AS n FROM pred p CROSS JOIN (VALUES ('support'), ('partial'), ('not_support')) a(c) CROSS JOIN (VALUES ('support'), ('partial'), ('not_support')) b(c) GROUP BY ALL")
def j1(spark, d):
    return O.confusion(predictions(spark, d), ["model_name"])


@query("j2_per_class", scored("model_name", "SELECT g AS model_name, label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, sp AS support FROM f"))
def j2(spark, d):
    m = O.per_class(O.confusion(predictions(spark, d), ["model_name"]), ["model_name"])
    return m.select("model_name", "label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


@query("j3_scores", scored("model_name", "SELECT g AS model_name, n, accuracy, macro_f1, weighted_f1 FROM m"))
def j3(spark, d):
    return O.scores(predictions(spark, d), ["model_name"])


@query("j4_scores_by_scope", f"WITH {PRED}, tagged AS (SELECT 'full' AS s, * FROM pred UNION ALL SELECT 'high_confidence', * FROM pred WHERE confidence >= 0.45 UNION ALL SELECT 'hard', * FROM pred WHERE confidence < 0.36), rows_ AS (SELECT s || '/' || model_name || '/' || fold AS g, y_true, y_pred FROM tagged), {GROUP_F1} SELECT g AS scope, n, accuracy, macro_f1 FROM m")
def j4(spark, d):
    scopes = F.array_compact(F.array(F.lit("full"), F.when(C("confidence") >= 0.45, "high_confidence"), F.when(C("confidence") < 0.36, "hard")))
    rows = predictions(spark, d).withColumn("s", F.explode(scopes)).withColumn("scope", F.concat_ws("/", "s", "model_name", "fold"))
    return O.scores(rows, ["scope"]).drop("weighted_f1")


@query("j5_invalid_as_wrong", f"WITH {PRED} SELECT model_name, round(avg((CASE WHEN confidence < 0.36 THEN '__invalid__' ELSE y_pred END = y_true)::INT), 6) AS accuracy, round(avg((confidence >= 0.36)::INT), 6) AS valid_rate FROM pred GROUP BY 1")
def j5(spark, d):
    said = F.coalesce(F.when(C("confidence") >= 0.36, C("y_pred")), F.lit("__invalid__"))
    return predictions(spark, d).groupBy("model_name").agg(F.round(F.avg((said == C("y_true")).cast("int")), 6).alias("accuracy"), F.round(F.avg((said != "__invalid__").cast("int")), 6).alias("valid_rate"))


@query("j6_coverage", scored("model_name", "SELECT g AS model_name, n, accuracy, round(n / (SELECT count(*) FROM pred WHERE model_name = g), 6) AS coverage FROM m", "confidence >= 0.36"))
def j6(spark, d):
    rows = predictions(spark, d)
    total = rows.groupBy("model_name").agg(F.count("*").alias("all_"))
    return O.scores(rows.filter("confidence >= 0.36"), ["model_name"]).join(total, "model_name").select("model_name", "n", "accuracy", F.round(C("n") / C("all_"), 6).alias("coverage"))


@query("j8_kappa", """WITH r AS (SELECT (quality = 1)::INT AS a, (toxic = 0)::INT AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r)
 SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t""")
def j8(spark, d):
    rows = table(spark, d, "labels").select((C("quality") == 1).cast("int").alias("a"), (C("toxic") == 0).cast("int").alias("b"))
    return O.kappa(rows, "a", "b")


GRID = [0.5, 0.75, 1.0, 1.5, 2.0]
TEMPER = ", ".join(f"({t}::DOUBLE)" for t in GRID)


@query("j9_temperature", f"WITH {PRED}, g(t) AS (VALUES {TEMPER}), z AS (SELECT t, model_name, avg(-ln(greatest(CASE y_true WHEN 'support' THEN pow(pa, 1 / t) WHEN 'partial' THEN pow(pb, 1 / t) ELSE pow(pc, 1 / t) END / (pow(pa, 1 / t) + pow(pb, 1 / t) + pow(pc, 1 / t)), 1e-12))) AS nll FROM pred CROSS JOIN g GROUP BY ALL) SELECT model_name, arg_min(t, round(nll, 9)) AS temperature, round(min(nll), 6) AS nll FROM z GROUP BY 1")
def j9(spark, d):
    rows = predictions(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, GRID))))
    each = rows.groupBy("model_name", "t").agg(F.avg(O.negative_log(C("y_true"), O.tempered(probs(), C("t")))).alias("nll"))
    return each.groupBy("model_name").agg(F.min_by("t", F.round("nll", 9)).alias("temperature"), F.round(F.min("nll"), 6).alias("nll"))


@query("j10_calibration", f"""WITH {PRED}, e AS (SELECT model_name, greatest(ceil(confidence * 10), 1) AS bin, count(*) AS n, abs(avg(confidence) - avg((y_true = y_pred)::INT)) AS gap FROM pred GROUP BY ALL), c AS (SELECT model_name, round(sum(n * gap) / sum(n), 6) AS ece FROM e GROUP BY 1),
 b AS (SELECT model_name, round(avg(pow(pa - (y_true = 'support')::INT, 2) + pow(pb - (y_true = 'partial')::INT, 2) + pow(pc - (y_true = 'not_support')::INT, 2)), 6) AS brier, round(avg(-ln(CASE y_true WHEN 'support' THEN pa WHEN 'partial' THEN pb ELSE pc END)), 6) AS nll FROM pred GROUP BY 1) SELECT model_name, ece, brier, nll FROM c JOIN b USING (model_name)""")
def j10(spark, d):
    rows = predictions(spark, d)
    ece = O.calibration_error(rows, ["model_name"], C("confidence"), C("y_true") == C("y_pred"))
    rest = rows.groupBy("model_name").agg(F.round(F.avg(O.brier(C("y_true"), probs())), 6).alias("brier"), F.round(F.avg(O.negative_log(C("y_true"), probs())), 6).alias("nll"))
    return ece.join(rest, "model_name")


@query("j11_confidence_summary", f"WITH {PRED} SELECT model_name, round(avg((confidence < 0.36)::INT), 6) AS low, round(avg((confidence < 0.4)::INT), 6) AS middling, round(avg((confidence >= 0.45 AND y_pred <> y_true)::INT), 6) AS overconfident FROM pred GROUP BY 1")
def j11(spark, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return predictions(spark, d).groupBy("model_name").agg(share(C("confidence") < 0.36).alias("low"), share(C("confidence") < 0.4).alias("middling"), share((C("confidence") >= 0.45) & (C("y_pred") != C("y_true"))).alias("overconfident"))


@query("j12_threshold_table", f"WITH {PRED}, th AS (SELECT unnest(range(0, 21)) AS k), tot AS (SELECT count(*) AS all_ FROM pred), rows_ AS (SELECT k AS g, y_true, y_pred FROM pred JOIN th ON confidence >= k * 0.05::DOUBLE), {GROUP_F1} SELECT g::INT AS step, n, round(n / all_, 6) AS coverage, accuracy, macro_f1 FROM m, tot")
def j12(spark, d):
    rows = predictions(spark, d)
    steps = F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: C("confidence") >= k * 0.05)
    total = rows.agg(F.count("*").alias("all_"))
    table_ = O.scores(rows.withColumn("step", F.explode(steps)), ["step"]).crossJoin(F.broadcast(total))  # one row
    return table_.select("step", "n", F.round(C("n") / C("all_"), 6).alias("coverage"), "accuracy", "macro_f1")


@query("j13_coverage_curve", f"WITH {PRED}, q AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS c, unnest(quantile_cont(confidence, [0.75, 0.5, 0.25])) AS t FROM pred), rows_ AS (SELECT c AS g, y_true, y_pred FROM pred JOIN q ON confidence >= t), {GROUP_F1} SELECT g AS coverage, n, accuracy FROM m")
def j13(spark, d):
    rows = predictions(spark, d)
    cuts = order.quantiles(rows, "confidence", [0.75, 0.5, 0.25]).select((0.25 * (C("q") + 1)).alias("coverage"), C("value").alias("t"))
    kept = rows.join(F.broadcast(cuts), rows.confidence >= cuts.t)  # three rows
    return O.scores(kept, ["coverage"]).select("coverage", "n", "accuracy")


@query("j14_threshold_choice", f"WITH {PRED}, q AS (SELECT unnest(range(1, 20)) AS k, unnest(quantile_cont(confidence, [{', '.join(str(k / 20) for k in range(1, 20))}])) AS t FROM pred), a AS (SELECT k, avg((y_true = y_pred)::INT) AS acc, count(*) / (SELECT count(*) FROM pred) AS cov FROM pred JOIN q ON confidence >= t GROUP BY k) SELECT k::INT AS quantile, round(acc, 6) AS accuracy, round(cov, 6) AS coverage FROM a WHERE cov >= 0.3 ORDER BY round(acc, 9) DESC, cov DESC LIMIT 1")
def j14(spark, d):
    rows = predictions(spark, d)
    cuts = order.quantiles(rows, "confidence", [k / 20 for k in range(1, 20)]).select(C("q").alias("i"), C("value").alias("t")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_"))))  # one row
    each = rows.join(F.broadcast(cuts), C("confidence") >= C("t")).groupBy("i", "all_").agg(F.avg((C("y_true") == C("y_pred")).cast("int")).alias("acc"), F.count("*").alias("n"))  # 19 rows
    each = each.withColumn("cov", C("n") / C("all_")).filter("cov >= 0.3")
    return each.orderBy(F.round("acc", 9).desc(), C("cov").desc()).limit(1).select((C("i") + 1).alias("quantile"), F.round("acc", 6).alias("accuracy"), F.round("cov", 6).alias("coverage"))  # the best one


CROSSFIT = f"""WITH {PRED}, o AS (SELECT f.k AS outer_, pred.*, (y_true = y_pred)::INT AS ok FROM pred JOIN (SELECT unnest(range(0, 5)) AS k) f ON fold <> f.k),
 q AS (SELECT outer_, unnest(range(1, 20)) AS k, unnest(quantile_cont(confidence, [{', '.join(str(k / 20) for k in range(1, 20))}])) AS t FROM o GROUP BY outer_),
 a AS (SELECT q.outer_, k, t, avg(ok) AS acc, count(*) / any_value(n.n) AS cov FROM q JOIN o ON o.outer_ = q.outer_ AND confidence >= t JOIN (SELECT outer_, count(*) AS n FROM o GROUP BY 1) n ON n.outer_ = q.outer_ GROUP BY ALL),
 b AS (SELECT outer_, k, t FROM a WHERE cov >= 0.3 QUALIFY row_number() OVER (PARTITION BY outer_ ORDER BY round(acc, 9) DESC, cov DESC, k) = 1)
 SELECT fold, any_value(k)::INT AS quantile, count(*) FILTER (WHERE confidence >= t) AS kept, round(count(*) FILTER (WHERE confidence >= t) / count(*), 6) AS coverage, round(avg((y_true = y_pred)::INT) FILTER (WHERE confidence >= t), 6) AS accuracy FROM pred JOIN b ON outer_ = fold GROUP BY fold"""


@query("j14_threshold_crossfit", CROSSFIT)
def j14_crossfit(spark, d):
    """Each fold by the threshold that is best on the other folds: chosen and judged on different rows."""
    return O.crossfit_threshold(predictions(spark, d), "fold", list(range(5)), C("confidence"), C("y_true") == C("y_pred"), 20, 0.3)


@query("j15_target_prefix", f"WITH {PRED}, r AS (SELECT model_name, row_number() OVER w AS n, avg((y_true = y_pred)::INT) OVER w AS acc FROM pred WINDOW w AS (PARTITION BY model_name ORDER BY confidence DESC, vec_id ROWS UNBOUNDED PRECEDING)) SELECT model_name, max(n) AS n FROM r WHERE acc >= 0.3 GROUP BY 1")
def j15(spark, d):
    return order.longest_prefix(predictions(spark, d), ["model_name"], [F.desc("confidence"), C("vec_id")], C("y_true") == C("y_pred"), 0.3)


@query("j16_recompute", f"WITH {PRED}, rows_ AS (SELECT model_name AS g, y_true, y_pred FROM pred), {GROUP_F1} SELECT g AS model_name, abs(accuracy - 0.33::DOUBLE) < 0.0005 AS agrees, round(abs(accuracy - 0.33::DOUBLE), 6) AS gap FROM m")
def j16(spark, d):
    reported = spark.createDataFrame([("tree", 0.33), ("linear", 0.33)], "model_name string, reported double")
    gap = F.abs(C("accuracy") - C("reported"))
    return O.scores(predictions(spark, d), ["model_name"]).join(reported, "model_name", "full").select("model_name", (gap < 0.0005).alias("agrees"), F.round(gap, 6).alias("gap"))


@query("j24_error_category", f"WITH {PRED} SELECT CASE WHEN y_true = y_pred THEN 'correct' WHEN confidence >= 0.45 THEN 'confident_error' WHEN y_true = 'partial' OR y_pred = 'partial' THEN 'boundary' ELSE 'reversal' END AS category, count(*) AS n FROM pred GROUP BY 1")
def j24(spark, d):
    kind = F.when(C("y_true") == C("y_pred"), "correct").when(C("confidence") >= 0.45, "confident_error").when((C("y_true") == "partial") | (C("y_pred") == "partial"), "boundary").otherwise("reversal")
    return predictions(spark, d).groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@query("j27_compare_runs", scored("fold % 2", "SELECT a.g AS run, a.accuracy AS a, b.accuracy AS b, round(b.accuracy - a.accuracy, 6) AS delta FROM m a JOIN m b ON a.g = 0 AND b.g = 1"))
def j27(spark, d):
    m = O.scores(predictions(spark, d).withColumn("run", C("fold") % 2), ["run"])
    pair = m.filter("run = 0").select("run", C("accuracy").alias("a")).crossJoin(m.filter("run = 1").select(C("accuracy").alias("b")))  # one row each
    return pair.select("run", "a", "b", F.round(C("b") - C("a"), 6).alias("delta"))


@query("j28_dataset_validation", "SELECT count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) AS outside, count(*) - count(DISTINCT doc_id) AS repeated FROM documents")
def j28(spark, d):
    return table(spark, d, "documents").agg(F.count(F.when(~C("lang").isin("en", "de", "fr"), 1)).alias("outside"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"))


@query("j29_auc_log_loss", f"WITH {PRED}, r AS (SELECT (y_true = 'support')::INT AS y, round(pa, 9) AS s FROM pred), k AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r), n AS (SELECT sum(y) AS p, count(*) - sum(y) AS q FROM r) SELECT round((sum(rk * y) - any_value(p * (p + 1) / 2)) / any_value(p * q), 6) AS auc, round((SELECT avg(-(y * ln(s) + (1 - y) * ln(1 - s))) FROM r), 6) AS log_loss FROM k, n")
def j29(spark, d):
    rows = predictions(spark, d).select((C("y_true") == "support").cast("int").alias("y"), F.round("pa", 9).alias("s"))
    loss = rows.agg(F.round(F.avg(-(C("y") * F.log("s") + (1 - C("y")) * F.log(1 - C("s")))), 6).alias("log_loss"))
    return order.auc(rows, C("y"), C("s")).select(F.round("auc", 6).alias("auc")).crossJoin(loss)  # one row each


@query("j17_known_only", f"WITH {PRED}, tagged AS (SELECT 'all' AS s, * FROM pred UNION ALL SELECT 'known', * FROM pred WHERE fold <> 4), rows_ AS (SELECT s AS g, y_true, y_pred FROM tagged), {GROUP_F1} SELECT g AS scope, n, accuracy, macro_f1 FROM m")
def j17(spark, d):
    scopes = F.array_compact(F.array(F.lit("all"), F.when(C("fold") != 4, "known")))
    return O.scores(predictions(spark, d).withColumn("scope", F.explode(scopes)), ["scope"]).drop("weighted_f1")


@query("j23_verifier_flag", f"WITH {PRED} SELECT vec_id, (confidence < 0.36 OR abs(pa - pb) < 0.01 OR fold = 4) AS flagged FROM pred")
def j23(spark, d):
    return predictions(spark, d).select("vec_id", ((C("confidence") < 0.36) | (F.abs(C("pa") - C("pb")) < 0.01) | (C("fold") == 4)).alias("flagged"))


@query("j26_aggregates", f"WITH {PRED} SELECT fold, round(avg(confidence), 6) AS confidence, round(avg((confidence < 0.4)::INT), 6) AS uncertain, count(DISTINCT y_pred) AS kinds FROM pred GROUP BY 1")
def j26(spark, d):
    return predictions(spark, d).groupBy("fold").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg((C("confidence") < 0.4).cast("int")), 6).alias("uncertain"), F.count_distinct("y_pred").alias("kinds"))


@query("g21_slices", f"WITH {PRED}, tagged AS (SELECT 'fold' || fold AS s, * FROM pred UNION ALL SELECT model_name, * FROM pred), rows_ AS (SELECT s AS g, y_true, y_pred FROM tagged), {GROUP_F1} SELECT g AS slice, n, accuracy, macro_f1, weighted_f1 FROM m")
def g21(spark, d):
    names = F.array(F.concat(F.lit("fold"), C("fold").cast("string")), "model_name")
    return O.scores(predictions(spark, d).withColumn("slice", F.explode(names)), ["slice"])


@query("j21_run_delta", f"""WITH {PRED}, rows_ AS (SELECT model_name || '/' || CASE WHEN confidence >= 0.45 THEN 'sure' ELSE 'unsure' END AS g, y_true, y_pred FROM pred), {GROUP_F1},
 v AS (SELECT split_part(g, '/', 1) AS run, split_part(g, '/', 2) AS scope, unnest(['accuracy', 'macro_f1', 'weighted_f1']) AS metric, unnest([accuracy, macro_f1, weighted_f1]) AS v FROM m),
 b AS (SELECT coalesce(o.scope, n.scope) AS scope, coalesce(o.metric, n.metric) AS metric, o.v AS old_value, n.v AS new_value, round(n.v - o.v, 6) AS delta FROM (SELECT * FROM v WHERE run = 'linear') o FULL JOIN (SELECT * FROM v WHERE run = 'tree') n ON o.scope = n.scope AND o.metric = n.metric)
 SELECT *, CASE WHEN delta IS NULL THEN 'missing' WHEN delta < 0 THEN 'worse' WHEN delta > 0 THEN 'better' ELSE 'same' END AS status FROM b""")
def j21(spark, d):
    scope = F.when(C("confidence") >= 0.45, "sure").otherwise("unsure")
    m = O.scores(predictions(spark, d).withColumn("scope", scope), ["model_name", "scope"])
    run = lambda name: m.filter(C("model_name") == name).drop("model_name")
    return O.run_delta(run("linear"), run("tree"), ["scope"], ["accuracy", "macro_f1", "weighted_f1"])


@query("j25_error_table", f"""WITH {PRED} SELECT vec_id, y_true, y_pred, round(confidence, 6) AS confidence, left(trim(replace(text, chr(10), ' ')), 240) AS snippet, array_to_string(list_filter(string_split(text, '. ')[1:3], lambda x: x <> ''), ' | ') AS sentences
 FROM pred LEFT JOIN documents ON doc_id = vec_id WHERE y_true <> y_pred""")
def j25(spark, d):
    wrong = predictions(spark, d).filter("y_true <> y_pred")
    docs = table(spark, d, "documents").select(C("doc_id").alias("vec_id"), F.left(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(240)).alias("snippet"), O.preview(F.split("text", "\\. "), 3).alias("sentences"))
    return wrong.join(docs, "vec_id", "left").select("vec_id", "y_true", "y_pred", F.round("confidence", 6).alias("confidence"), "snippet", "sentences")
