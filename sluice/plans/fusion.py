"""Queries on retrieval, votes and fusion (2-K)."""

from pyspark.sql import functions as F

from ..operators import fuse as O
from ..operators import retrieve
from .evaluation import PRED, predictions, probs
from .registry import query, table

C = F.col


@query("k5_majority", "SELECT d.doc_id, (SELECT arg_max(lang, (n, lang)) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS y_pred FROM documents d")
def k5(spark, d):
    docs = table(spark, d, "documents")
    major = docs.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max_by("lang", F.struct("n", "lang")).alias("y_pred"))
    return docs.select("doc_id").crossJoin(F.broadcast(major))  # one row


@query("k7_fallback", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'support' END, CASE WHEN l.toxic = 1 THEN 'not_support' END, CASE WHEN n_chars > 1000 THEN 'partial' ELSE 'not_support' END) AS y_pred FROM documents d LEFT JOIN labels l USING (doc_id)")
def k7(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.when(C("quality") == 1, "support"), F.when(C("toxic") == 1, "not_support"), F.when(C("n_chars") > 1000, "partial").otherwise("not_support")).alias("y_pred"))


TOK = "tok AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM benchmark), x AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM tok), s AS (SELECT a.item_id AS query, b.item_id AS match, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity FROM x a JOIN x b ON a.w = b.w AND a.item_id <> b.item_id GROUP BY ALL)"


def items_of(spark, d):
    return table(spark, d, "benchmark").select("item_id", O.tokens(C("text")).alias("t"), (C("item_id") % 3).alias("label"))


def nearest(spark, d, k, group=None):
    items = items_of(spark, d)
    return retrieve.nearest_by_items(items, items, "item_id", "t", k, group)


def pairs(spark, d):
    items = items_of(spark, d)
    return O.jaccard_pairs(items, items, "item_id", "t")


@query("k9_token_jaccard", f"WITH {TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) AS rank FROM s) SELECT query, match, similarity, rank::INT AS rank FROM r WHERE rank <= 5")
def k9(spark, d):
    return nearest(spark, d, 5)


@query("k10_label_aware", f"WITH {TOK}, r AS (SELECT *, match % 3 AS label, row_number() OVER (PARTITION BY query, match % 3 ORDER BY similarity DESC, match) AS rank FROM s) SELECT query, label, round(avg(similarity), 6) AS mean FROM r WHERE rank <= 3 GROUP BY ALL")
def k10(spark, d):
    near = nearest(spark, d, 3, "label")
    return near.groupBy("query", "label").agg(F.round(F.avg("similarity"), 6).alias("mean"))


@query("k11_similarity_vote", f"WITH {TOK}, r AS (SELECT *, CASE match % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'partial' ELSE 'not_support' END AS label, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) AS rank FROM s), v AS (SELECT query, label, round(sum(greatest(similarity, 1e-4)), 6) AS weight FROM r WHERE rank <= 5 GROUP BY ALL) SELECT query, arg_max(label, (weight, CASE label WHEN 'support' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END)) AS label, max(weight) AS weight FROM v GROUP BY 1")
def k11(spark, d):
    name = F.when(C("match") % 3 == 0, "support").when(C("match") % 3 == 1, "partial").otherwise("not_support")
    near = nearest(spark, d, 5).withColumn("label", name)
    return O.vote(near, "query", "label", F.greatest("similarity", F.lit(1e-4)))


@query("k12_majority_vote", f"WITH {PRED}, v AS (SELECT vec_id % 50 AS case_, y_pred AS label, count(*)::DOUBLE AS weight FROM pred GROUP BY ALL) SELECT case_, arg_max(label, (weight, CASE label WHEN 'support' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END)) AS label, max(weight) AS weight FROM v GROUP BY 1")
def k12(spark, d):
    return O.vote(predictions(spark, d).withColumn("case_", C("vec_id") % 50), "case_", "y_pred", F.lit(1.0))


@query("k13_combine", f"WITH {PRED}, c AS (SELECT vec_id, (0.7::DOUBLE * pa + 0.3::DOUBLE * CASE WHEN y_pred = 'support' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END) / 1.0 AS a, (0.7::DOUBLE * pb + 0.3::DOUBLE * CASE WHEN y_pred = 'partial' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END) AS b, (0.7::DOUBLE * pc + 0.3::DOUBLE * CASE WHEN y_pred = 'not_support' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END) AS c FROM pred) SELECT vec_id, round(a, 6) AS p_support, CASE WHEN round(a, 9) >= greatest(round(b, 9), round(c, 9)) THEN 'support' WHEN round(b, 9) >= round(c, 9) THEN 'partial' ELSE 'not_support' END AS label FROM c")
def k13(spark, d):
    both = O.weighted([(0.7, probs()), (0.3, O.spread(C("y_pred"), F.lit(0.8)))])
    return predictions(spark, d).select("vec_id", F.round(both[0], 6).alias("p_support"), O.argmax(both).alias("label"))


@query("k14_hybrid", f"WITH {PRED}, h AS (SELECT vec_id, 0.5::DOUBLE * pa + 0.32::DOUBLE * 0.5::DOUBLE AS a, 0.5::DOUBLE * pb + 0.32::DOUBLE * 0.3::DOUBLE AS b, greatest(0.5::DOUBLE * pc + 0.32::DOUBLE * 0.2::DOUBLE - CASE WHEN fold = 0 THEN 0.05::DOUBLE ELSE 0 END, 0) AS c FROM pred) SELECT vec_id, round(a / (a + b + c), 6) AS p_support, round(c / (a + b + c), 6) AS p_not FROM h")
def k14(spark, d):
    prior = [0.5, 0.3, 0.2]
    mixed = [0.5 * p + 0.32 * q for p, q in zip(probs(), prior, strict=True)]
    mixed[2] = F.greatest(mixed[2] - F.when(C("fold") == 0, 0.05).otherwise(0.0), F.lit(0.0))
    out = O.normalised(mixed)
    return predictions(spark, d).select("vec_id", F.round(out[0], 6).alias("p_support"), F.round(out[2], 6).alias("p_not"))


@query("k15_boundary_rules", f"WITH {PRED} SELECT vec_id, CASE WHEN pa >= 0.4 THEN 'support' WHEN pb - pc > 0.02 THEN 'partial' ELSE y_pred END AS label FROM pred")
def k15(spark, d):
    return predictions(spark, d).select("vec_id", F.when(C("pa") >= 0.4, "support").when(C("pb") - C("pc") > 0.02, "partial").otherwise(C("y_pred")).alias("label"))


@query("k16_model_weights", f"WITH {PRED} SELECT model_name, round(greatest(avg((y_true = y_pred)::INT), 0.05), 6) AS weight FROM pred WHERE fold > 0 GROUP BY 1")
def k16(spark, d):
    return predictions(spark, d).filter("fold > 0").groupBy("model_name").agg(F.round(F.greatest(F.avg((C("y_true") == C("y_pred")).cast("int")), F.lit(0.05)), 6).alias("weight"))


@query("k20_consensus", f"WITH {PRED}, g AS (SELECT vec_id % 100 AS case_, count(*) AS n, count(DISTINCT y_pred) AS kinds, max(confidence) AS top FROM pred GROUP BY 1) SELECT case_, kinds, round(0.6::DOUBLE / kinds + 0.4::DOUBLE * top, 6) AS score FROM g")
def k20(spark, d):
    g = predictions(spark, d).groupBy((C("vec_id") % 100).alias("case_")).agg(F.count_distinct("y_pred").alias("kinds"), F.max("confidence").alias("top"))
    return g.select("case_", "kinds", F.round(0.6 / C("kinds") + 0.4 * C("top"), 6).alias("score"))


@query("k21_override", f"WITH {PRED} SELECT p.vec_id, CASE WHEN o.confidence >= 0.42 THEN o.y_pred ELSE p.y_pred END AS label FROM pred p LEFT JOIN pred o ON o.vec_id = p.vec_id + 1")
def k21(spark, d):
    rows = predictions(spark, d)
    other = rows.select((C("vec_id") - 1).alias("vec_id"), C("y_pred").alias("other"), C("confidence").alias("sure"))
    return rows.join(other, "vec_id", "left").select("vec_id", F.when(C("sure") >= 0.42, C("other")).otherwise(C("y_pred")).alias("label"))


@query("k24_trace", "SELECT doc_id, '{\"id\":' || doc_id || ',\"lang\":' || to_json(lang) || ',\"long\":' || (n_chars > 1000)::VARCHAR || '}' AS trace FROM documents")
def k24(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct(C("doc_id").alias("id"), "lang", (C("n_chars") > 1000).alias("long"))).alias("trace"))


@query("g19_ranked_evidence", f"WITH {TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) AS rank FROM s) SELECT query, string_agg(match || ':' || rank, ',' ORDER BY rank) AS evidence FROM r WHERE rank <= 3 GROUP BY 1")
def g19(spark, d):
    near = nearest(spark, d, 3)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "match")))  # at most three
    return near.groupBy("query").agg(F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["match"].cast("string"), x["rank"].cast("string"))), ",").alias("evidence"))


@query("f9_similarity_join", f"WITH {TOK} SELECT query, match, similarity FROM s WHERE similarity >= 0.1")
def f9(spark, d):
    items = items_of(spark, d)
    return retrieve.pairs_above(items, items, "item_id", "t", 0.1)


@query("k8_case_retrieval", f"WITH {TOK}, v AS (SELECT vec_id, embedding FROM embeddings), c AS (SELECT query, match, round(0.75::DOUBLE * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.25::DOUBLE * similarity, 6) AS score FROM s JOIN v a ON a.vec_id = query JOIN v b ON b.vec_id = match), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, match) AS rank FROM c) SELECT query, match, score, rank::INT AS rank FROM r WHERE rank <= 3")
def k8(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = pairs(spark, d).join(vectors.toDF("query", "a"), "query").join(vectors.toDF("match", "b"), "match")
    cosine = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    scored = both.select("query", "match", F.round(0.75 * cosine + 0.25 * C("similarity"), 6).alias("similarity"))
    return O.nearest(scored, 3).withColumnRenamed("similarity", "score")


@query("k22_calibration_variants", f"WITH {PRED}, s AS (SELECT vec_id, 'full' AS variant, pa + 0.05::DOUBLE AS a, pb AS b, pc AS c FROM pred UNION ALL SELECT vec_id, 'no_shift', pa, pb, pc FROM pred UNION ALL SELECT vec_id, 'prior', 0.8::DOUBLE * pa + 0.1::DOUBLE, 0.8::DOUBLE * pb + 0.06::DOUBLE, 0.8::DOUBLE * pc + 0.04::DOUBLE FROM pred) SELECT vec_id, variant, round(a / (a + b + c), 6) AS p_support FROM s")
def k22(spark, d):
    a, b, c = probs()
    kinds = {"full": (a + 0.05, b, c), "no_shift": (a, b, c), "prior": (0.8 * a + 0.1, 0.8 * b + 0.06, 0.8 * c + 0.04)}
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.round(O.normalised(list(p))[0], 6).alias("p_support")) for k, p in kinds.items()])
    return predictions(spark, d).select("vec_id", F.inline(rows))


@query("k23_weight_grid", f"WITH {PRED}, g(w) AS (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)), a AS (SELECT w, avg((CASE WHEN round(pa + w, 9) >= greatest(round(pb, 9), round(pc, 9)) THEN 'support' WHEN round(pb, 9) >= round(pc, 9) THEN 'partial' ELSE 'not_support' END = y_true)::INT) AS acc FROM pred, g WHERE fold = 0 GROUP BY w) SELECT w AS weight, round(acc, 6) AS accuracy FROM a ORDER BY round(acc, 9) DESC, w LIMIT 1")
def k23(spark, d):
    a, b, c = probs()
    rows = predictions(spark, d).filter("fold = 0").withColumn("w", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2))))
    each = rows.groupBy("w").agg(F.avg((O.argmax([a + C("w"), b, c]) == C("y_true")).cast("int")).alias("acc"))
    return each.orderBy(F.round("acc", 9).desc(), "w").limit(1).select(C("w").alias("weight"), F.round("acc", 6).alias("accuracy"))  # the best one


K19 = """v AS (SELECT fold, y_true, y_pred AS v1, CASE WHEN pa >= 0.34 THEN 'support' WHEN pb >= 0.34 THEN 'partial' ELSE 'not_support' END AS v2, CASE WHEN pc >= 0.3 THEN 'not_support' WHEN pa >= pb THEN 'support' ELSE 'partial' END AS v3 FROM pred),
 pat AS (SELECT fold, y_true, v1, v2, v3, count(*) AS k FROM v GROUP BY ALL), sets AS (SELECT i AS candidate, (i * 7) % 101 AS w1, (i * 17 + 31) % 101 AS w2, (i * 27 + 62) % 101 AS w3 FROM generate_series(0, 602) g(i)),
 s AS (SELECT *, w1 * (v1 = 'support')::INT + w2 * (v2 = 'support')::INT + w3 * (v3 = 'support')::INT AS a, w1 * (v1 = 'partial')::INT + w2 * (v2 = 'partial')::INT + w3 * (v3 = 'partial')::INT AS b, w1 * (v1 = 'not_support')::INT + w2 * (v2 = 'not_support')::INT + w3 * (v3 = 'not_support')::INT AS e FROM pat CROSS JOIN sets),
 said AS (SELECT candidate, fold, y_true, k, CASE WHEN a >= b AND a >= e THEN 'support' WHEN b >= e THEN 'partial' ELSE 'not_support' END AS y_pred FROM s),
 o AS (SELECT said.candidate, f.fold AS held, c AS label, coalesce(sum(k) FILTER (WHERE y_true = c AND y_pred = c), 0) AS tp, coalesce(sum(k) FILTER (WHERE y_pred = c), 0) AS pp, coalesce(sum(k) FILTER (WHERE y_true = c), 0) AS sp FROM said JOIN (SELECT DISTINCT fold FROM pred) f ON said.fold <> f.fold CROSS JOIN (VALUES ('support'), ('partial'), ('not_support')) l(c) GROUP BY ALL),
 m AS (SELECT candidate, held, round(0.55::DOUBLE * (sum(tp)::DOUBLE / sum(sp)::DOUBLE) + 0.45::DOUBLE * avg(CASE WHEN pp + sp = 0 THEN 0 ELSE 2 * tp::DOUBLE / (pp + sp)::DOUBLE END), 9) AS score FROM o GROUP BY ALL),
 best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY held ORDER BY score DESC, candidate) = 1)"""


@query("k19_weight_search", f"WITH {PRED}, {K19} SELECT held AS fold, candidate, round(score, 6) AS score, round(sum(k) FILTER (WHERE y_true = y_pred)::DOUBLE / sum(k)::DOUBLE, 6) AS accuracy FROM best JOIN said USING (candidate) WHERE said.fold = held GROUP BY ALL")
def k19(spark, d):
    second = F.when(C("pa") >= 0.34, "support").when(C("pb") >= 0.34, "partial").otherwise("not_support")
    third = F.when(C("pc") >= 0.3, "not_support").when(C("pa") >= C("pb"), "support").otherwise("partial")
    rows = predictions(spark, d).select("fold", "y_true", C("y_pred").alias("v1"), second.alias("v2"), third.alias("v3"))
    return O.weighted_vote(rows, "fold", "y_true", ["v1", "v2", "v3"], O.weight_sets(spark, 3))
