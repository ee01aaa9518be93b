"""Queries of case-level rules in full: labels, pools, votes, samples, metrics and numeric columns (2-B, 2-D, 2-E, 2-H, 2-J, 2-K, 2-L)."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, features, fuse, labels, pools, preprocess, sample, sets, tabular
from .evaluation import GROUP_F1, PRED, predictions, probs
from .features import CORE, RISK, TOPIC, any_sql, hits_sql
from .fusion import nearest
from ..sources import package
from .registry import query, table

C = F.col
#: A case of each document: its label where it has one, counts of terms, and grades derived from lengths.
CASES = f"""c0 AS (SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars, {hits_sql(CORE, 'd.text')} AS core, {hits_sql(TOPIC, 'd.text')} AS topic, {any_sql(RISK, 'd.text')}::INT AS risk,
  CASE WHEN toxic = 1 THEN 'not_support' WHEN quality = 1 THEN 'support' WHEN quality = 0 THEN 'partial' ELSE 'unknown' END AS label, row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) = 1 AS first,
  (d.n_chars % 97) / 96::DOUBLE AS conf, (d.n_chars % 5 = 0)::INT AS review, (d.n_chars % 11 = 0)::INT AS conflict FROM documents d LEFT JOIN labels l USING (doc_id)),
 c AS (SELECT *, least(1, topic * 0.35::DOUBLE) AS rel, (core > 0)::INT AS substantive, CASE WHEN topic > 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS extractable, least(1, core * 0.25::DOUBLE) AS coverage, (conf >= 0.5)::INT AS consistent, source = 'src3' AS frozen,
  CASE WHEN source = 'src4' THEN 'timeout' ELSE 'api_available' END AS status FROM c0)"""


def cases(spark, d):
    found = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars", T.hits(C("text"), CORE).alias("core"), T.hits(C("text"), TOPIC).alias("topic"), T.any_of(C("text"), RISK).cast("int").alias("risk"))
    rows = docs.join(found, "doc_id", "left")
    label = F.when(C("toxic") == 1, "not_support").when(C("quality") == 1, "support").when(C("quality") == 0, "partial").otherwise("unknown")
    rows = rows.withColumns({"label": label, "conf": (C("n_chars") % 97) / 96.0, "review": (C("n_chars") % 5 == 0).cast("int"), "conflict": (C("n_chars") % 11 == 0).cast("int")})
    return rows.withColumns({
        "rel": F.least(F.lit(1.0), C("topic") * 0.35), "substantive": (C("core") > 0).cast("int"), "extractable": F.when(C("topic") > 0, 0.9).otherwise(0.5), "coverage": F.least(F.lit(1.0), C("core") * 0.25),
        "consistent": (C("conf") >= 0.5).cast("int"), "frozen": C("source") == "src3", "status": F.when(C("source") == "src4", "timeout").otherwise("api_available"),
    })


def hashed(spark, d):
    return cases(spark, d).withColumn("hash", T.content_hash(C("text"))).drop("text")


NEW = "0.2::DOUBLE * rel + 0.18::DOUBLE * substantive + 0.18::DOUBLE * conf + 0.18::DOUBLE * extractable + 0.1::DOUBLE * (1 - conflict) + 0.08::DOUBLE * (1 - review) + 0.08::DOUBLE * coverage"
OLD = "0.18::DOUBLE * rel + 0.15::DOUBLE * substantive + 0.14::DOUBLE * least(conf, 1) + 0.15::DOUBLE * extractable + 0.12::DOUBLE * consistent + 0.1::DOUBLE * least(coverage, 1) + 0.06::DOUBLE * least(conf, 1) + 0.1::DOUBLE * least(n_chars / 3000::DOUBLE, 1)"


@query("d25_new_label_score", f"""WITH {CASES} SELECT doc_id, round({NEW}, 6) AS score, CASE WHEN frozen THEN 'frozen_test'
 WHEN label <> 'unknown' AND conf >= 0.6 AND conflict = 0 AND review = 0 AND rel >= 0.8 AND substantive = 1 AND risk = 0 AND n_chars >= 500 THEN 'strong_label_train_candidate' WHEN label <> 'unknown' AND rel >= 0.65 THEN 'weak_label_candidate' ELSE 'discarded' END AS bucket FROM c""")
def d25(spark, d):
    score = labels.new_label_score(C("rel"), C("substantive"), C("conf"), C("extractable"), C("conflict"), C("review"), C("coverage"))
    bucket = labels.new_label_bucket(C("label"), C("frozen"), C("rel"), C("substantive"), C("risk"), C("conf"), C("conflict"), C("review"), C("n_chars"), 0.6)
    return cases(spark, d).select("doc_id", F.round(score, 6).alias("score"), bucket.alias("bucket"))


@query("d24_existing_label_bucket", f"""WITH {CASES}, s AS (SELECT *, {OLD} AS score FROM c) SELECT doc_id, round(score, 6) AS score,
 CASE WHEN frozen THEN 'frozen_test' WHEN NOT first OR status <> 'api_available' OR label = 'unknown' OR n_chars < 500 THEN 'discarded' WHEN substantive = 0 THEN CASE WHEN rel >= 0.8 THEN 'rag_only' ELSE 'discarded' END WHEN risk = 1 THEN 'discarded'
  WHEN conf >= 0.6 AND review = 0 AND rel >= 0.8 AND extractable >= 0.7 AND score >= 0.78 THEN 'strong_label_train_candidate' WHEN rel >= 0.7 THEN 'weak_label_candidate' WHEN rel >= 0.55 THEN 'rag_only' ELSE 'discarded' END AS bucket,
 CASE WHEN frozen THEN 'candidate_or_frozen_test_excluded' WHEN NOT first THEN 'duplicate_case' WHEN status <> 'api_available' THEN 'api_not_available' WHEN label = 'unknown' THEN 'invalid_or_unknown_label' WHEN n_chars < 500 THEN 'short_pre_decision_text'
  WHEN substantive = 0 THEN 'no_substantive_decision_content' WHEN risk = 1 THEN 'procedural_only' ELSE '' END AS reason FROM s""")
def d24(spark, d):
    rows = pools.first_of(hashed(spark, d), "hash", "doc_id")
    rows = rows.withColumn("s", labels.existing_label_score(C("rel"), C("substantive"), C("conf"), C("extractable"), C("consistent"), C("coverage"), C("conf"), C("n_chars")))
    made = labels.existing_label_bucket(C("s"), C("label"), C("frozen"), ~C("first"), C("status"), C("rel"), C("substantive"), C("risk"), C("conf"), C("review"), C("extractable"), C("n_chars"), 0.6)
    return rows.select("doc_id", F.round("s", 6).alias("score"), made["bucket"].alias("bucket"), made["reason"].alias("reason"))


SUPPORT, REFUSE, PART = ["tion", "und ", "los "], ["que", "th.t", "eit"], ["ing ", "ment.*a"]
HIT = {name: f"regexp_matches({{0}}, '{'|'.join(f'(?:{p})' for p in terms)}')" for name, terms in (("s", SUPPORT), ("r", REFUSE), ("p", PART))}
FLAGGED = f"""{CASES}, i AS (SELECT doc_id, label, substr(text, 161, 60) AS reason, left(text, 80) AS e1, substr(text, 81, 80) AS e2 FROM c),
 b AS (SELECT *, concat_ws(' ', nullif(e1, ''), nullif(e2, '')) AS ev, CASE WHEN length(e1) % 2 = 0 THEN 'support' ELSE 'not_support' END AS l1 FROM i),
 f AS (SELECT doc_id, list_sort(list_filter([CASE WHEN label = 'support' AND ({HIT["r"].format("ev")} OR {HIT["r"].format("reason")}) THEN 'support_but_not_keywords' END, CASE WHEN label = 'not_support' AND ({HIT["s"].format("ev")} OR {HIT["s"].format("reason")}) THEN 'not_support_but_support_keywords' END,
  CASE WHEN label = 'partial' AND NOT ({HIT["p"].format("ev")} OR {HIT["p"].format("reason")}) THEN 'partial_without_partial_markers' END, CASE WHEN label = 'unknown' AND ({HIT["s"].format("ev")} OR {HIT["r"].format("ev")}) THEN 'unknown_but_has_disposition_keywords' END,
  CASE WHEN (l1 = 'support' AND {HIT["r"].format("e1")}) OR (label = 'support' AND {HIT["r"].format("e2")}) THEN 'item_support_but_not_kw' END, CASE WHEN (l1 = 'not_support' AND {HIT["s"].format("e1")}) OR (label = 'not_support' AND {HIT["s"].format("e2")}) THEN 'item_not_support_but_support_kw' END], lambda x: x IS NOT NULL)) AS flags FROM b)"""


def flagged(spark, d):
    first, second = F.substring("text", 1, 80), F.substring("text", 81, 80)
    items = F.array(F.struct(F.when(F.length(first) % 2 == 0, "support").otherwise("not_support").alias("label"), first.alias("evidence")), F.struct(C("label"), second.alias("evidence")))
    return cases(spark, d).select("doc_id", labels.contradictions(C("label"), F.substring("text", 161, 60), items, SUPPORT, REFUSE, PART).alias("flags"))


@query("d9_case_item_flags", f"WITH {FLAGGED} SELECT doc_id, array_to_string(flags, ';') AS flags, len(flags)::INT AS flag_count FROM f")
def d9(spark, d):
    return flagged(spark, d).select("doc_id", F.array_join("flags", ";").alias("flags"), F.size("flags").alias("flag_count"))


@query("d9_flag_report", f"WITH {FLAGGED} SELECT flag, count(*) AS n FROM (SELECT unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['none'] END) AS flag FROM f) GROUP BY 1")
def d9_report(spark, d):
    return labels.flag_report(flagged(spark, d))


WIDE = "status = 'api_available' AND doc_id IS NOT NULL AND NOT frozen AND n_chars >= 300 AND core >= 1 AND topic >= 1 AND coverage >= 0.25 AND rel >= 0.3 AND risk = 0 AND extractable >= 0.9 AND substantive = 1 AND conflict = 0"


@query("e8_wide_pool", f"WITH {CASES}, p AS (SELECT * FROM c WHERE {WIDE} QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1), s AS (SELECT doc_id, n_chars, topic * 5 + core * 2 + risk + least(greatest(n_chars / 5000::DOUBLE, 0), 5) AS score FROM p) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, n_chars DESC, doc_id) AS rank FROM s")
def e8(spark, d):
    conditions = [F.expr(x) for x in WIDE.split(" AND ")]
    return pools.ranked_pool(hashed(spark, d), conditions, "hash", "doc_id", pools.wide_score(C("topic"), C("core"), C("risk"), C("n_chars")), F.desc("n_chars")).select("doc_id", F.round("score", 6).alias("score"), "rank")


def queue(spark, d):
    known = [("known_source", C("frozen")), ("known_label", C("label") != "unknown")]
    later = [("short_text", C("n_chars") < 300), ("procedural", C("risk") == 1)]
    return pools.label_queue(hashed(spark, d), known, later, "hash", "doc_id", [F.desc("topic"), F.desc("coverage"), F.desc("core"), F.desc("n_chars")])


QUEUE = f"{CASES}, k AS (SELECT *, NOT frozen AND label = 'unknown' AS a, NOT frozen AND label = 'unknown' AND first AS b FROM c), q AS (SELECT *, b AND n_chars >= 300 AS e, b AND n_chars >= 300 AND risk = 0 AS f FROM k)"


@query("e11_queue_order", f"WITH {QUEUE} SELECT doc_id, row_number() OVER (ORDER BY topic DESC, coverage DESC, core DESC, n_chars DESC, doc_id) AS position FROM q WHERE f")
def e11(spark, d):
    return queue(spark, d)[0].select("doc_id", "position")


@query("e11_skip_report", f"WITH {QUEUE} SELECT unnest(range(0, 7))::INT AS place, unnest(['source_rows', 'queue_rows', 'known_source', 'known_label', 'repeated_text', 'short_text', 'procedural']) AS metric, unnest([count(*), count(*) FILTER (WHERE f), count(*) FILTER (WHERE frozen), count(*) FILTER (WHERE label <> 'unknown'), count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE b AND NOT e), count(*) FILTER (WHERE e AND NOT f)]) AS value FROM q")
def e11_report(spark, d):
    return queue(spark, d)[1]


@query("k12_vote_agreement", f"""WITH {PRED}, v AS (SELECT vec_id % 50 AS case_, CASE WHEN fold = 4 THEN 'unknown' ELSE y_pred END AS label, confidence FROM pred), g AS (SELECT case_, label, count(*) AS n, avg(confidence) AS m FROM v WHERE label <> 'unknown' GROUP BY ALL),
 b AS (SELECT *, sum(n) OVER (PARTITION BY case_) AS all_, row_number() OVER (PARTITION BY case_ ORDER BY n DESC, round(m, 9) DESC, CASE label WHEN 'support' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) AS r FROM g)
 SELECT case_, coalesce(label, 'unknown') AS label, coalesce(round(m, 6), 0) AS confidence, coalesce(round(n / all_, 6), 0) AS agreement FROM (SELECT DISTINCT case_ FROM v) LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (case_)""")
def k12(spark, d):
    rows = predictions(spark, d).select((C("vec_id") % 50).alias("case_"), F.when(C("fold") == 4, "unknown").otherwise(C("y_pred")).alias("label"), "confidence")
    return fuse.majority(rows, "case_", "label", C("confidence"))


SHARES = """i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[一-鿿]{2,4}|[a-z0-9]{2,}')) AS t FROM benchmark), s AS (SELECT a.item_id AS query, b.item_id AS match, b.item_id % 3 AS label, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS similarity FROM i a JOIN i b ON a.item_id <> b.item_id AND len(list_intersect(a.t, b.t)) > 0),
 m AS (SELECT query, coalesce(avg(similarity) FILTER (WHERE label = 0), 0) AS a, coalesce(avg(similarity) FILTER (WHERE label = 1), 0) AS b, coalesce(avg(similarity) FILTER (WHERE label = 2), 0) AS c FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY similarity DESC, match) <= 3) GROUP BY query),
 n AS (SELECT query, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM m)"""


@query("k10_label_shares", f"WITH {SHARES} SELECT query, round(a, 6) AS support_prob, round(b, 6) AS partial_prob, round(c, 6) AS not_support_prob, CASE WHEN round(a, 9) >= greatest(round(b, 9), round(c, 9)) THEN 'support' WHEN round(b, 9) >= round(c, 9) THEN 'partial' ELSE 'not_support' END AS top_label, round(greatest(a, b, c), 6) AS top_prob, round(greatest(a, b, c) - list_sort([a, b, c])[2], 6) AS margin FROM n")
def k10(spark, d):
    named = F.when(C("label") == 0, "support").when(C("label") == 1, "partial").otherwise("not_support")
    return fuse.label_shares(nearest(spark, d, 3, "label").withColumn("label", named), "query", "label")


VOTES = "[" + ", ".join(f"CASE WHEN embedding[{j}] > 0.05 THEN 'support' WHEN embedding[{j}] > -0.05 THEN 'partial' ELSE 'not_support' END" for j in range(1, 9)) + "]"


@query("k20_consensus_switch", f"""WITH v AS (SELECT vec_id, embedding AS e, {VOTES} AS v FROM embeddings), t AS (SELECT *, list_transform(list_distinct(v), lambda c: {{'n': len(list_filter(v, lambda x: x = c)), 'at': -list_position(v, c), 'label': c}}) AS tally FROM v),
 g AS (SELECT *, list_sort(tally)[-1].label AS label, list_sort(tally)[-1].n / 8 AS agreement, v[1] AS base, v[8] AS top FROM t)
 SELECT vec_id, label AS consensus, agreement, round(0.55::DOUBLE * agreement + 0.25::DOUBLE * abs(e[1]::DOUBLE) + 0.15::DOUBLE * abs(e[2]::DOUBLE) + 0.05::DOUBLE * abs(e[3]::DOUBLE) + 0.05::DOUBLE * abs(e[4]::DOUBLE) + 0.05::DOUBLE * abs(e[5]::DOUBLE), 6) AS score,
  CASE WHEN label <> base AND agreement >= 0.5 AND top = label AND abs(e[6]::DOUBLE) >= 0.08 THEN label ELSE base END AS y_pred FROM g""")
def k20(spark, d):
    part = lambda j: F.get("embedding", F.lit(j - 1))
    size = lambda j: F.abs(part(j).cast("double"))
    vote = lambda j: F.when(part(j).cast("double") > 0.05, "support").when(part(j).cast("double") > -0.05, "partial").otherwise("not_support")
    rows = table(spark, d, "embeddings").withColumn("v", F.array(*[vote(j) for j in range(1, 9)])).withColumn("g", fuse.consensus(C("v")))
    score = fuse.selective_score(C("g.agreement"), [(0.25, size(1)), (0.15, size(2)), (0.05, size(3)), (0.05, size(4)), (0.05, size(5))])
    switch = fuse.switched(F.get("v", F.lit(0)), C("g.label"), C("g.agreement"), F.get("v", F.lit(7)), size(6))
    return rows.select("vec_id", C("g.label").alias("consensus"), C("g.agreement").alias("agreement"), F.round(score, 6).alias("score"), F.when(switch, C("g.label")).otherwise(F.get("v", F.lit(0))).alias("y_pred"))


SETTINGS = ("full_model", "remove_pre_decision_constraint", "remove_structured_events", "remove_procedural_signals", "remove_evidence_chain", "remove_responsibility_head", "remove_retrieval", "remove_irac_verifier")
ABLATED = f"""{CASES}, x AS (SELECT unnest({list(SETTINGS)}) AS setting), m AS (SELECT setting, label AS y_true, CASE WHEN setting = 'remove_structured_events' THEN 0 ELSE topic END AS events, CASE WHEN setting = 'remove_procedural_signals' THEN 0 ELSE core END AS cues, CASE WHEN setting = 'remove_evidence_chain' THEN 0.5::DOUBLE ELSE coverage END AS evidence,
  CASE WHEN setting = 'remove_retrieval' THEN 0.5::DOUBLE ELSE conf END AS retrieved, CASE WHEN setting = 'remove_responsibility_head' THEN 'unknown' WHEN risk = 1 THEN 'contractor' WHEN core > topic THEN 'owner' ELSE 'unknown' END AS party, CASE WHEN setting = 'remove_pre_decision_constraint' THEN 0.2::DOUBLE ELSE 0 END AS later, CASE WHEN setting = 'remove_irac_verifier' THEN 0 ELSE 1 END AS verifier,
  CASE WHEN lang = 'de' THEN 'contractor' ELSE 'owner' END AS party_true, n_chars FROM c CROSS JOIN x),
 s AS (SELECT *, 0.25::DOUBLE * least(events, 3) / 3 + 0.25::DOUBLE * least(cues, 3) / 3 + 0.2::DOUBLE * evidence + 0.2::DOUBLE * retrieved + 0.1::DOUBLE * (party <> 'unknown')::INT + later AS score FROM m),
 rows_ AS (SELECT *, setting AS g, CASE WHEN round(score, 9) >= 0.6 THEN 'support' WHEN round(score, 9) >= 0.35 THEN 'partial' ELSE 'not_support' END AS y_pred FROM s)"""


@query("j22_ablation", f"""WITH {ABLATED}, cls AS (SELECT g, k, count(*) FILTER (WHERE y_true = k AND y_pred = k) AS tp, count(*) FILTER (WHERE y_pred = k AND y_true <> 'unknown') AS pp, count(*) FILTER (WHERE y_true = k) AS sp FROM rows_ CROSS JOIN (VALUES ('support'), ('partial'), ('not_support')) l(k) GROUP BY ALL),
 f AS (SELECT *, CASE WHEN pp + sp = 0 THEN 0 ELSE 2 * tp / (pp + sp) END AS f1 FROM cls), m1 AS (SELECT g, round(sum(tp) / sum(sp), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sp) / sum(sp), 6) AS weighted_f1 FROM f GROUP BY g),
 p AS (SELECT g, k, count(*) FILTER (WHERE party_true = k AND party = k) AS tp, count(*) FILTER (WHERE party = k) AS pp, count(*) FILTER (WHERE party_true = k AND party <> 'unknown') AS sp FROM rows_ CROSS JOIN (VALUES ('owner'), ('contractor')) l(k) GROUP BY ALL),
 m2 AS (SELECT g, round(sum(tp) / sum(sp), 6) AS second_accuracy, round(avg(CASE WHEN pp + sp = 0 THEN 0 ELSE 2 * tp / (pp + sp) END), 6) AS second_macro_f1 FROM p GROUP BY g HAVING sum(sp) > 0),
 r AS (SELECT g, round(avg((party = 'unknown')::INT), 6) AS uncertainty_rate, round(avg((evidence >= 0.5)::INT), 6) AS consistency_rate, round(avg((verifier = 1 AND abs(score - 0.35) < 0.05)::INT), 6) AS high_dispute_rate, round(avg((events > 0)::INT), 6) AS valid_span_rate, round(avg((later = 0)::INT), 6) AS pre_decision_span_rate, round(avg((events = cues)::INT), 6) AS duplicate_chain_rate, round(avg(evidence), 6) AS role_coverage_rate, round(avg(1 - evidence), 6) AS missing_role_rate FROM rows_ GROUP BY g)
 SELECT g AS setting, accuracy, macro_f1, weighted_f1, coalesce(second_accuracy, 0) AS second_accuracy, coalesce(second_macro_f1, 0) AS second_macro_f1, r.* EXCLUDE (g) FROM m1 LEFT JOIN m2 USING (g) JOIN r USING (g)""")
def j22(spark, d):
    """Eight settings of which each takes one part away, and thirteen metrics of each."""
    party = F.when(C("risk") == 1, "contractor").when(C("core") > C("topic"), "owner").otherwise("unknown")
    rows = cases(spark, d).select(C("label").alias("y_true"), C("topic").alias("events"), C("core").alias("cues"), C("coverage").alias("evidence"), C("conf").alias("retrieved"), party.alias("party"), F.lit(0.0).alias("later"), F.lit(1).alias("verifier"), F.when(C("lang") == "de", "contractor").otherwise("owner").alias("party_true"))
    parts = [{}, {"later": F.lit(0.2)}, {"events": F.lit(0)}, {"cues": F.lit(0)}, {"evidence": F.lit(0.5)}, {"party": F.lit("unknown")}, {"retrieved": F.lit(0.5)}, {"verifier": F.lit(0)}]

    def score(df):
        s = 0.25 * F.least("events", F.lit(3)) / 3 + 0.25 * F.least("cues", F.lit(3)) / 3 + 0.2 * C("evidence") + 0.2 * C("retrieved") + 0.1 * (C("party") != "unknown").cast("int") + C("later")
        made = df.withColumn("score", s).withColumn("y_pred", F.when(F.round("score", 9) >= 0.6, "support").when(F.round("score", 9) >= 0.35, "partial").otherwise("not_support"))
        return made.withColumns({"uncertain": C("party") == "unknown", "agrees": C("evidence") >= 0.5, "disputed": (C("verifier") == 1) & (F.abs(C("score") - 0.35) < 0.05), "valid": C("events") > 0, "before": C("later") == 0, "twice": C("events") == C("cues"), "missing": 1 - C("evidence")})

    rates = {"uncertainty_rate": "uncertain", "consistency_rate": "agrees", "high_dispute_rate": "disputed", "valid_span_rate": "valid", "pre_decision_span_rate": "before", "duplicate_chain_rate": "twice", "role_coverage_rate": "evidence", "missing_role_rate": "missing"}
    return evaluate.ablation(rows, dict(zip(SETTINGS, parts, strict=True)), score, rates, second=("party_true", "party", ("owner", "contractor")))


@query("j7_macro_f1_interval")
def j7(spark, d):
    """Macro-F1 of each model with its 95 % interval over 300 resamples; no SQL draws them."""
    return evaluate.bootstrap_macro_f1(predictions(spark, d), ["model_name"])


SPOT = "(('0x' || substr(sha256({0} || '|{1}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"
PLACED = "SELECT *, row_number() OVER (PARTITION BY g ORDER BY sha256(key || '|{0}'), key) AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT *, {1} AS g FROM k)"
DRAWN = {"near": (14, "split || '|' || category", "a.category = b.category"), "hard": (15, "source", "a.role <> b.role"), "random": (16, "split", "a.category <> b.category")}


@query("h11_training_pairs_full", f"""WITH b AS (SELECT doc_id AS key, source, lang AS category, n_chars % 3 AS role FROM documents), s AS (SELECT *, CASE WHEN {SPOT.format("source", 11)} < 0.2 THEN 'validation' ELSE 'train' END AS split FROM b),
 k AS (SELECT *, CASE WHEN {SPOT.format("key", 12)} < 3 / 7 THEN CASE WHEN {SPOT.format("key", 13)} < 1 / 3 THEN 'near' WHEN {SPOT.format("key", 13)} < 2 / 3 THEN 'hard' ELSE 'random' END END AS kind FROM s)
 SELECT key, category, key AS match, 'positive' AS kind, 1 AS label, split FROM k """ + " ".join(f"UNION ALL (WITH p AS ({PLACED.format(seed, group)}) SELECT a.key, a.category, b.key, '{kind}', 0, a.split FROM p a JOIN p b ON a.g = b.g AND b.r = a.r % a.n + 1 WHERE a.kind = '{kind}' AND a.key <> b.key AND {fits})" for kind, (seed, group, fits) in DRAWN.items()))
def h11(spark, d):
    blocks = table(spark, d, "documents").select("doc_id", "source", "lang", (C("n_chars") % 3).alias("role"))
    return sample.training_pairs(blocks, "doc_id", "source", "lang", "role", 11)


#: Section, pattern, sentence.
ABSTRACT = [
    ("context", "[A-Z][a-z]+ung", "a German heading is named"), ("context", "[0-9]{4}", "numbers of four digits: {0}"), ("context", "(?:[a-z]+)@", "a mailbox is named: {0}"),
    ("claims", "tion", "an action is claimed"), ("claims", "ment", "a means is claimed"), ("claims", "ing ", "something is going on"), ("claims", "ción", "una acción"),
    ("facts", "que ", "the text goes into detail"), ("facts", "\\\\+1", "a number is given"),
]
ABSTRACT = [(a, b.replace("\\\\", "\\"), c) for a, b, c in ABSTRACT]
LIMITS, DEFAULTS = {"context": 3, "claims": 2, "facts": 2}, {"context": "basic context", "claims": "claims are summarised", "facts": "no facts"}


def abstract_sql(section: str) -> str:
    def one(pattern, sentence):
        before, filled, after = sentence.partition("{0}")
        uniq = f"list_filter(regexp_extract_all(text, '({pattern})', 1), lambda x, i: list_position(regexp_extract_all(text, '({pattern})', 1), x) = i)"
        return f"CASE WHEN regexp_matches(text, '{pattern}') THEN " + (f"'{before}' || array_to_string(({uniq})[1:3], ', ') || '{after}'" if filled else f"'{sentence}'") + " END"

    rules = ", ".join(one(p, s) for name, p, s in ABSTRACT if name == section)
    return f"coalesce(nullif(array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL)[1:{LIMITS[section]}], '; '), ''), '{DEFAULTS[section]}') AS {section}"


@query("b26_section_abstraction", f"SELECT doc_id, {', '.join(map(abstract_sql, LIMITS))} FROM documents")
def b26(spark, d):
    return table(spark, d, "documents").select("doc_id", T.abstracted(C("text"), ABSTRACT, LIMITS, DEFAULTS).alias("s")).select("doc_id", "s.*")


STATS = "[l_quantity, l_extendedprice, nullif(l_discount, 0), l_tax]"


@query("l2_row_statistics_full", f"SELECT l_orderkey, l_linenumber, round(list_avg(v), 4) AS row_mean, round(list_stddev_samp(v), 4) AS row_std, list_min(v) AS row_min, list_max(v) AS row_max, round(list_median(v), 6) AS row_median, (4 - len(v))::INT AS row_na_count, round(list_avg(list_transform(v, lambda x: abs(x))), 4) AS row_abs_mean FROM (SELECT *, list_filter({STATS}, lambda x: x IS NOT NULL) AS v FROM lineitem)")
def l2(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    digits = {"row_mean": 4, "row_std": 4, "row_median": 6, "row_abs_mean": 4}
    made = tabular.row_statistics(rows, columns).drop(*columns)
    return made.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in made.columns])


@query("l6_useless_columns", "SELECT unnest(['l_quantity', 'odd', 'none', 'one', 'gap']) AS name, unnest([FALSE, count(DISTINCT odd) <= 1 AND count(odd) IN (0, count(*)), TRUE, TRUE, count(gap) = count(*)]) AS dropped FROM (SELECT CASE WHEN l_tax > 0 THEN l_tax END AS odd, CASE WHEN l_tax > 0 THEN 1 END AS gap FROM lineitem)")
def l6(spark, d):
    infinite = F.lit(float("inf"))
    rows = table(spark, d, "lineitem").select("l_quantity", F.when(C("l_tax") > 0, C("l_tax")).otherwise(infinite).alias("odd"), infinite.alias("none"), F.lit(1.0).alias("one"), F.when(C("l_tax") > 0, 1.0).alias("gap"))
    return tabular.useless(rows, rows.columns)


@query("l8_fold_preprocessor")
def l8(spark, d):
    """Eight components, as the figures of the other folds fill, clip and rotate them; the sketch of quantiles is not SQL."""
    names = [f"x{i}" for i in range(8)]
    rows = table(spark, d, "embeddings").select("vec_id", (C("vec_id") % 4).cast("int").alias("fold"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    made = preprocess.by_fold(rows, names, "fold", [0, 1, 2, 3])
    return made.select("vec_id", "fold", *[F.round(c, 6).alias(c) for c in made.columns[2:]])


SETS = [[1, 1, 1], *[[(i * (7 + 10 * j) + 31 * j) % 101 + 1 for j in range(3)] for i in range(1, 60)]]


@query("l10_blend_weights", f"""WITH {PRED}, w AS (SELECT unnest(range(0, 60))::INT AS candidate, unnest({SETS}) AS w), r AS (SELECT candidate, (y_true = 'support')::INT AS y, round((pa * w[1] + (1 - pb) * w[2] + (1 - pc) * w[3]) / (w[1] + w[2] + w[3]), 9) AS s FROM pred CROSS JOIN w),
 k AS (SELECT candidate, y, rank() OVER (PARTITION BY candidate ORDER BY s) + (count(*) OVER (PARTITION BY candidate, s) - 1) / 2 AS rk FROM r), a AS (SELECT candidate, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM k GROUP BY candidate)
 SELECT candidate, auc FROM a ORDER BY auc DESC, candidate LIMIT 1""")
def l10(spark, d):
    rows = predictions(spark, d).select((C("y_true") == "support").cast("int").alias("y"), "pa", (1 - C("pb")).alias("qb"), (1 - C("pc")).alias("qc"))
    return preprocess.blend(rows, "y", ["pa", "qb", "qc"], np.array(SETS, float))


@query("j18_inflation", f"WITH {PRED}, rows_ AS (SELECT (vec_id % 2)::VARCHAR || '|' || CASE fold % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' ELSE 'both' END AS g, y_true, y_pred FROM pred), {GROUP_F1}, t AS (SELECT split_part(g, '|', 1)::BIGINT AS dataset, split_part(g, '|', 2) AS mode, macro_f1 FROM m) SELECT t.*, b.macro_f1 AS base_macro_f1, round(t.macro_f1 - b.macro_f1, 6) AS delta, (t.mode <> 'pre' AND round(t.macro_f1 - b.macro_f1, 6) > 0.005)::INT AS risk FROM t LEFT JOIN t b ON b.dataset = t.dataset AND b.mode = 'pre'")
def j18_inflation(spark, d):
    mode = F.when(C("fold") % 3 == 0, "pre").when(C("fold") % 3 == 1, "post").otherwise("both")
    rows = predictions(spark, d).withColumns({"dataset": C("vec_id") % 2, "mode": mode})
    return evaluate.inflation(evaluate.scores(rows, ["dataset", "mode"]).select("dataset", "mode", "macro_f1"), ["dataset"], "mode", "pre")


JUDGED = f"""{CASES}, e AS (SELECT doc_id, label AS y_true, CASE WHEN rel >= 0.7 THEN 'support' WHEN core > 1 THEN 'partial' ELSE 'not_support' END AS y_pred, conf, consistent, coverage, rel, extractable, conflict, risk, topic > 2 AND core > 2 AS both_, review FROM c WHERE label <> 'unknown')"""
PARTIAL, BOUNDARY = "(y_true = 'partial' OR y_pred = 'partial')", "'partial_support_boundary_confusion'"


@query("j24_six_rule_sets", f"""WITH {JUDGED} SELECT doc_id,
 CASE WHEN consistent = 0 THEN 'responsibility_evidence_inconsistency' WHEN conf < 0.7 OR coverage < 0.45 OR rel < 0.38 THEN 'insufficient_evidence' WHEN both_ THEN 'concurrent_delay_conflict' WHEN risk = 1 THEN 'procedural_noncompliance_confusion' WHEN {PARTIAL} THEN {BOUNDARY} ELSE 'ambiguous_causality' END AS diagnosis,
 CASE WHEN {PARTIAL} THEN {BOUNDARY} WHEN conf < 0.5 THEN 'insufficient_evidence' WHEN extractable < 0.6 THEN 'ambiguous_causality' WHEN rel >= 0.5 THEN 'procedural_noncompliance_confusion' ELSE 'model_label_mismatch' END AS copilot,
 CASE WHEN y_true = y_pred THEN 'correct' WHEN y_true = 'support' THEN 'support_under_recognition' WHEN y_true = 'not_support' AND y_pred = 'partial' THEN 'not_support_partial_boundary' WHEN y_true = 'partial' THEN 'partial_boundary_confusion' ELSE 'other_label_confusion' END AS selective,
 CASE WHEN y_true = y_pred THEN 'correct' WHEN conf < 0.55 THEN 'low_confidence_boundary' WHEN conflict = 1 THEN 'candidate_label_conflict' WHEN {PARTIAL} THEN {BOUNDARY} WHEN review = 1 THEN 'management_mechanism_high_dispute' ELSE 'outcome_class_confusion' END AS dispute,
 CASE WHEN {PARTIAL} THEN 'partial_boundary_confusion' ELSE 'other_class_confusion' END AS "partial", CASE WHEN y_true = 'support' OR y_pred = 'support' THEN 'support_boundary_error' ELSE 'other_error' END AS support FROM e""")
def j24(spark, d):
    pred = F.when(C("rel") >= 0.7, "support").when(C("core") > 1, "partial").otherwise("not_support")
    rows = cases(spark, d).filter("label <> 'unknown'").withColumn("y_pred", pred)
    columns = {"true": C("label"), "pred": C("y_pred"), "confidence": C("conf"), "consistent": C("consistent"), "valid_spans": C("conf"), "coverage": C("coverage"), "sufficiency": C("rel"), "both": (C("topic") > 2) & (C("core") > 2), "noncompliant": C("risk") == 1, "causality": F.when(C("extractable") < 0.6, 1.0).otherwise(0.0), "procedure_risk": C("rel"), "conflict": C("conflict"), "dispute": C("review")}
    return rows.select("doc_id", *[evaluate.error_categories(rules).alias(name) for name, rules in evaluate.error_rules(columns).items()])


PARTIES, FOLDED = ("owner", "contractor", "both", "third"), {"owner": ["owner"], "contractor": ["contractor"], "shared": ["both", "third"]}
CAUSES = f"""{CASES}, k AS (SELECT CASE WHEN lang = 'en' THEN 'strict' ELSE 'extended' END AS dataset, CASE WHEN n_chars % 7 = 0 THEN 'unknown' WHEN topic > 2 THEN 'both' WHEN risk = 1 THEN 'third' WHEN core > 1 THEN 'contractor' ELSE 'owner' END AS gold, CASE WHEN topic > 1 THEN 'both' WHEN core > 1 THEN 'contractor' ELSE 'owner' END AS pred, CASE WHEN topic > 3 THEN 'third' WHEN n_chars % 3 = 0 THEN 'contractor' ELSE 'owner' END AS hint, conflict FROM c),
 mj AS (SELECT gold AS majority FROM k WHERE gold <> 'unknown' GROUP BY gold ORDER BY count(*) DESC, list_position(['owner', 'contractor', 'both', 'third'], gold) LIMIT 1),
 fold_ AS (SELECT CASE WHEN gold IN ('both', 'third') THEN 'shared' ELSE gold END AS gold, CASE WHEN pred IN ('both', 'third') THEN 'shared' ELSE pred END AS pred FROM k),
 t AS (SELECT 'a' AS g, gold, pred, l FROM k, (SELECT unnest(['owner', 'contractor', 'both', 'third']) AS l) UNION ALL SELECT 'f', gold, pred, l FROM fold_, (SELECT unnest(['owner', 'contractor', 'shared']) AS l) UNION ALL SELECT 'h', gold, hint, l FROM k, (SELECT unnest(['owner', 'contractor', 'both', 'third']) AS l) UNION ALL SELECT 'm', gold, majority, l FROM k, mj, (SELECT unnest(['owner', 'contractor', 'both', 'third']) AS l)),
 f1 AS (SELECT g, l, coalesce(2 * count(*) FILTER (WHERE gold = l AND pred = l) / nullif(count(*) FILTER (WHERE pred = l AND gold <> 'unknown') + count(*) FILTER (WHERE gold = l), 0), 0) AS f FROM t GROUP BY g, l), s AS (SELECT g, round(avg(f), 6) AS v FROM f1 GROUP BY g),
 top AS (SELECT dataset, max(n) AS top FROM (SELECT dataset, gold, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1),
 b AS (SELECT dataset, avg((gold = 'unknown')::INT) AS u, any_value(top) / count(*) AS x, avg(conflict) AS c, avg((gold <> hint)::INT) AS h FROM k JOIN top USING (dataset) GROUP BY dataset)"""


@query("j19_root_causes", f"""WITH {CAUSES} SELECT 'label_problem' AS cause, unnest(['unknown_ratio', 'max_class_ratio', 'conflict_rate', 'hint_disagreement']) AS metric, dataset, round(unnest([u, x, c, h]), 6) AS value FROM b
 UNION ALL SELECT CASE WHEN n < 3 THEN 'task_problem' ELSE 'model_problem' END, metric, 'all', v FROM (SELECT unnest(range(1, 6)) AS n, unnest(['a', 'f', 'a', 'h', 'm']) AS g, unnest(['macro_f1_all_labels', 'macro_f1_folded', 'diagnosis_macro_f1', 'hint_macro_f1', 'majority_macro_f1']) AS metric) JOIN s USING (g)""")
def j19(spark, d):
    gold = F.when(C("n_chars") % 7 == 0, F.lit(None)).when(C("topic") > 2, "both").when(C("risk") == 1, "third").when(C("core") > 1, "contractor").otherwise("owner")
    pred, hint = F.when(C("topic") > 1, "both").when(C("core") > 1, "contractor").otherwise("owner"), F.when(C("topic") > 3, "third").when(C("n_chars") % 3 == 0, "contractor").otherwise("owner")
    rows = cases(spark, d).select(F.when(C("lang") == "en", "strict").otherwise("extended").alias("dataset"), gold.alias("gold"), pred.alias("pred"), hint.alias("hint"), "conflict")
    return evaluate.root_causes(rows, "dataset", "gold", "pred", "hint", "conflict", PARTIES, FOLDED)


@query("j20_claim_tiers", """WITH runs AS (SELECT source AS run_name, CASE WHEN max(n_chars) > 2000 THEN 'complete' ELSE 'partial' END AS audit_status FROM documents GROUP BY source),
 r AS (SELECT source AS run_name, lang, (n_chars > 150 OR lang <> 'en')::INT AS metric_match, CASE WHEN n_chars > 40 OR lang <> 'en' THEN 'complete' ELSE 'missing' END AS trace FROM documents), k AS (SELECT run_name, min(metric_match) AS metric_recomputed, min((trace = 'complete')::INT) AS artifact_traceable FROM r WHERE run_name <> 'src1' OR lang = 'de' GROUP BY 1),
 s AS (SELECT (count(DISTINCT lang) = 2)::INT AS seen FROM documents WHERE lang IN ('en', 'de')), j AS (SELECT run_name, audit_status, coalesce(metric_recomputed, 0) AS metric_recomputed, coalesce(artifact_traceable, 0) AS artifact_traceable, CASE WHEN run_name = 'src1' THEN seen ELSE 0 END AS leakage_sentinel_passed FROM runs LEFT JOIN k USING (run_name), s)
 SELECT *, CASE WHEN run_name = 'src1' THEN 'claimable with caution' ELSE 'historical reference only' END AS tier, (run_name = 'src1' AND audit_status = 'complete' AND metric_recomputed = 1 AND artifact_traceable = 1 AND leakage_sentinel_passed = 1)::INT AS headline_claimable FROM j""")
def j20(spark, d):
    docs = table(spark, d, "documents")
    runs = docs.groupBy(C("source").alias("run_name")).agg(F.when(F.max("n_chars") > 2000, "complete").otherwise("partial").alias("audit_status"))
    checks = docs.select(C("source").alias("run_name"), "lang", ((C("n_chars") > 150) | (C("lang") != "en")).cast("int").alias("metric_match"), F.when((C("n_chars") > 40) | (C("lang") != "en"), "complete").otherwise("missing").alias("traceability_status"))
    return evaluate.claim_tiers(runs, checks, docs.select(C("lang").alias("dataset_name")).distinct(), "src1", C("lang") == "de", ["en", "de"])


IS = "(coalesce({0}, '') = '{1}')::INT"
MIXES = ", ".join(f"0.5::DOUBLE * p{k} + 0.2::DOUBLE * r{k} + 0.1::DOUBLE * {IS.format('rule', c)} + w * {IS.format('prior', c)} + 0.08::DOUBLE * {IS.format('hint', c)} AS {k}" for k, c in (("a", "support"), ("b", "partial"), ("c", "not_support")))


@query("k14_hybrid_full", f"""WITH {PRED}, x AS (SELECT vec_id, pa, pb, pc, pb AS ra, pc AS rb, pa AS rc, y_pred AS rule, CASE WHEN fold = 4 THEN 'unknown' ELSE y_true END AS prior, CASE WHEN fold = 4 THEN 0 WHEN vec_id % 3 = 0 THEN 0.18::DOUBLE ELSE 0.32::DOUBLE END AS w, CASE WHEN fold = 3 THEN NULL ELSE y_pred END AS hint, 2 * pa AS ev, fold = 0 AS inc, model_name = 'tree' AS own FROM pred),
 m AS (SELECT *, {MIXES} FROM x), s1 AS (SELECT *, CASE WHEN inc THEN least(0.12::DOUBLE, a * 0.35::DOUBLE + 0.04::DOUBLE) ELSE 0 END AS sh FROM m), s2 AS (SELECT vec_id, ev, own, greatest(0, a - sh) AS a, b, c + sh AS c FROM s1),
 s3 AS (SELECT *, CASE WHEN own AND ev >= 0.58 THEN least(0.08::DOUBLE, c * 0.3::DOUBLE + 0.03::DOUBLE) ELSE 0 END AS sh FROM s2), s4 AS (SELECT vec_id, ev, a + sh AS a, b, greatest(0, c - sh) AS c FROM s3),
 s5 AS (SELECT vec_id, greatest(CASE WHEN ev < 0.38 THEN 0.8::DOUBLE * a + 0.03::DOUBLE ELSE a END, 1e-8) AS a, greatest(CASE WHEN ev < 0.38 THEN 0.8::DOUBLE * b + 0.09::DOUBLE ELSE b END, 1e-8) AS b, greatest(CASE WHEN ev < 0.38 THEN 0.8::DOUBLE * c + 0.08::DOUBLE ELSE c END, 1e-8) AS c FROM s4)
 SELECT vec_id, round(a / (a + b + c), 6) AS support, round(b / (a + b + c), 6) AS "partial", round(c / (a + b + c), 6) AS not_support FROM s5""")
def k14(spark, d):
    prior = F.when(C("fold") == 4, "unknown").otherwise(C("y_true"))
    weight = fuse.prior_weight(prior, (C("vec_id") % 3 == 0).cast("int"), F.lit(0))
    p = probs()
    made = fuse.hybrid(p, [p[1], p[2], p[0]], C("y_pred"), prior, weight, F.when(C("fold") == 3, F.lit(None)).otherwise(C("y_pred")), 2 * C("pa"), C("fold") == 0, C("model_name") == "tree")
    return predictions(spark, d).select("vec_id", *[F.round(x, 6).alias(c) for x, c in zip(made, labels.OUTCOMES, strict=True)])


FOUR = f"""{CASES}, f AS (SELECT *, CASE WHEN source = 'src5' THEN label END AS seed, CASE WHEN n_chars % 4 = 0 THEN 'unknown' WHEN core > 1 THEN 'support' ELSE 'partial' END AS weak, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN topic > 1 THEN 'support' ELSE 'not_support' END AS model, CASE WHEN risk = 1 THEN 'unknown' WHEN topic > 2 THEN 'support' WHEN core = 0 THEN 'unknown' ELSE 'partial' END AS post, CASE WHEN lang = 'de' THEN 'unknown' ELSE 'owner' END AS party, CASE WHEN review = 0 THEN (n_chars % 89) / 88::DOUBLE END AS sure FROM c),
 g AS (SELECT *, nullif(weak, 'unknown') AS w, model AS m, nullif(post, 'unknown') AS p FROM f),
 h AS (SELECT *, CASE WHEN seed IS NOT NULL THEN seed WHEN w = p THEN w WHEN m = p THEN m WHEN w = m THEN w ELSE coalesce(p, w, m, 'unknown') END AS out, CASE WHEN seed IS NOT NULL THEN 'seed_reference' WHEN w = p THEN 'weak+post_agree' WHEN m = p THEN 'llm+post_agree' WHEN w = m THEN 'weak+llm_agree' WHEN p IS NOT NULL THEN 'post_only' WHEN w IS NOT NULL THEN 'weak_only' WHEN m IS NOT NULL THEN 'llm_only' ELSE 'none' END AS provenance,
  (len(list_distinct(list_filter([w, m, p], lambda x: x IS NOT NULL))) > 1)::INT AS clash FROM g),
 k AS (SELECT *, round(greatest(0.05, least(0.98, 0.2::DOUBLE + CASE WHEN seed IS NOT NULL THEN 0.25::DOUBLE + coalesce(least(sure * 0.3::DOUBLE, 0.3), 0.2) ELSE 0 END + CASE WHEN p IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + 0.15::DOUBLE * coalesce((w = out)::INT, 0) + 0.15::DOUBLE * coalesce((m = out)::INT, 0) + CASE WHEN party <> 'unknown' THEN 0.08::DOUBLE ELSE 0 END + coverage * 0.12::DOUBLE - 0.18::DOUBLE * clash)), 4) AS confidence FROM h)"""


@query("d8_candidate_record", f"WITH {FOUR} SELECT doc_id, out AS label, provenance, clash AS conflict, confidence, (clash = 1 OR confidence < 0.78 OR party = 'unknown')::INT AS needs_review FROM k")
def d8(spark, d):
    seed = F.when(C("source") == "src5", C("label"))
    weak = F.when(C("n_chars") % 4 == 0, "unknown").when(C("core") > 1, "support").otherwise("partial")
    model = F.when(C("n_chars") % 3 == 0, F.lit(None)).when(C("topic") > 1, "support").otherwise("not_support")
    post = F.when(C("risk") == 1, "unknown").when(C("topic") > 2, "support").when(C("core") == 0, "unknown").otherwise("partial")
    made = labels.candidate(seed, weak, model, post, F.when(C("review") == 0, (C("n_chars") % 89) / 88.0), F.when(C("lang") == "de", "unknown").otherwise("owner"), C("coverage"))
    return cases(spark, d).select("doc_id", made.alias("m")).select("doc_id", "m.*")


@query("d14_screening_gate", f"WITH {CASES} SELECT doc_id, (source <> 'src2' AND conf >= 0.4 AND coverage >= 0.25 AND rel >= 0.25 AND core > 0 AND topic > 0 AND review = 0 AND conflict = 0 AND risk = 0 AND NOT regexp_matches(left(text, 100), 'not|kein')) AS accepted FROM c")
def d14(spark, d):
    bucket = F.when(C("source") != "src2", "accept").otherwise("reject")
    gate = labels.accepted(bucket, C("conf"), C("coverage"), C("rel"), C("core") > 0, C("topic") > 0, C("review") == 0, C("conflict") == 0, C("risk") == 1, F.left("text", F.lit(100)), "not|kein", 0.4, 0.25)
    return cases(spark, d).select("doc_id", gate.alias("accepted"))


KNOWN, MERITS = "label <> 'unknown'", "label <> 'unknown' AND core > 0 AND topic > 0 AND risk = 0"
STRONG, USABLE = f"{MERITS} AND conf >= 0.8 AND rel >= 0.5 AND conflict = 0 AND review = 0 AND said >= 4", f"{MERITS} AND conf >= 0.72 AND rel >= 0.4 AND conflict = 0 AND said >= 4"
LOOSE = {"relaxed": f"{MERITS} AND conf >= 0.4 AND rel >= 0.3 AND conflict = 0 AND said >= 2", "ultra": f"{KNOWN} AND conf >= 0.4 AND said >= 2"}
TIERED = ", ".join(f"CASE WHEN NOT ({KNOWN}) THEN 'unknown_or_discarded' WHEN {STRONG} THEN 'strong_label' WHEN {USABLE} THEN 'lora_usable_label' WHEN {x} THEN 'relaxed_lora_usable_label' ELSE 'weak_label' END AS {n}_bucket, CASE WHEN {STRONG} THEN 'strong' WHEN {USABLE} THEN 'standard_lora' WHEN {x} THEN 'relaxed_lora' ELSE 'weak_or_unknown' END AS {n}_tier" for n, x in LOOSE.items())


@query("d17_label_tiers", f"WITH {CASES}, b AS (SELECT *, length(trim(left(text, 5))) AS said FROM c) SELECT doc_id, {TIERED} FROM b")
def d17(spark, d):
    made = [labels.label_tiers(C("label"), C("conf"), C("rel"), F.left("text", F.lit(5)), C("core") > 0, C("topic") > 0, C("risk") == 1, C("conflict") == 1, C("review") == 1, (0.4, 0.3, 2), ultra=ultra) for ultra in (False, True)]
    return cases(spark, d).select("doc_id", *[m[f].alias(f"{n}_{f}") for n, m in zip(LOOSE, made, strict=True) for f in ("bucket", "tier")])


@query("g16_label_health", f"WITH {CASES}, o AS (SELECT lang, label, conflict, CASE WHEN topic > 1 THEN 'support' ELSE 'partial' END AS other FROM c), n AS (SELECT lang, label, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT lang, max(n) AS top FROM n GROUP BY 1) SELECT lang, round(avg((label = 'unknown')::INT), 6) AS unknown_ratio, round(any_value(top) / count(*), 6) AS max_class_ratio, round(avg(conflict), 6) AS conflict_rate, round(avg((label <> other)::INT), 6) AS disagreement_rate FROM o JOIN x USING (lang) GROUP BY lang")
def g16(spark, d):
    return labels.label_health(cases(spark, d).withColumn("other", F.when(C("topic") > 1, "support").otherwise("partial")), ["lang"], "label", "conflict", "other")


MECH = {"documentation_gap": (["tion", "und"], 2.0), "procedure_risk": (["que", "eit"], 2.0), "ambiguity": (["ing ", "los "], 2.0), "concurrency": (["ado", "eau"], 2.0), "critical_path": (["ment", "ung"], 2.0), "negotiation": (["ción", "the "], 2.0)}
INDEX = ", ".join(f"round(least(1, {hits_sql(terms)} / {by}::DOUBLE), 4) AS {name}" for name, (terms, by) in MECH.items())


@query("c20_six_indices", f"SELECT doc_id, {INDEX} FROM documents")
def c20(spark, d):
    return table(spark, d, "documents").select("doc_id", *features.mechanism_indices(C("text"), MECH))


SHIFT = f"""i AS (SELECT doc_id AS vec_id, {INDEX} FROM documents), x AS (SELECT v, w, vec_id, y_true, pa, pb, pc, CASE WHEN v = 'no_chain' THEN 0 ELSE documentation_gap END AS gap, procedure_risk AS pr, ambiguity AS am, concurrency AS co, CASE WHEN v = 'no_chain' THEN 0 ELSE critical_path END AS cp, CASE WHEN v = 'no_chain' THEN 0 ELSE negotiation END AS ne FROM pred JOIN i USING (vec_id), v),
 r AS (SELECT *, 0.36::DOUBLE * gap + 0.26::DOUBLE * pr + 0.24::DOUBLE * am + 0.14::DOUBLE * co AS risk, 0.36::DOUBLE * cp + 0.24::DOUBLE * (1 - gap) + 0.18::DOUBLE * (1 - pr) + 0.22::DOUBLE * ne AS back, greatest(am, co) AS doubt FROM x),
 s1 AS (SELECT *, CASE WHEN risk > 0.42 THEN least(0.16, w * (risk - 0.42::DOUBLE)) ELSE 0 END AS d1 FROM r), s2 AS (SELECT * REPLACE (greatest(0, pa - d1) AS pa, pc + d1 AS pc), CASE WHEN back > 0.62 AND gap < 0.55 THEN least(0.12, w * (back - 0.62::DOUBLE)) ELSE 0 END AS d2 FROM s1),
 s3 AS (SELECT * REPLACE (pa + d2 AS pa, greatest(0, pc - d2) AS pc), CASE WHEN doubt > 0.5 THEN least(0.1, w * 0.5::DOUBLE * doubt) ELSE 0 END AS d3 FROM s2),
 s4 AS (SELECT * REPLACE (CASE WHEN pa >= pc THEN greatest(0, pa - d3) ELSE pa END AS pa, pb + d3 AS pb, CASE WHEN pa >= pc THEN pc ELSE greatest(0, pc - d3) END AS pc) FROM s3)"""


@query("k22_mechanism_shift", f"WITH {PRED}, v AS (SELECT * FROM (VALUES ('full', 0.3::DOUBLE), ('no_chain', 0.3::DOUBLE), ('no_mechanism', 0::DOUBLE)) t(v, w)), {SHIFT} SELECT vec_id, v AS variant, round(pa / (pa + pb + pc), 6) AS support, round(pb / (pa + pb + pc), 6) AS \"partial\", round(pc / (pa + pb + pc), 6) AS not_support, (risk >= 0.5 AND doubt >= 0.5) AS high_dispute FROM s4")
def k22(spark, d):
    """Full calibration, without what the evidence chain says, and without any mechanism."""
    rows = predictions(spark, d).join(c20(spark, d).withColumnRenamed("doc_id", "vec_id"), "vec_id")
    m, out = {c: C(c) for c in MECH}, []
    for variant, weight, chain in (("full", 0.3, True), ("no_chain", 0.3, False), ("no_mechanism", 0.0, True)):
        gap = C("documentation_gap") if chain else F.lit(0.0)
        risk = 0.36 * gap + 0.26 * C("procedure_risk") + 0.24 * C("ambiguity") + 0.14 * C("concurrency")
        high = (risk >= 0.5) & (F.greatest("ambiguity", "concurrency") >= 0.5)
        moved = fuse.mechanism_shift(probs(), m, F.lit(weight), evidence_chain=chain)
        out.append(F.struct(F.lit(variant).alias("variant"), *[F.round(p, 6).alias(c) for p, c in zip(moved, labels.OUTCOMES, strict=True)], high.alias("high_dispute")))
    return rows.select("vec_id", F.inline(F.array(*out)))


GRID = [0.0, 0.08, 0.2, 0.5, 1.0]


@query("k23_weight_grid", f"WITH {PRED}, v AS (SELECT 'full' AS v, unnest({GRID})::DOUBLE AS w), {SHIFT}, rows_ AS (SELECT w AS g, y_true, CASE WHEN round(pa, 9) >= greatest(round(pb, 9), round(pc, 9)) THEN 'support' WHEN round(pb, 9) >= round(pc, 9) THEN 'partial' ELSE 'not_support' END AS y_pred FROM s4 WHERE vec_id % 5 <> 0), {GROUP_F1} SELECT g AS weight, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, g) = 1 AS chosen FROM m")
def k23(spark, d):
    """The weight of the mechanisms, chosen on four folds; the fifth is not looked at."""
    rows = predictions(spark, d).join(c20(spark, d).withColumnRenamed("doc_id", "vec_id"), "vec_id")
    shifted = lambda w: fuse.argmax(fuse.mechanism_shift(probs(), {c: C(c) for c in MECH}, w))
    return fuse.tuned(rows, GRID, shifted, "y_true", C("fold") != 0)


HEATS = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


@query("j9_temperature_crossfit", f"""WITH {PRED}, t AS (SELECT fold, T, sum(-ln(greatest(CASE y_true WHEN 'support' THEN pow(pa, 1 / T) WHEN 'partial' THEN pow(pb, 1 / T) ELSE pow(pc, 1 / T) END / (pow(pa, 1 / T) + pow(pb, 1 / T) + pow(pc, 1 / T)), 1e-12))) AS s, count(*) AS n FROM pred, (SELECT unnest({HEATS})::DOUBLE AS T) GROUP BY ALL),
 o AS (SELECT *, round(sum(s) OVER (PARTITION BY T) - s, 9) AS rest FROM t), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rest, T) = 1) SELECT b.fold, b.T AS temperature, round(a.s / a.n, 6) AS nll_before, round(b.s / b.n, 6) AS nll_after FROM b JOIN t a ON a.fold = b.fold AND a.T = 1""")
def j9(spark, d):
    return evaluate.crossfit_temperature(predictions(spark, d), "fold", list(range(5)), "y_true", probs(), HEATS)


@query("e16_pool_overlap", f"WITH {CASES}, h AS (SELECT sha256(text) AS h, bool_or(core > 0) AS a, bool_or(topic > 1) AS b FROM c GROUP BY 1) SELECT unnest(['both', 'core_only', 'topic_only']) AS part, unnest([count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE b AND NOT a)]) AS n FROM h")
def e16(spark, d):
    rows = hashed(spark, d)
    return sets.pool_overlap(rows.filter("core > 0"), rows.filter("topic > 1"), "hash", ("core", "topic"))


@query("f20_forbidden_fields", "SELECT unnest(['path', 'user_id', 'label']) AS field, unnest([count(*) FILTER (WHERE regexp_matches(props, '\"path\"\\s*:')), count(*) FILTER (WHERE regexp_matches(props, '\"user_id\"\\s*:')), count(*) FILTER (WHERE regexp_matches(props, '\"label\"\\s*:'))]) AS n FROM events")
def f20(spark, d):
    return sets.forbidden_fields(table(spark, d, "events"), "props", ["path", "user_id", "label"])


@query("g9_censored_trend", """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT min(y) AS lo, max(y) AS hi FROM y), a AS (SELECT unnest(generate_series(lo, hi)) AS y FROM r), t AS (SELECT a.y, coalesce(n, 0) AS n, avg(coalesce(n, 0)) OVER (ORDER BY a.y ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trend, a.y > (SELECT hi FROM r) - 2 AS censored FROM a LEFT JOIN y USING (y)),
 s AS (SELECT avg(trend) AS carry FROM (SELECT trend FROM t WHERE NOT censored ORDER BY y DESC LIMIT 3)) SELECT y::INT AS year, n, round(trend, 6) AS trend, censored, round(CASE WHEN censored THEN coalesce(carry, trend) ELSE trend END, 6) AS display FROM t, s""")
def g9(spark, d):
    """Orders by year with a five-year trailing mean; the last two years carry the mean of the last three stable points. A row for each year from the first count on."""
    from pyspark.sql import Window

    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).filter("year is not null")
    ends = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    years = ends.filter("lo is not null").select("hi", F.explode(F.sequence("lo", "hi")).alias("year"))
    trend = F.avg("n").over(Window.orderBy("year").rowsBetween(-4, 0))
    rows = years.join(counts, "year", "left").fillna(0, ["n"]).withColumns({"trend": trend, "censored": C("year") > C("hi") - 2})
    carry = rows.filter(~C("censored")).orderBy(F.desc("year")).limit(3).agg(F.avg("trend").alias("carry"))  # three years
    display = F.when(C("censored"), F.coalesce("carry", "trend")).otherwise(C("trend"))
    return rows.crossJoin(F.broadcast(carry)).select("year", "n", F.round("trend", 6).alias("trend"), "censored", F.round(display, 6).alias("display"))


OUTCOME = [("partial", "teil|part"), ("not_support", "not |nicht"), ("support", "ist |is ")]
SNIPPETS = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{{0}}'" for _, p in OUTCOME)


def snippet_sql(pattern: str) -> str:
    at = f"(length(string_split_regex(text, '{pattern}')[1]) + 1)"
    begin = f"greatest({at} - 80, 1)"
    return f"substr(text, {begin}, {at} - {begin} + length(regexp_extract(text, '{pattern}')) + 120)"


@query("d4_outcome_snippet", f"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(text, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{c}{chr(39)}' for c, p in OUTCOME)} ELSE 'unknown' END AS label, CASE {' '.join(f'WHEN regexp_matches(text, {chr(39)}{p}{chr(39)}) THEN {snippet_sql(p)}' for _, p in OUTCOME)} ELSE '' END AS snippet FROM documents")
def d4(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.outcome_with_snippet(C("text"), OUTCOME).alias("m")).select("doc_id", "m.*")


EXPLICIT = [("both", ["tion und", "que les"], 3.0), ("policy", ["ment", "heit"], 2.4)]
SAID = [("owner", ["tion", "ung"], ["ing", "ed "], 1.6), ("contractor", ["eau", "que"], ["les", "ent"], 1.6), ("subcontractor", ["los", "para"], ["ado", "ción"], 1.3), ("designer", ["ich", "ein"], ["die", "der"], 1.2)]
ORDER = ["both", "policy", "owner", "contractor", "subcontractor", "designer"]
PARTY = f"""s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS p FROM documents),
 e AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'owner' WHEN n_chars % 3 = 1 THEN 'unknown' END AS hint, text FROM documents),
 w AS ({' UNION ALL '.join([f"SELECT doc_id, '{c}' AS label, {hits_sql(t)} * {w}::DOUBLE AS score FROM documents" for c, t, w in EXPLICIT] + [f"SELECT doc_id, '{c}', count(*) FILTER (WHERE {any_sql(a, 'p')} AND {any_sql(b, 'p')}) * {w}::DOUBLE FROM s GROUP BY doc_id" for c, a, b, w in SAID] + ["SELECT doc_id, hint, 1.2::DOUBLE FROM e WHERE hint <> 'unknown'"])}),
 t AS (SELECT doc_id, label, round(sum(score), 6) AS score FROM w GROUP BY ALL HAVING round(sum(score), 6) > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, list_position({ORDER}, label)) AS r FROM t)"""


def scored_parties(spark, d):
    rows = table(spark, d, "documents").withColumn("hint", F.when(C("n_chars") % 3 == 0, "owner").when(C("n_chars") % 3 == 1, "unknown"))
    return rows.withColumn("scores", labels.party_scores(C("text"), F.split("text", "[.!?\n]"), EXPLICIT, SAID, C("hint"), 1.2))


@query("d5_responsibility_full", f"WITH {PARTY}, a AS (SELECT doc_id, label, score, score - coalesce((SELECT score FROM r x WHERE x.doc_id = r.doc_id AND x.r = 2), 0) AS margin FROM r WHERE r = 1) SELECT e.doc_id, coalesce(label, CASE WHEN hint <> 'unknown' THEN hint END, 'unknown') AS label, coalesce(round(margin, 4), 0) AS margin, CASE WHEN label IS NOT NULL THEN round(least(0.95, 0.55::DOUBLE + 0.1::DOUBLE * score + 0.05::DOUBLE * margin), 4) WHEN hint <> 'unknown' THEN 0.35 ELSE 0.2 END AS confidence FROM e LEFT JOIN a USING (doc_id)")
def d5(spark, d):
    return scored_parties(spark, d).select("doc_id", labels.responsible(C("scores"), C("hint")).alias("m")).select("doc_id", "m.*")


@query("d6_diagnosis_full", f"""WITH {PARTY}, g AS (SELECT doc_id, max(CASE WHEN r = 1 THEN label END) AS l1, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN label END) AS l2, max(CASE WHEN r = 2 THEN score END) AS s2, sum(score) AS total FROM r GROUP BY doc_id),
 x AS (SELECT e.doc_id, coalesce(l1, 'unknown') AS "primary", CASE WHEN s2 >= greatest(0.8, s1 * 0.7::DOUBLE) THEN l2 ELSE 'unknown' END AS secondary, {hits_sql(CORE)} AS proc, {hits_sql(TOPIC)} AS ev, contains(text, 'password') AS inc, contains(text, '@mail') AS non, coalesce(total, 0) AS total FROM e LEFT JOIN g USING (doc_id)),
 y AS (SELECT *, least(0.95, round(0.35::DOUBLE + 0.08::DOUBLE * total + 0.05::DOUBLE * proc + 0.04::DOUBLE * ev, 4)) AS confidence FROM x)
 SELECT doc_id, "primary", secondary, CASE WHEN "primary" = 'both' OR secondary <> 'unknown' THEN 'shared' WHEN "primary" <> 'unknown' THEN 'single_party' ELSE 'uncertain' END AS kind, CASE WHEN non THEN 'noncompliant' WHEN proc >= 1 THEN 'partially_compliant' ELSE 'uncertain' END AS procedure, CASE WHEN inc THEN 'incomplete' WHEN ev >= 2 THEN 'complete' ELSE 'uncertain' END AS documents, confidence, ("primary" = 'unknown' OR confidence < 0.62)::INT AS uncertain FROM y""")
def d6(spark, d):
    has = lambda t: F.contains(C("text"), F.lit(t))
    made = labels.diagnosis(C("scores"), T.hits(C("text"), CORE), T.hits(C("text"), TOPIC), has("password"), has("@mail"))
    return scored_parties(spark, d).select("doc_id", made.alias("m")).select("doc_id", "m.*")


@query("a8_split_folders", f"WITH {CASES}, o AS (SELECT *, core > 0 AND risk = 0 AS usable FROM c) SELECT output, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(length(text))::BIGINT AS text_chars FROM (SELECT 'full' AS output, * FROM o UNION ALL SELECT 'usable', * FROM o WHERE usable UNION ALL SELECT 'excluded', * FROM o WHERE NOT usable) GROUP BY 1 UNION ALL SELECT 'manifest', count(*), sum(n_chars)::BIGINT, 0 FROM o")
def a8(spark, d):
    """What the folders of a split hold, read back from them."""
    path = package.shared_path(spark, "splits")
    package.write_splits(cases(spark, d).select("doc_id", "text", "n_chars", C("label").alias("tier"), "core", "risk"), path, (C("core") > 0) & (C("risk") == 0))
    out = None
    for name in ("full", "usable", "excluded", "manifest"):
        rows = spark.read.parquet(f"{path}/{name}")
        size = F.sum(F.length("text")) if "text" in rows.columns else F.lit(0).cast("long")
        one = rows.agg(F.lit(name).alias("output"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), size.alias("text_chars"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a9_record_files", "SELECT md5('Reply as ' || role) AS instruction, md5(coalesce(conv_id::VARCHAR, '')) AS input, md5(text) AS output FROM conversations")
def a9(spark, d):
    """Instruction records written as JSON lines and read back; digests stand for the fields."""
    path = package.shared_path(spark, "records")
    package.write_records(table(spark, d, "conversations"), package.records(F.concat(F.lit("Reply as "), C("role")), C("conv_id").cast("string"), C("text")), path)
    return spark.read.schema("instruction string, input string, output string").json(path).select(*[F.md5(C(c).cast("binary")).alias(c) for c in ("instruction", "input", "output")])


@query("a10_prompt_files", "SELECT md5('### Instruction:' || chr(10) || 'Reply as ' || role || CASE WHEN turn > 0 THEN chr(10) || chr(10) || '### Input:' || chr(10) || turn ELSE '' END || chr(10) || chr(10) || '### Response:' || chr(10) || text) AS prompt FROM conversations")
def a10(spark, d):
    """Prompts written as text and read back."""
    path, turn = package.shared_path(spark, "prompts"), F.when(C("turn") > 0, C("turn").cast("string"))
    mark = "\n\n\x1e\n"
    package.write_prompts(table(spark, d, "conversations"), package.records(F.concat(F.lit("Reply as "), C("role")), turn, C("text")), path, mark)
    return package.read_prompts(spark, path, mark).select(F.md5(C("value").cast("binary")).alias("prompt"))


@query("a11_shard_folders", "WITH s AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS shard FROM documents) SELECT shard::INT AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY 1")
def a11(spark, d):
    path = package.shared_path(spark, "shards")
    package.write_shards(table(spark, d, "documents").select("doc_id", "text"), path, 300, C("doc_id"))
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("h15_package_quality", f"WITH {CASES}, p AS (SELECT doc_id, CASE WHEN source < 'src2' THEN 'dev' ELSE 'train' END AS split, text, label FROM c), i AS (SELECT text, count(*) AS n, count(DISTINCT split) AS s FROM p GROUP BY 1) SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(*) FILTER (WHERE doc_id IS NULL) FROM p) AS missing_ids, 0::BIGINT AS empty_outputs, sum(n - 1)::BIGINT AS repeated_inputs, count(*) FILTER (WHERE s > 1) AS inputs_across_splits FROM i")
def h15(spark, d):
    """The quality report of a package, from its folder."""
    path = package.shared_path(spark, "package")
    rows = cases(spark, d).select("doc_id", F.when(C("source") < "src2", "dev").otherwise("train").alias("split"), "text", "label")
    package.write_package(rows, path, "doc_id", "split", "label", package.records(F.lit("Decide"), C("text"), C("label")))
    return spark.read.parquet(f"{path}/quality")
