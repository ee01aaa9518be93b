"""Queries of records, views, boundaries and traces in full (2-C, 2-D, 2-E, 2-H, 2-J, 2-K)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, features, fuse, labels, pools, sample
from .cases import CASES, cases
from .evaluation import GROUP_F1, PRED, predictions, probs
from .features import CORE, EVIDENCE, RISK, TOPIC, any_sql, chain_sql, chained, hits_sql
from .registry import query, table

C = F.col
DECISION = ["al ", "le ", "en "]


@query("e6_four_pools", f"""WITH t AS (SELECT doc_id, n_chars AS n, {hits_sql(CORE)} AS con, {hits_sql(TOPIC)} AS del, {any_sql(TOPIC[:1])} AS core, {hits_sql(EVIDENCE)} AS ev, {hits_sql(DECISION)} AS dec, {hits_sql(RISK, "left(text, 3000)")} AS proc FROM documents),
 f AS (SELECT *, con >= 1 AND dec >= 1 AND proc = 0 AS fit, del >= 2 OR core AS topic FROM t)
 SELECT doc_id, (fit AND del >= 1 AND n >= 1200)::INT AS research_candidate, (fit AND topic AND n >= 1500)::INT AS relaxed, (fit AND topic AND n >= 1800)::INT AS usable, (fit AND topic AND n >= 1800 AND ev >= 1 AND dec >= 2)::INT AS strong FROM f""")
def e6(spark, d):
    text = C("text")
    flags = pools.lexical_pools(C("n_chars"), T.hits(text, CORE), T.hits(text, TOPIC), T.any_of(text, TOPIC[:1]), T.hits(text, EVIDENCE), T.hits(text, DECISION), T.hits(F.left(text, F.lit(3000)), RISK))
    return table(spark, d, "documents").select("doc_id", *flags)


def chosen_sql(ok: str, preferred: list[str], n: int) -> str:
    by = "conflict DESC, round(conf, 9) DESC, n_chars DESC, doc_id"
    return f"""WITH {CASES}, k AS (SELECT * FROM c WHERE {ok} OR NOT (SELECT coalesce(bool_or({ok}), FALSE) FROM c)),
 r AS (SELECT doc_id, lang, coalesce(list_position({preferred}, lang), 0) AS place, row_number() OVER (PARTITION BY lang ORDER BY {by}) AS best, row_number() OVER (ORDER BY {by}) AS r FROM k)
 SELECT doc_id, lang, row_number() OVER (ORDER BY CASE WHEN best = 1 AND place > 0 THEN place ELSE 99 END, r)::INT AS position FROM r QUALIFY position <= {n}"""


@query("e21_preferred_representatives", chosen_sql("source = 'src1'", ["de", "xx", "fr"], 5))
def e21(spark, d):
    """The best German and French cases of one source, then the best of the others."""
    return pools.representatives(cases(spark, d).drop("text"), "lang", ["de", "xx", "fr"], ["conflict", "conf", "n_chars"], "doc_id", 5, C("source") == "src1").select("doc_id", "lang", "position")


@query("e21_without_eligible", chosen_sql("source = 'none'", ["es"], 3))
def e21_all(spark, d):
    """No case is eligible, so all are looked at."""
    return pools.representatives(cases(spark, d).drop("text"), "lang", ["es"], ["conflict", "conf", "n_chars"], "doc_id", 3, C("source") == "none").select("doc_id", "lang", "position")


@query("h10_minority_views", rf"""WITH m AS (SELECT * FROM documents WHERE lang = 'es'), p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM m),
 s AS (SELECT doc_id, left(string_agg(p, chr(10) ORDER BY i), 3000) AS v FROM p WHERE {any_sql(TOPIC + EVIDENCE, "p")} GROUP BY 1)
 SELECT doc_id || '__aug1' AS doc_id, doc_id AS source_key, 1 AS is_augmented, left(text, 240) || chr(10) || 'evidence: ' || substr(text, 101, 80) AS text FROM m UNION ALL SELECT doc_id || '__aug2', doc_id, 1, v FROM s WHERE trim(v) <> ''""")
def h10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "text")
    return sample.minority_views(rows, "doc_id", "text", C("lang") == "es", F.left("text", F.lit(240)), F.substring("text", 101, 80), TOPIC + EVIDENCE).drop("lang")


@query("k15_boundary_rules", f"""WITH {PRED}, f AS (SELECT vec_id, pa, pb, pc, fold / 5::DOUBLE AS gap, confidence AS proc, pa AS caus, 0.6::DOUBLE * pa + 0.4::DOUBLE * pb AS fa, 0.6::DOUBLE * pb + 0.4::DOUBLE * pc AS fb, 0.6::DOUBLE * pc + 0.4::DOUBLE * pa AS fc, 0.55::DOUBLE * pa + 0.45::DOUBLE * pb AS sa, 0.55::DOUBLE * pb + 0.45::DOUBLE * pc AS sb, 0.55::DOUBLE * pc + 0.45::DOUBLE * pa AS sc FROM pred),
 b AS (SELECT *, round(fa + 0.08, 9) AS ba, round(fb + 0.02, 9) AS bb, round(fc, 9) AS bc, round(fa + CASE WHEN round(sa, 9) >= 0.33 THEN 0.1 WHEN round(sa, 9) < 0.18 THEN -0.05 ELSE 0 END, 9) AS ta FROM f),
 o AS (SELECT *, CASE WHEN ba >= greatest(bb, bc) THEN 'support' WHEN bb >= bc THEN 'partial' ELSE 'not_support' END AS boost FROM b)
 SELECT vec_id, CASE WHEN round(pc + 0.08 * gap + 0.05 * proc + 0.05 * caus - greatest(pa, pb) - 0.05, 9) >= 0 THEN 'not_support' WHEN round(pb + 0.08 * caus + 0.04 * proc - pa, 9) >= 0 THEN 'partial' ELSE 'support' END AS two_stage, boost,
  CASE WHEN round(pc, 9) > greatest(round(pa, 9), round(pb, 9)) AND round(pa, 9) > greatest(round(pb, 9), round(pc, 9)) THEN 'not_support' WHEN boost = 'not_support' AND round(pa + pb, 9) > 0.55 THEN 'partial' ELSE boost END AS boundary,
  CASE WHEN round(sa, 9) >= 0.28 THEN 'support' WHEN round(sb, 9) >= round(sc, 9) THEN 'partial' ELSE 'not_support' END AS detected, round(sa, 6) AS score,
  CASE WHEN ta >= greatest(round(fb, 9), round(fc, 9)) THEN 'support' WHEN round(fb, 9) >= round(fc, 9) THEN 'partial' ELSE 'not_support' END AS tuned FROM o""")
def k15(spark, d):
    base, retrieved = probs(), [C("pb"), C("pc"), C("pa")]
    fused = [0.6 * p + 0.4 * q for p, q in zip(base, retrieved, strict=True)]
    rows = predictions(spark, d).withColumn("boost", fuse.boosted(fused)).withColumn("found", fuse.support_detector(base, retrieved))
    return rows.select(
        "vec_id", fuse.two_stage(base, C("fold") / 5.0, C("confidence"), C("pa")).alias("two_stage"), "boost", fuse.boundary(C("boost"), base, retrieved).alias("boundary"),
        C("found.label").alias("detected"), F.round("found.score", 6).alias("score"), fuse.support_tuned(fused, C("found.score")).alias("tuned"),
    )


WORDS = {"issue": "who answers for the delay", "basis": "a basis of the claim is stated", "procedure": "procedure: ", "records": "complete the records", "repair": "mend notices and approvals", "keep": "keep the records as they are"}
APPLIED = ("cause", "impact")


@query("k24_reasoning_trace_full", f"""WITH {chain_sql()}, g AS (SELECT doc_id, {', '.join(f"max(CASE WHEN role = '{r}' THEN text END) AS {r}_" for r in ("entitlement", *APPLIED))}, count(*) FILTER (WHERE text <> '') AS cites FROM u GROUP BY 1),
 j AS (SELECT g.*, CASE WHEN {hits_sql(TOPIC, "d.text")} = 0 THEN 'noncompliant' WHEN {hits_sql(TOPIC, "d.text")} > 1 THEN 'compliant' ELSE 'uncertain' END AS status, d.n_chars < 1500 AS incomplete, d.n_chars % 5 = 0 AS doubt, {any_sql(RISK, "d.text")} AS risk FROM g JOIN documents d USING (doc_id))
 SELECT doc_id, concat_ws('|', CASE WHEN entitlement_ <> '' THEN '{WORDS["basis"]}' END, CASE WHEN status <> 'uncertain' THEN '{WORDS["procedure"]}' || status END) AS rule_basis,
  concat_ws('|', {', '.join(f"CASE WHEN {r}_ <> '' THEN '{r}=' || left({r}_, 180) END" for r in APPLIED)}) AS findings, cites::INT AS citations, (NOT risk)::INT AS leakage_check,
  CASE WHEN NOT incomplete AND status <> 'noncompliant' THEN '{WORDS["keep"]}' ELSE concat_ws('|', CASE WHEN incomplete THEN '{WORDS["records"]}' END, CASE WHEN status = 'noncompliant' THEN '{WORDS["repair"]}' END) END AS actions, (doubt OR cites / 4 < 0.45)::INT AS high_dispute FROM j""")
def k24(spark, d):
    facts = table(spark, d, "documents").select("doc_id", "lang", "n_chars", T.hits(C("text"), TOPIC).alias("topic"), T.any_of(C("text"), RISK).alias("risk"))
    status = F.when(C("topic") == 0, "noncompliant").when(C("topic") > 1, "compliant").otherwise("uncertain")
    enough = features.chain_metrics(C("chain"))["coverage"]
    trace = fuse.reasoning_trace(C("doc_id"), F.lit("support"), C("lang"), F.array("doc_id"), C("chain"), status, C("n_chars") < 1500, C("n_chars") % 5 == 0, enough, C("risk"), WORDS, "entitlement", list(APPLIED))
    rows = chained(spark, d).join(facts, "doc_id").select("doc_id", trace.alias("t"))
    found = F.array_join(F.transform("t.application_findings", lambda x: F.concat(x["role"], F.lit("="), x["text"])), "|")
    return rows.select(
        "doc_id", F.array_join("t.rule_basis", "|").alias("rule_basis"), found.alias("findings"), F.size("t.evidence_citations").alias("citations"), C("t.leakage_check").alias("leakage_check"),
        F.array_join("t.management_action", "|").alias("actions"), C("t.high_dispute_flag").alias("high_dispute"),
    )


HEADERS = ["Project context", "Claims and defenses", "Dispute focus"]
LINE = r"trim(regexp_replace(left(text, 300), '\s+', ' ', 'g'))"


@query("c27_record_checks_full", rf"""WITH r AS (SELECT doc_id, n_chars, {LINE} AS a, CASE WHEN n_chars % 3 = 0 THEN '' ELSE left({LINE}, 40) END AS b, CASE WHEN n_chars % 4 = 0 THEN '' ELSE right({LINE}, 40) END AS e, CASE WHEN n_chars % 7 = 0 THEN '' ELSE doc_id::VARCHAR END AS id, CASE n_chars % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'partial' END AS label FROM documents),
 s AS (SELECT *, 'Case ID: ' || id || chr(10) || 'Project context: ' || a || chr(10) || 'Claims and defenses: ' || b || chr(10) || 'Dispute focus: ' || e AS record FROM r), o AS (SELECT *, trim(a) || chr(10) || trim(b) || chr(10) || trim(e) AS body FROM s)
 SELECT doc_id, id AS case_id, id = '' AS case_id_missing, TRUE AS record_present, coalesce(label IN ('support', 'partial'), FALSE) AS label_valid, ((a = '')::INT + (b = '')::INT) AS missing_field_count, concat_ws('|', CASE WHEN a = '' THEN '{HEADERS[0]}' END, CASE WHEN b = '' THEN '{HEADERS[1]}' END) AS missing_fields,
  {any_sql(CORE, "body")} AS post_decision_risk, concat_ws('|', {', '.join(f"CASE WHEN contains(body, '{t}') THEN '{t}' END" for t in CORE)}) AS post_decision_terms, length(body)::INT AS summary_chars, 0 AS summary_chinese_chars, length(record)::INT AS record_chars, id <> '' AND coalesce(label IN ('support', 'partial'), FALSE) AS field_parse_ok FROM o""")
def c27(spark, d):
    line = F.trim(F.regexp_replace(F.left("text", F.lit(300)), r"\s+", " "))
    some = lambda n, value: F.when(C("n_chars") % n == 0, "").otherwise(value)
    parts = [some(7, C("doc_id").cast("string")), line, some(3, F.left(line, F.lit(40))), some(4, F.right(line, F.lit(40)))]
    record = F.concat_ws("\n", *[F.concat(F.lit(f"{h}: "), p) for h, p in zip(["Case ID", *HEADERS], parts, strict=True)])
    label = F.when(C("n_chars") % 3 == 0, "support").when(C("n_chars") % 3 == 1, "partial")
    rows = table(spark, d, "documents").select("doc_id", record.alias("record"), label.alias("label"))
    return rows.select("doc_id", *features.record_checks(C("record"), C("label"), "Case ID", HEADERS, 2, CORE, labels.OUTCOMES))


@query("d12_response_record", """WITH r AS (SELECT doc_id, text, n_chars, CASE n_chars % 4 WHEN 0 THEN 'partially_support' WHEN 1 THEN 'Support' WHEN 2 THEN 'none' END AS said FROM documents),
 o AS (SELECT *, CASE n_chars % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'support' ELSE 'unknown' END AS label, length(text) > 0 AS filled FROM r)
 SELECT doc_id, label AS outcome_label, CASE n_chars % 2 WHEN 0 THEN 'owner' ELSE 'unknown' END AS primary_responsible_party, 'unknown' AS secondary_responsible_party, 'uncertain' AS responsibility_type, left(text, 300) AS issue, '' AS rule, left(text, 800) AS application, '' AS conclusion, '' AS management_action, '' AS managerial_failure_type,
  round(least(1, n_chars / 4000::DOUBLE), 6) AS outcome_confidence, 0::DOUBLE AS responsibility_confidence, 0::DOUBLE AS documentation_gap_index, 0::DOUBLE AS procedural_compliance_risk, 0::DOUBLE AS causality_ambiguity, 0::DOUBLE AS concurrency_risk, 0::DOUBLE AS critical_path_support, 0::DOUBLE AS negotiation_readiness_score,
  (label = 'unknown' OR n_chars % 5 = 0)::INT AS uncertainty_flag, 3 AS span_count, CASE WHEN filled THEN round(2 / 3, 6) ELSE 0 END AS valid_rate, round(1 / 3, 6) AS duplicate_rate FROM o""")
def d12(spark, d):
    said = F.when(C("n_chars") % 4 == 0, "partially_support").when(C("n_chars") % 4 == 1, "Support").when(C("n_chars") % 4 == 2, "none")
    parts = {"outcome_label": said, "primary_responsible_party": F.when(C("n_chars") % 2 == 0, " Employer"), "issue": C("text"), "application": C("text"), "outcome_confidence": (C("n_chars") / 4000).cast("string"), "responsibility_confidence": F.lit("-1"), "concurrency_risk": F.lit("none"), "uncertainty_flag": (C("n_chars") % 5 == 0).cast("string")}
    reply = F.create_map(*[x for name, value in parts.items() for x in (F.lit(name), value)])
    quoted = F.array(F.left("text", F.lit(30)), F.lit("no such span at all"), F.left("text", F.lit(30)))
    return table(spark, d, "documents").select("doc_id", *labels.response_record(reply, C("text"), quoted, {"owner": ["employer", "owner"], "contractor": ["contractor"]}))


REPORTED = "(VALUES ('0|tree', 0.33, 0.3, 0.3), ('9|none', 0.5, 0.5, 0.5))"


@query("j16_recomputed_full", f"""WITH {PRED}, rows_ AS (SELECT fold::VARCHAR || '|' || model_name AS g, y_true, y_pred FROM pred), {GROUP_F1},
 t AS (SELECT g, accuracy AS a, macro_f1 AS f, weighted_f1 AS w FROM m WHERE g LIKE '1%' OR g LIKE '2%' UNION ALL SELECT g, accuracy + 0.01, macro_f1, weighted_f1 FROM m WHERE g LIKE '3%' UNION ALL SELECT * FROM {REPORTED} v(g, a, f, w))
 SELECT coalesce(m.g, t.g) AS g, coalesce(n, 0) AS n, accuracy AS accuracy_recomputed, macro_f1 AS macro_f1_recomputed, weighted_f1 AS weighted_f1_recomputed, a::DOUBLE AS summary_accuracy, f::DOUBLE AS summary_macro_f1, w::DOUBLE AS summary_weighted_f1,
  (m.g IS NOT NULL AND coalesce(abs(a - accuracy) < 5e-4, TRUE) AND coalesce(abs(f - macro_f1) < 5e-4, TRUE) AND coalesce(abs(w - weighted_f1) < 5e-4, TRUE))::INT AS metric_match, CASE WHEN m.g IS NULL THEN 'unverifiable' ELSE 'complete' END AS traceability_status FROM m FULL JOIN t ON m.g = t.g""")
def j16(spark, d):
    """Reports that agree for two folds, are 0.01 off for a third, are wrong for one group and name a group nobody predicted."""
    rows = predictions(spark, d).select(F.concat(C("fold").cast("string"), F.lit("|"), "model_name").alias("g"), "y_true", "y_pred")
    made = evaluate.scores(rows, ["g"]).select("g", *evaluate.METRICS)
    told = made.filter("left(g, 1) in ('1', '2')").unionByName(made.filter("left(g, 1) = '3'").withColumn("accuracy", C("accuracy") + 0.01))
    fixed = spark.createDataFrame([("0|tree", 0.33, 0.3, 0.3), ("9|none", 0.5, 0.5, 0.5)], "g string, accuracy double, macro_f1 double, weighted_f1 double")
    return evaluate.recomputed(rows, told.unionByName(fixed), ["g"], 5e-4)


@query("j21_run_risks", f"""WITH {PRED}, rows_ AS (SELECT fold AS g, y_true, y_pred FROM pred), {GROUP_F1}, r AS (SELECT 'run' || g AS run, macro_f1, CASE WHEN g % 2 = 0 THEN 'pre' ELSE 'both' END AS mode, (g % 3)::VARCHAR AS seed FROM m), two AS (SELECT o.*, n.mode AS mode2, n.seed AS seed2, round(o.macro_f1 - n.macro_f1, 6) AS impact FROM r o, r n WHERE n.run = 'run4' AND o.run <> 'run4'),
 x AS (SELECT run, 'text_mode' AS category, mode AS old_value, mode2 AS new_value, mode = 'both' AND mode2 <> 'both' AS raises, impact FROM two UNION ALL SELECT run, 'seed', seed, seed2, FALSE, impact FROM two)
 SELECT run AS old_run, 'run4' AS new_run, category, old_value, new_value, CASE WHEN raises THEN 'yes' WHEN old_value = new_value THEN 'no' ELSE 'unclear' END AS score_inflation_risk, CASE WHEN raises THEN 'raise' WHEN old_value = new_value THEN 'none' ELSE 'mixed' END AS expected_direction, impact, CASE WHEN abs(impact) >= 0.05 THEN 'large' WHEN abs(impact) >= 0.01 THEN 'medium' ELSE 'small' END AS impact_band FROM x""")
def j21(spark, d):
    runs = evaluate.scores(predictions(spark, d), ["fold"]).select(F.concat(F.lit("run"), C("fold").cast("string")).alias("run"), "macro_f1", F.when(C("fold") % 2 == 0, "pre").otherwise("both").alias("mode"), (C("fold") % 3).alias("seed"))
    return evaluate.run_risks(runs, "run", "run4", {"text_mode": ("mode", ["both"]), "seed": ("seed", [])}, "macro_f1")
