"""Queries on labels and response records (2-D)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as O
from .registry import query, table

C = F.col
SPELLINGS = ["support", "Partial_Support", "not-support", "keep partially", "would not", "??"]


def spelling(key):
    return F.element_at(F.array(*map(F.lit, SPELLINGS)), (key % len(SPELLINGS) + 1).cast("int"))


SPELL_SQL = "(ARRAY[" + ", ".join(f"'{s}'" for s in SPELLINGS) + f"])[(doc_id % {len(SPELLINGS)} + 1)::INT]"
#: Labels of two sources and a model, made of labels and documents.
SOURCES = "src AS (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'support' WHEN 0 THEN 'not_support' END AS a, CASE WHEN l.toxic = 1 THEN 'not_support' WHEN l.toxic = 0 THEN 'support' END AS b, CASE d.lang WHEN 'en' THEN 'support' WHEN 'de' THEN 'partial' ELSE 'unknown' END AS c, n_chars, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def sources(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    a = F.when(C("quality") == 1, "support").when(C("quality") == 0, "not_support")
    b = F.when(C("toxic") == 1, "not_support").when(C("toxic") == 0, "support")
    c = F.when(C("lang") == "en", "support").when(C("lang") == "de", "partial").otherwise("unknown")
    return rows.select("doc_id", "n_chars", "toxic", a.alias("a"), b.alias("b"), c.alias("c"))


@query("d1_outcome", f"SELECT doc_id, CASE lower({SPELL_SQL}) WHEN 'support' THEN 'support' WHEN 'partial_support' THEN 'partial' WHEN 'not-support' THEN 'not_support' ELSE 'unknown' END AS exact, CASE lower({SPELL_SQL}) WHEN 'support' THEN 'support' WHEN 'partial_support' THEN 'partial' WHEN 'not-support' THEN 'not_support' WHEN 'keep partially' THEN 'partial' WHEN 'would not' THEN 'not_support' ELSE 'unknown' END AS loose FROM documents")
def d1(spark, d):
    return table(spark, d, "documents").select("doc_id", O.outcome(spelling(C("doc_id"))).alias("exact"), O.outcome(spelling(C("doc_id")), contained=O.CONTAINED).alias("loose"))


@query("d2_party", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'builder' WHEN 'MACHINERY' THEN 'maker' ELSE 'unknown' END AS party FROM customer")
def d2(spark, d):
    return table(spark, d, "customer").select("c_custkey", O.outcome(C("c_mktsegment"), {"building": "builder", "machinery": "maker"}).alias("party"))


@query("d3_fold", "SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 1) THEN 'west' WHEN n_regionkey = 2 THEN 'east' ELSE 'shared' END AS folded FROM nation")
def d3(spark, d):
    return table(spark, d, "nation").select("n_nationkey", O.folded(C("n_regionkey").cast("string"), {"west": ["0", "1"], "east": ["2"]}, "shared").alias("folded"))


@query("d4_outcome_from_text", r"SELECT doc_id, CASE WHEN regexp_matches(text, 'teil|part') THEN 'partial' WHEN regexp_matches(text, '\bnot\b|nicht') THEN 'not_support' WHEN regexp_matches(text, '\bis\b|ist') THEN 'support' ELSE 'unknown' END AS label FROM documents")
def d4(spark, d):
    return table(spark, d, "documents").select("doc_id", O.by_patterns(C("text"), [("partial", "teil|part"), ("not_support", r"\bnot\b|nicht"), ("support", r"\bis\b|ist")], "unknown").alias("label"))


RULES = [("owner", "tion", 1.6), ("owner", "ung", 1.3), ("contractor", "eau", 1.6), ("contractor", "ing", 1.2), ("other", "ado", 1.4)]


@query("d5_responsibility", f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS p FROM documents), r(label, term, w) AS (VALUES {', '.join(f"('{a}', '{b}', {w}::DOUBLE)" for a, b, w in RULES)}),
 s AS (SELECT doc_id, label, sum(w) AS score FROM p JOIN r ON contains(p, term) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) AS r, lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) AS next FROM s)
 SELECT doc_id, label, round(score, 4) AS score, round(score - next, 4) AS margin, round(least(0.95, 0.55 + 0.1 * score + 0.05 * (score - next)), 4) AS confidence FROM k WHERE r = 1""")
def d5(spark, d):
    sentences = F.split(C("text"), r"[.!?\n]")
    with_term = lambda term: F.size(F.filter(sentences, lambda s: F.contains(s, F.lit(term))))
    weights = {}
    for label, term, w in RULES:
        weights.setdefault(label, []).append(with_term(term) * w)
    scored = F.array(*[F.struct(F.round(sum(v[1:], v[0]), 6).alias("score"), F.lit(k).alias("label")) for k, v in sorted(weights.items())])
    best = F.array_sort(F.filter(scored, lambda s: s["score"] > 0), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    rows = table(spark, d, "documents").select("doc_id", best.alias("s")).filter(F.size("s") > 0)
    score, margin = C("s")[0]["score"], C("s")[0]["score"] - F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0))
    return rows.select("doc_id", C("s")[0]["label"].alias("label"), F.round(score, 4).alias("score"), F.round(margin, 4).alias("margin"), F.round(F.least(F.lit(0.95), 0.55 + 0.1 * score + 0.05 * margin), 4).alias("confidence"))


@query("d7_rule_baseline", "SELECT doc_id, CASE WHEN contains(text, 'not ') AND contains(text, 'tion') THEN 'partial' WHEN contains(text, 'tion') THEN 'support' ELSE 'not_support' END AS y_pred FROM documents")
def d7(spark, d):
    has = lambda t: F.contains(C("text"), F.lit(t))
    return table(spark, d, "documents").select("doc_id", O.bucket([("partial", has("not ") & has("tion")), ("support", has("tion"))], "not_support").alias("y_pred"))


@query("d8_candidate_cascade", f"WITH {SOURCES} SELECT doc_id, coalesce(a, b, nullif(c, 'unknown'), 'unknown') AS label, (len(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL AND x <> 'unknown'))) > 1)::INT AS conflict, CASE WHEN a IS NOT NULL THEN 'seed' WHEN b IS NOT NULL THEN 'weak' WHEN c <> 'unknown' THEN 'model' ELSE 'none' END AS provenance FROM src")
def d8(spark, d):
    known = F.nullif(C("c"), F.lit("unknown"))
    return sources(spark, d).select("doc_id", F.coalesce("a", "b", known, F.lit("unknown")).alias("label"), O.agreement([C("a"), C("b"), C("c")])["conflict"].alias("conflict"), O.bucket([("seed", C("a").isNotNull()), ("weak", C("b").isNotNull()), ("model", known.isNotNull())], "none").alias("provenance"))


@query("d9_contradictions", "SELECT event_type, count(*) FILTER (WHERE value < 0 OR value > 100) AS out_of_range, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS odd, count(*) AS n FROM events GROUP BY 1")
def d9(spark, d):
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "events").groupBy("event_type").agg(count((C("value") < 0) | (C("value") > 100)).alias("out_of_range"), count((C("event_type") == "error") & (C("value") > 50)).alias("odd"), F.count("*").alias("n"))


@query("d10_model_json", """SELECT event_id, event_type AS outcome, round(value, 6) AS score FROM events""")
def d10(spark, d):
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(C("event_type").alias("outcome"), C("value").alias("score"))), F.lit("\n``` done"))
    parsed = F.from_json(O.model_json(reply), "struct<outcome:string,score:double>")
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.outcome", F.round("p.score", 6).alias("score"))


@query("d11_clamp", "SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS score FROM events")
def d11(spark, d):
    return table(spark, d, "events").select("event_id", O.clamp(C("value") / 100).alias("score"))


@query("d13_span_validation", "SELECT doc_id, strpos(text, left(text, 30)) - 1 AS first_start, strpos(text, 'no such span at all') - 1 AS second_start, 0.5::DOUBLE AS valid_rate, 1 AS duplicates FROM documents WHERE length(text) > 40")
def d13(spark, d):
    quoted = F.array(F.left(C("text"), F.lit(30)), F.lit("no such span at all"), F.left(C("text"), F.lit(30)), F.lit(""))
    rows = table(spark, d, "documents").filter(F.length(C("text")) > 40).select("doc_id", O.span_checks(C("text"), quoted).alias("s"))
    total = lambda field: F.aggregate(F.transform("s", lambda s: s[field]), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", C("s")[0]["start"].alias("first_start"), C("s")[1]["start"].alias("second_start"), (total("valid") / 4).alias("valid_rate"), total("duplicate").alias("duplicates"))


@query("d14_acceptance_gate", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 300 AND NOT regexp_matches(d.text, 'password|AKIA')")
def d14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.filter((C("quality") == 1) & (C("toxic") == 0) & (C("n_chars") >= 300) & ~C("text").rlike("password|AKIA")).select("doc_id")


@query("d16_label_buckets", f"WITH {SOURCES} SELECT doc_id, CASE WHEN a = b AND n_chars >= 800 THEN 'strong' WHEN a = b THEN 'usable' WHEN a IS NOT NULL THEN 'weak' ELSE 'discarded' END AS bucket FROM src")
def d16(spark, d):
    rules = [("strong", (C("a") == C("b")) & (C("n_chars") >= 800)), ("usable", C("a") == C("b")), ("weak", C("a").isNotNull())]
    return sources(spark, d).select("doc_id", O.bucket(rules, "discarded").alias("bucket"))


@query("d17_relaxed_buckets", f"WITH {SOURCES} SELECT doc_id, CASE WHEN a = b AND n_chars >= 800 THEN 'strong' WHEN a = b THEN 'lora_usable' WHEN a IS NOT NULL AND n_chars > 200 THEN 'relaxed' WHEN c <> 'unknown' THEN 'weak' ELSE 'unknown_or_discarded' END AS bucket FROM src")
def d17(spark, d):
    rules = [("strong", (C("a") == C("b")) & (C("n_chars") >= 800)), ("lora_usable", C("a") == C("b")), ("relaxed", C("a").isNotNull() & (C("n_chars") > 200)), ("weak", C("c") != "unknown")]
    return sources(spark, d).select("doc_id", O.bucket(rules, "unknown_or_discarded").alias("bucket"))


@query("d18_align_replies", "SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'parse_missing_case' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def d18(spark, d):
    replies = table(spark, d, "labels").select("doc_id", "quality", F.lit("ok").alias("status"))
    return O.aligned(table(spark, d, "documents").select("doc_id"), replies, "doc_id")


@query("d19_request_table", "SELECT conv_id, turn, sha256(role || '|' || text) AS prompt_hash, length(text)::INT AS prompt_chars, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations")
def d19(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", T.content_hash(F.concat_ws("|", "role", "text")).alias("prompt_hash"), F.length("text").alias("prompt_chars"), F.floor((F.row_number().over(w) - 1) / 2).alias("batch"))


@query("d20_token_usage", """SELECT event_type, count(try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS n_usage, sum(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT))::BIGINT AS used FROM events GROUP BY 1""")
def d20(spark, d):
    number = F.nullif(F.regexp_extract("props", "([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(number).alias("n_usage"), F.sum(number).alias("used"))


@query("d21_success_gate", "SELECT event_type, round(avg((value > 20)::INT), 6) AS success, CASE WHEN avg((value > 20)::INT) >= 0.5 THEN 'pass' ELSE 'fail' END AS gate FROM events GROUP BY 1")
def d21(spark, d):
    rate = F.avg((C("value") > 20).cast("int"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(rate, 6).alias("success"), F.when(rate >= 0.5, "pass").otherwise("fail").alias("gate"))


@query("d22_string_booleans", "SELECT source, count(*) FILTER (WHERE lang IN ('en', 'de')) AS usable FROM documents GROUP BY 1")
def d22(spark, d):
    flag = F.when(C("lang") == "en", "True").when(C("lang") == "de", "1").otherwise("no")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.when(F.lower(flag).isin("true", "1", "yes"), 1)).alias("usable"))


@query("d23_agreement", f"WITH {SOURCES} SELECT doc_id, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM unnest([a, b, c]) u(x) WHERE x <> 'unknown' GROUP BY x)), 0)::INT AS agree FROM src")
def d23(spark, d):
    return sources(spark, d).select("doc_id", O.agreement([C("a"), C("b"), C("c")])["agree"].alias("agree"))


@query("d24_quality_bucket", f"WITH {SOURCES}, q AS (SELECT doc_id, round(0.3::DOUBLE * (a IS NOT NULL)::INT + 0.2::DOUBLE * coalesce((a = b)::INT, 0) + 0.2::DOUBLE * least(n_chars / 2000::DOUBLE, 1) + 0.3::DOUBLE * (c <> 'unknown')::INT, 6) AS score, toxic FROM src) SELECT doc_id, score, CASE WHEN toxic = 1 THEN 'discarded' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.5 THEN 'weak' ELSE 'rag_only' END AS bucket FROM q")
def d24(spark, d):
    score = 0.3 * C("a").isNotNull().cast("int") + 0.2 * F.coalesce((C("a") == C("b")).cast("int"), F.lit(0)) + 0.2 * F.least(C("n_chars") / 2000, F.lit(1.0)) + 0.3 * (C("c") != "unknown").cast("int")
    scored = sources(spark, d).select("doc_id", "toxic", F.round(score, 6).alias("score"))
    return scored.select("doc_id", "score", O.bucket([("discarded", C("toxic") == 1), ("strong", C("score") >= 0.8), ("weak", C("score") >= 0.5)], "rag_only").alias("bucket"))


@query("d27_merge_over_local", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS grade, (l.quality = 1 IS TRUE)::INT AS from_model FROM documents d LEFT JOIN labels l USING (doc_id)")
def d27(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", *O.merged({"grade": F.when(C("quality") == 1, "good").otherwise(" ")}, {"grade": C("lang")}))


@query("d6_diagnosis", "WITH h AS (SELECT doc_id, contains(text, 'tion')::INT * 1.5::DOUBLE + contains(text, 'ung')::INT AS owner, contains(text, 'eau')::INT * 1.5::DOUBLE + contains(text, 'ing')::INT AS contractor FROM documents) SELECT doc_id, CASE WHEN owner = contractor THEN 'shared' WHEN owner > contractor THEN 'owner' ELSE 'contractor' END AS party, round(least(0.95, 0.5 + 0.1 * abs(owner - contractor)), 4) AS confidence, abs(owner - contractor) < 1 AS uncertain FROM h")
def d6(spark, d):
    has = lambda t: F.contains(C("text"), F.lit(t)).cast("int")
    h = table(spark, d, "documents").select("doc_id", (has("tion") * 1.5 + has("ung")).alias("o"), (has("eau") * 1.5 + has("ing")).alias("c"))
    gap = F.abs(C("o") - C("c"))
    party = F.when(C("o") == C("c"), "shared").when(C("o") > C("c"), "owner").otherwise("contractor")
    return h.select("doc_id", party.alias("party"), F.round(F.least(F.lit(0.95), 0.5 + 0.1 * gap), 4).alias("confidence"), (gap < 1).alias("uncertain"))


@query("d12_reply_record", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'support' WHEN 'error' THEN 'not_support' ELSE 'unknown' END AS label, round(greatest(0, least(1, value / 50)), 6) AS confidence, left(props, 10) AS note FROM events")
def d12(spark, d):
    label = O.outcome(C("event_type"), {"purchase": "support", "error": "not_support"})
    return table(spark, d, "events").select("event_id", label.alias("label"), O.clamp(C("value") / 50).alias("confidence"), F.left("props", F.lit(10)).alias("note"))


@query("d15_complete", f"WITH {SOURCES} SELECT doc_id, (a IS NOT NULL AND b IS NOT NULL AND c <> 'unknown' AND n_chars > 300) AS complete FROM src")
def d15(spark, d):
    return sources(spark, d).select("doc_id", (C("a").isNotNull() & C("b").isNotNull() & (C("c") != "unknown") & (C("n_chars") > 300)).alias("complete"))


@query("d25_new_label_bucket", f"WITH {SOURCES} SELECT doc_id, CASE WHEN b = 'not_support' THEN 'discarded' WHEN c = a THEN 'strong' WHEN c <> 'unknown' THEN 'weak' ELSE 'rag_only' END AS bucket FROM src")
def d25(spark, d):
    return sources(spark, d).select("doc_id", O.bucket([("discarded", C("b") == "not_support"), ("strong", C("c") == C("a")), ("weak", C("c") != "unknown")], "rag_only").alias("bucket"))


@query("d26_consistency", f"WITH {SOURCES} SELECT doc_id, CASE WHEN a = 'support' AND b = 'not_support' THEN 0.0::DOUBLE WHEN a IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS consistency, (a = 'support' AND b = 'not_support') IS TRUE AS violation FROM src")
def d26(spark, d):
    bad = F.coalesce((C("a") == "support") & (C("b") == "not_support"), F.lit(False))
    return sources(spark, d).select("doc_id", F.when(bad, 0.0).when(C("a").isNull(), 0.5).otherwise(1.0).alias("consistency"), bad.alias("violation"))
