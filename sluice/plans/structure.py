"""Queries of case records in whole: summaries, structured cases with their ten numbers, grades of labels (2-B, 2-C)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, labels, summaries
from .cases import CASES, cases
from .features import CORE, EVIDENCE, RISK, ROLES, TOPIC, any_sql, chain_sql, hits_sql
from .registry import query, table
from .text import CLAIM, DELAY
from .text import EVIDENCE as PROOF

C = F.col
ISSUE = ["que ", "ieth"]
PARTS = [("Claims and defenses", CLAIM, 360, 0), ("Delay and responsibility facts", DELAY, 420, 3), ("Evidence and procedure", PROOF, 420, 6), ("Dispute focus", ISSUE, 300, 9)]
WEIGHTS = [(DELAY, 4), (PROOF, 3), (CLAIM, 3), (ISSUE, 2)]
LEAK = "AKIA|[0-9]{4,}"
LISTS = {"claims": ["The ", "Die "], "defences": ["Of ", "La "], "delay_events": TOPIC, "procedure_cues": ROLES["notice"], "evidence_mentions": EVIDENCE}


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def split_sql(x: str) -> str:
    parts = rf"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '([.;])', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '')"
    return f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) > 260 THEN list_transform(range(0, length(p), 240), lambda k: substr(p, k + 1, 240)) ELSE [p] END))"


def part_sql(k: int, limit: int, start: int) -> str:
    return f"""q{k} AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY h{k} * 10 + own DESC, i DESC) AS r FROM (SELECT *, max(h{k}) OVER (PARTITION BY doc_id) AS most FROM w) WHERE h{k} > 0 OR (most = 0 AND i BETWEEN {start} AND {start + 7})),
 p{k} AS (SELECT doc_id, trim(left(string_agg(x, ' ' ORDER BY i), {limit})) AS t{k} FROM q{k} WHERE r <= 6 GROUP BY 1)"""


OWN = " + ".join(f"{w} * {hits_sql(terms, 'x')}" for terms, w in WEIGHTS)
PLACES = range(len(PARTS))
LINES = ", ".join(f"CASE WHEN t{k} <> '' THEN '{PARTS[k][0]}: ' || t{k} END" for k in PLACES)


@query("b27_case_summary", rf"""WITH b AS (SELECT doc_id, {strip_sql("text")} AS body, CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS title FROM documents), l AS (SELECT doc_id, {split_sql("body")} AS s FROM b),
 e AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM l), w AS (SELECT *, {OWN} + CASE WHEN i < 6 THEN 2 ELSE 0 END + CASE WHEN length(x) BETWEEN 35 AND 220 THEN 1 ELSE 0 END AS own, {", ".join(f"{hits_sql(PARTS[k][1], 'x')} AS h{k}" for k in PLACES)} FROM e),
 {", ".join(part_sql(k, *PARTS[k][2:]) for k in PLACES)}, pc AS (SELECT doc_id, trim(left(string_agg(x, ' ' ORDER BY i), 360)) AS t FROM e WHERE i < 3 GROUP BY 1),
 h AS (SELECT *, concat_ws(chr(10), 'Case ID: ' || doc_id, CASE WHEN title <> '' THEN 'Title: ' || left(title, 120) END, 'Pre-decision factual summary:', CASE WHEN t <> '' THEN 'Project context: ' || t END, {LINES}) AS head FROM b LEFT JOIN pc USING (doc_id) {" ".join(f"LEFT JOIN p{k} USING (doc_id)" for k in PLACES)}),
 u AS (SELECT doc_id, head, length(head) AS base, flatten([{", ".join([split_sql("coalesce(t, '')"), *[split_sql(f"coalesce(t{k}, '')") for k in PLACES]])}]) AS used, length(body) AS n FROM h),
 x AS (SELECT w.doc_id, base, x, row_number() OVER (PARTITION BY w.doc_id ORDER BY own DESC, x DESC) AS r FROM w JOIN u ON u.doc_id = w.doc_id WHERE NOT list_contains(used, x) AND base < 1200 AND n > base),
 y AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + greatest(r - 2, 0) AS before FROM x),
 z AS (SELECT *, bool_and(base + before + length(x) + 32 <= 1600 AND (r = 1 OR base + before < 1200)) OVER (PARTITION BY doc_id ORDER BY r) AS ok FROM y), a AS (SELECT doc_id, string_agg(x, ' ' ORDER BY r DESC) AS more FROM z WHERE ok GROUP BY 1),
 f AS (SELECT doc_id, head || coalesce(chr(10) || 'Additional relevant facts: ' || more, '') AS t FROM u LEFT JOIN a USING (doc_id)), g AS (SELECT *, left(t, 1600) AS cut, length(regexp_extract(reverse(left(t, 1600)), '^([^.\n]*)', 1)) AS after FROM f)
 SELECT doc_id, CASE WHEN length(t) <= 1600 THEN t WHEN 1600 - after - 1 > 1152 THEN {strip_sql("left(cut, 1600 - after)")} ELSE regexp_replace(cut, '\s+$', '') || '...' END AS summary FROM g""")  # fmt: skip
def b27(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    title = F.when(C("n_chars") % 2 == 0, C("lang")).otherwise("")
    return summaries.case_summaries(rows, C("text"), C("doc_id").cast("string"), title, PARTS, WEIGHTS, ends=".;").select("doc_id", "summary")


#: Documents as cases: parts of some texts stand for the sections, and the rest has none.
SPLIT = f"""x_ AS (SELECT doc_id, {strip_sql("text")} AS raw, CASE WHEN n_chars % 3 = 0 THEN {strip_sql("left(text, 700)")} ELSE '' END AS facts, CASE WHEN n_chars % 5 = 0 THEN {strip_sql("substr(text, 101, 400)")} ELSE '' END AS issues, CASE WHEN n_chars % 2 = 0 THEN {strip_sql("right(text, 300)")} ELSE '' END AS reasoning FROM documents),
 pre_ AS (SELECT doc_id, raw, coalesce(nullif(concat_ws(chr(10), nullif(facts, ''), nullif(issues, '')), ''), left(raw, (length(raw) // 2)::BIGINT)) AS text, CASE WHEN reasoning <> '' THEN reasoning ELSE substr(raw, (length(raw) // 2 + 1)::BIGINT) END AS post,
  CASE WHEN facts <> '' OR issues <> '' THEN 0.9::DOUBLE WHEN raw <> '' THEN 0.55::DOUBLE ELSE 0::DOUBLE END AS split_confidence, (reasoning <> '')::INT AS anchor_found FROM x_)"""
CASE_SQL = f"""{SPLIT}, {chain_sql().replace("FROM documents", "FROM pre_")}, k_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, sum({any_sql(LISTS["delay_events"])}::INT) OVER (PARTITION BY doc_id ORDER BY i) AS m FROM s),
 n_ AS (SELECT doc_id, {", ".join(f"least(count(*) FILTER (WHERE {any_sql(LISTS[name])}), {most})::INT AS {name}" for name, most in summaries.LISTS.items())}, left(string_agg(text, ' ' ORDER BY i) FILTER (WHERE n <= 3), 500) AS summary,
  string_agg(b || ':' || e, '|' ORDER BY i) FILTER (WHERE {any_sql(LISTS["delay_events"])} AND m <= 12) AS places FROM k_ GROUP BY 1),
 g_ AS (SELECT doc_id, string_agg(role || '=' || b || CASE WHEN duplicate = 1 THEN '*' ELSE '' END, '|' ORDER BY k) AS chain, avg((trim(text) <> '')::INT) AS coverage FROM u GROUP BY 1),
 z_ AS (SELECT pre_.*, {", ".join(f"coalesce({name}, 0) AS {name}" for name in LISTS)}, coalesce(summary, '') AS summary, coalesce(places, '') AS places, chain, coverage, regexp_matches(text, '{LEAK}')::INT AS leakage FROM pre_ JOIN g_ USING (doc_id) LEFT JOIN n_ USING (doc_id))"""


def structured(spark, d):
    some = lambda n, value: F.when(C("n_chars") % n == 0, value)
    rows = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return summaries.structured_cases(rows, some(3, F.left("text", F.lit(700))), some(5, F.substring("text", 101, 400)), some(2, F.right("text", F.lit(300))), F.lit(None), C("text"), LISTS, {"core": CORE, "topic": TOPIC}, ROLES, LEAK)


@query("c11_structured_case_full", f"""WITH {CASE_SQL} SELECT doc_id, length(text)::INT AS pre_chars, length(post)::INT AS post_chars, summary, {any_sql(CORE)} AS has_core, {any_sql(TOPIC)} AS has_topic, claims, defences, procedure_cues, evidence_mentions, places, chain, split_confidence, anchor_found, leakage,
 CASE WHEN try_cast(nullif(regexp_extract(post, '(20[0-9][0-9])', 1), '') AS INT) BETWEEN 1990 AND 2035 THEN regexp_extract(post, '(20[0-9][0-9])', 1)::INT END AS case_year FROM z_""")
def c11(spark, d):
    joined = lambda items, one: F.array_join(F.transform(items, one), "|")
    unit = lambda u: F.concat(u["role"], F.lit("="), u["span_start"].cast("string"), F.when(u["duplicate"] == 1, "*").otherwise(""))
    return structured(spark, d).select(
        "doc_id", F.length("pre_decision_text").alias("pre_chars"), F.length("post_decision_text").alias("post_chars"), "summary", "has_core", "has_topic",
        *[F.size(name).alias(name) for name in LISTS if name != "delay_events"], joined("delay_events", lambda s: F.concat_ws(":", s["span_start"].cast("string"), s["span_end"].cast("string"))).alias("places"),
        joined("chain", unit).alias("chain"), "split_confidence", "anchor_found", "leakage", "case_year",
    )


@query("c13_ten_features", f"""WITH {CASE_SQL} SELECT doc_id, delay_events::DOUBLE AS delay_event_count, procedure_cues::DOUBLE AS procedure_cue_count, evidence_mentions::DOUBLE AS evidence_mention_count, claims::DOUBLE AS claim_count, defences::DOUBLE AS defense_count, length(text)::DOUBLE AS pre_text_length,
 round(coverage, 6) AS role_coverage_rate, round(1 - coverage, 6) AS missing_role_rate, round(greatest(0, least(1, 0.45::DOUBLE * coverage + 0.15::DOUBLE * least(procedure_cues / 5::DOUBLE, 1) + 0.2::DOUBLE * least(evidence_mentions / 5::DOUBLE, 1) + 0.2::DOUBLE * least(claims / 6::DOUBLE, 1))), 4) AS evidence_sufficiency, leakage::DOUBLE AS potential_leakage_flag FROM z_""")
def c13(spark, d):
    numbers = features.numeric_features(C("delay_events"), C("procedure_cues"), C("evidence_mentions"), C("claims"), C("defences"), C("pre_decision_text"), C("chain"), C("leakage"))
    return structured(spark, d).select("doc_id", *numbers)


@query("c18_label_grades", f"""WITH {CASES}, r AS (SELECT *, CASE n_chars % 4 WHEN 0 THEN 'Support given' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'refused' END AS reply FROM c)
 SELECT doc_id, CASE WHEN label <> 'unknown' THEN round(least(1, 0.45::DOUBLE + CASE WHEN lang = 'en' THEN 0.3 ELSE 0 END + CASE WHEN {any_sql(RISK)} THEN 0.25 ELSE 0 END), 4) ELSE 0::DOUBLE END AS extractability,
 (label <> 'unknown' AND review = 0 AND (conf >= 0.85 OR coalesce((label = 'support' AND contains(reply, 'Support')) OR (label = 'partial' AND reply = 'PARTIAL'), FALSE)))::INT AS consistency FROM r""")
def c18(spark, d):
    reply = F.when(C("n_chars") % 4 == 0, "Support given").when(C("n_chars") % 4 == 1, "PARTIAL").when(C("n_chars") % 4 == 2, "refused")
    score = labels.extractability_score(C("label"), C("text"), F.when(C("lang") == "en", "a decision"), RISK)
    return cases(spark, d).select("doc_id", score.alias("extractability"), labels.label_consistency(C("label"), C("conf"), C("review"), reply).alias("consistency"))
