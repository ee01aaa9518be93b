"""Queries on lexicon predicates and features (2-C)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as O
from .registry import query, table
from .text import TERMS

C = F.col
CORE, TOPIC, EVIDENCE, RISK = ["tion", "ung", "ment", "ción"], ["ing ", " die ", " les ", " los "], ["ed ", "eit", "eau", "ado"], ["password", "+1 (", "@mail"]
ROLES = {"entitlement": ["tion", "ung"], "notice": ["heit", "eau", "thth"], "cause": ["because", "weil"], "impact": ["tion", "keit", "doad"]}
RULES = [("german", ["ung ", "heit"]), ("french", ["eau", "eux"]), ("spanish", ["ción", "ado "])]


def hits_sql(terms: list[str], text: str = "text") -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


def any_sql(terms: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def rule_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(t)} THEN '{n}'" for n, t in rules) + " ELSE 'other' END"


#: Sentences with places, as SQL: table s(doc_id, i, text, b, e).
SENTENCES = r"""p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
 o AS (SELECT doc_id, i, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM p),
 s AS (SELECT doc_id, i, text, b, b + length(text) AS e FROM (SELECT doc_id, i, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS text, pos + length(p) - length(regexp_replace(p, '^\s+', '')) AS b FROM o) WHERE length(text) > 0)"""


def chain_sql() -> str:
    parts = [f"SELECT doc_id, {k} AS k, '{r}' AS role, arg_min(s.text, i) AS text, arg_min(b, i) AS b FROM s WHERE {any_sql(t, 's.text')} GROUP BY doc_id" for k, (r, t) in enumerate(ROLES.items())]
    roles = ", ".join(f"({k}, '{r}')" for k, r in enumerate(ROLES))
    return f"""{SENTENCES}, f AS ({' UNION ALL '.join(parts)}), r(k, role) AS (VALUES {roles}),
 c AS (SELECT d.doc_id, r.k, r.role, coalesce(f.text, '') AS text, coalesce(f.b, -1) AS b FROM documents d CROSS JOIN r LEFT JOIN f ON f.doc_id = d.doc_id AND f.k = r.k),
 u AS (SELECT *, (text <> '' AND EXISTS (SELECT 1 FROM c e WHERE e.doc_id = c.doc_id AND e.k < c.k AND e.text = c.text))::INT AS duplicate FROM c)"""


def spans(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", T.sentences(C("text")).alias("s"))


def chained(spark, d):
    return spans(spark, d).select("doc_id", O.evidence_chain(C("s"), ROLES).alias("chain"))


@query("c1_distinct_hits", f"SELECT doc_id, {hits_sql(CORE)} AS core, {hits_sql(TOPIC)} AS topic FROM documents")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.hits(C("text"), CORE).alias("core"), T.hits(C("text"), TOPIC).alias("topic"))


@query("c2_occurrences", "SELECT doc_id, (" + " + ".join(f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)}" for t in TERMS) + ")::BIGINT AS n FROM documents")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.occurrences(C("text"), TERMS).alias("n"))


@query("c3_flags", "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {any_sql(t)} THEN '{n}' END" for n, t in RULES) + ") AS flags FROM documents")
def c3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("|", *[F.when(T.any_of(C("text"), t), n) for n, t in RULES]).alias("flags"))


@query("c4_domain", f"SELECT doc_id FROM documents WHERE {any_sql(CORE)} AND {any_sql(TOPIC)}")
def c4(spark, d):
    return table(spark, d, "documents").filter(T.any_of(C("text"), CORE) & T.any_of(C("text"), TOPIC)).select("doc_id")


@query("c5_keyword_sentences", f"WITH {SENTENCES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE {any_sql(EVIDENCE)}) SELECT doc_id, r::INT AS place, text AS sentence, b AS span_start, e AS span_end FROM k WHERE r <= 12")
def c5(spark, d):
    rows = spans(spark, d).select("doc_id", F.posexplode(O.keyword_sentences(C("s"), EVIDENCE, 12)).alias("i", "x"))
    return rows.select("doc_id", (C("i") + 1).alias("place"), C("x.text").alias("sentence"), "x.span_start", "x.span_end")


@query("c6_two_lists", f"WITH {SENTENCES} SELECT d.doc_id, least(count(*) FILTER (WHERE {any_sql(['The ', 'Die '], 's.text')}), 10)::INT AS claims, least(count(*) FILTER (WHERE {any_sql(['Of ', 'La '], 's.text')}), 10)::INT AS defences FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id")
def c6(spark, d):
    both = [F.size(O.keyword_sentences(C("s"), t, 10)).alias(n) for n, t in (("claims", ["The ", "Die "]), ("defences", ["Of ", "La "]))]
    return spans(spark, d).select("doc_id", *both)


@query("c7_context", f"WITH {SENTENCES} SELECT d.doc_id, coalesce(left(string_agg(s.text, ' ' ORDER BY i) FILTER (WHERE r <= 3), 500), '') AS summary, any_value({any_sql(CORE, 'd.text')}) AS has_core FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s) s USING (doc_id) GROUP BY d.doc_id")
def c7(spark, d):
    return spans(spark, d).select("doc_id", F.left(F.array_join(F.transform(F.slice("s", 1, 3), lambda s: s["text"]), " "), F.lit(500)).alias("summary"), T.any_of(C("text"), CORE).alias("has_core"))


@query("c8_evidence_chain", f"WITH {chain_sql()} SELECT doc_id, role, text AS sentence, b AS span_start, duplicate FROM u")
def c8(spark, d):
    return chained(spark, d).select("doc_id", F.explode("chain").alias("u")).select("doc_id", "u.role", C("u.text").alias("sentence"), "u.span_start", "u.duplicate")


@query("c9_chain_metrics", f"WITH {chain_sql()} SELECT doc_id, round(avg((b >= 0 AND trim(text) <> '')::INT), 6) AS valid, round(avg(duplicate), 6) AS duplicate, round(1 - avg((trim(text) <> '')::INT), 6) AS missing FROM u GROUP BY doc_id")
def c9(spark, d):
    m = chained(spark, d).select("doc_id", O.chain_metrics(C("chain")).alias("m"))
    return m.select("doc_id", *[F.round(f"m.{k}", 6).alias(k) for k in ("valid", "duplicate", "missing")])


@query("c10_leakage", f"SELECT doc_id, regexp_matches(text, 'AKIA|[0-9]{{4,}}') AS leaks, array_to_string(list_filter(['{RISK[0]}', '{RISK[1]}', '{RISK[2]}'], lambda t: contains(text, t)), '|') AS terms FROM documents")
def c10(spark, d):
    return table(spark, d, "documents").select("doc_id", C("text").rlike("AKIA|[0-9]{4,}").alias("leaks"), F.array_join(T.found_terms(C("text"), RISK), "|").alias("terms"))


@query("c12_sufficiency", f"SELECT doc_id, round(greatest(0, least(1, 0.45::DOUBLE * {hits_sql(CORE)} / 4 + 0.15::DOUBLE * least({hits_sql(TOPIC)} / 5::DOUBLE, 1) + 0.2::DOUBLE * least({hits_sql(EVIDENCE)} / 5::DOUBLE, 1) + 0.2::DOUBLE * least({hits_sql(TERMS)} / 6::DOUBLE, 1))), 4) AS score FROM documents")
def c12(spark, d):
    score = O.sufficiency(T.hits(C("text"), CORE) / 4, T.hits(C("text"), TOPIC), T.hits(C("text"), EVIDENCE), T.hits(C("text"), TERMS))
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query("c13_numeric_features", f"WITH {SENTENCES} SELECT d.doc_id, length(d.text) AS chars, count(s.i) AS n_sentences, any_value({hits_sql(CORE, 'd.text')}) AS core, any_value({hits_sql(EVIDENCE, 'd.text')}) AS evidence, (any_value(lang) = 'en')::INT AS is_en FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.text")
def c13(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.length(C("text")).cast("bigint").alias("chars"), F.size(T.sentences(C("text"))).cast("bigint").alias("n_sentences"), T.hits(C("text"), CORE).alias("core"), T.hits(C("text"), EVIDENCE).alias("evidence"), (C("lang") == "en").cast("int").alias("is_en"))


@query("c15_local_quality", f"SELECT doc_id, round(greatest(0, least(1, least({hits_sql(CORE, 'left(text, 10000)')}, 3) * 0.12::DOUBLE + least({hits_sql(TOPIC, 'left(text, 3000)')}, 4) * 0.1::DOUBLE + CASE WHEN starts_with(text, 'T') THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN {any_sql(RISK)} THEN 0.3::DOUBLE ELSE 0 END)), 4) AS score FROM documents")
def c15(spark, d):
    score = O.local_quality(C("text"), [(CORE, 10_000, 3, 0.12), (TOPIC, 3000, 4, 0.1)], F.startswith(C("text"), F.lit("T")), T.any_of(C("text"), RISK))
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query("c16_relevance", f"SELECT doc_id, round(least(1, 0.15::DOUBLE * least({hits_sql(CORE)}, 4) + 0.18::DOUBLE * least({hits_sql(TOPIC)}, 4) + CASE WHEN {hits_sql(CORE)} > 0 AND {hits_sql(TOPIC)} > 0 THEN 0.2::DOUBLE ELSE 0 END), 6) AS score FROM documents")
def c16(spark, d):
    return table(spark, d, "documents").select("doc_id", O.relevance(T.hits(C("text"), CORE), T.hits(C("text"), TOPIC)).alias("score"))


@query("c17_substantive", f"SELECT doc_id, {any_sql(CORE)} AND length(text) > 500 AS substantive, {any_sql(RISK)} AND {hits_sql(CORE)} = 0 AS procedural_only FROM documents")
def c17(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.any_of(C("text"), CORE) & (F.length(C("text")) > 500)).alias("substantive"), (T.any_of(C("text"), RISK) & (T.hits(C("text"), CORE) == 0)).alias("procedural_only"))


@query("c19_info_score", f"SELECT doc_id, least({' + '.join(f'(length(text) - length(replace(text, {chr(39)}{t}{chr(39)}, {chr(39)}{chr(39)}))) // {len(t)}' for t in TERMS)}, 50)::BIGINT AS info, {rule_sql(RULES)} AS hint FROM documents")
def c19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.least(T.occurrences(C("text"), TERMS), F.lit(50)).cast("bigint").alias("info"), O.first_rule(C("text"), RULES, "other").alias("hint"))


@query("c20_indices", f"SELECT doc_id, round(least({hits_sql(CORE)} / 3::DOUBLE, 1), 6) AS core_index, round(least({hits_sql(TOPIC)} / 2::DOUBLE, 1), 6) AS topic_index, CASE WHEN {hits_sql(CORE)} >= 3 THEN 'act' WHEN {hits_sql(TOPIC)} >= 1 THEN 'watch' ELSE 'none' END AS action FROM documents")
def c20(spark, d):
    index = lambda terms, n: F.round(F.least(T.hits(C("text"), terms) / n, F.lit(1.0)), 6)
    action = F.when(T.hits(C("text"), CORE) >= 3, "act").when(T.hits(C("text"), TOPIC) >= 1, "watch").otherwise("none")
    return table(spark, d, "documents").select("doc_id", index(CORE, 3).alias("core_index"), index(TOPIC, 2).alias("topic_index"), action.alias("action"))


@query("c21_first_rule", f"SELECT doc_id, {rule_sql(RULES)} AS label FROM documents")
def c21(spark, d):
    return table(spark, d, "documents").select("doc_id", O.first_rule(C("text"), RULES, "other").alias("label"))


@query("c22_most_hits", f"WITH h AS (SELECT doc_id, {', '.join(f'{hits_sql(t)} AS {n}' for n, t in RULES)} FROM documents) SELECT doc_id, CASE WHEN greatest(german, french, spanish) = 0 THEN 'other' WHEN german >= french AND german >= spanish THEN 'german' WHEN french >= spanish THEN 'french' ELSE 'spanish' END AS label, greatest(german, french, spanish) AS hits FROM h")
def c22(spark, d):
    return table(spark, d, "documents").select("doc_id", O.most_hits(C("text"), RULES, "other").alias("m")).select("doc_id", "m.label", "m.hits")


@query("c23_role_summary", f"WITH {SENTENCES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE {any_sql(ROLES['notice'])}) SELECT d.doc_id, coalesce(string_agg(k.text, ' ' ORDER BY i) FILTER (WHERE r <= 3), 'none') AS notice FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id")
def c23(spark, d):
    return spans(spark, d).select("doc_id", O.role_summary(C("s"), ROLES["notice"], "none").alias("notice"))


@query("c24_chain_from_json", f"WITH {chain_sql()} SELECT doc_id, string_agg(role, '|' ORDER BY k) FILTER (WHERE text <> '') AS roles FROM u GROUP BY doc_id")
def c24(spark, d):
    stored = chained(spark, d).select("doc_id", F.to_json("chain").alias("json"))
    units = F.filter(F.from_json("json", f"array<{O.UNIT}>"), lambda u: u["text"] != "")
    return stored.select("doc_id", F.nullif(F.array_join(F.transform(units, lambda u: u["role"]), "|"), F.lit("")).alias("roles"))


@query("c25_text_mode", "SELECT doc_id, length(left(text, 200) || chr(10) || right(text, 100))::INT AS both_chars FROM documents WHERE trim(text) <> ''")
def c25(spark, d):
    mode = O.by_mode("pre+post", F.left(C("text"), F.lit(200)), F.right(C("text"), F.lit(100)))
    return table(spark, d, "documents").filter(F.trim(C("text")) != "").select("doc_id", F.length(mode).alias("both_chars"))


@query("c26_numbers", "SELECT event_id, coalesce(try_cast(CASE WHEN event_type = 'click' THEN value::VARCHAR ELSE event_type END AS DOUBLE), 0) AS n FROM events")
def c26(spark, d):
    return table(spark, d, "events").select("event_id", O.numbers(F.when(C("event_type") == "click", C("value").cast("string")).otherwise(C("event_type"))).alias("n"))


@query("c27_record_checks", "SELECT d.doc_id, l.quality IN (0, 1) IS TRUE AS valid_label, length(d.text) > 20000 AS over_long, count(*) OVER (PARTITION BY md5(d.text)) > 1 AS duplicate FROM documents d LEFT JOIN labels l USING (doc_id)")
def c27(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(C("text").cast("binary")).alias("h"), F.length(C("text")).alias("chars")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    copies = rows.groupBy("h").agg(F.count("*").alias("copies"))
    return rows.join(copies, "h").select("doc_id", F.coalesce(C("quality").isin(0, 1), F.lit(False)).alias("valid_label"), (C("chars") > 20_000).alias("over_long"), (C("copies") > 1).alias("duplicate"))


@query("c28_package_counters", "SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing_label, count(*) FILTER (WHERE length(d.text) > 4000) AS over_long, count(*) FILTER (WHERE regexp_matches(d.text, '[一-鿿]')) AS residue FROM documents d LEFT JOIN labels l USING (doc_id)")
def c28(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    count = lambda cond: F.count(F.when(cond, 1))
    return rows.agg(F.count("*").alias("n"), count(C("quality").isNull()).alias("missing_label"), count(F.length(C("text")) > 4000).alias("over_long"), count(C("text").rlike("[一-鿿]")).alias("residue"))


@query("c14_signature", f"SELECT doc_id, array_to_string(list_filter([{', '.join(repr(t) for t in CORE + EVIDENCE)}], lambda t: contains(text, t)), '|') AS signature FROM documents")
def c14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(T.found_terms(C("text"), CORE + EVIDENCE)), "|").alias("signature"))


@query("c18_extractability", f"SELECT doc_id, CASE WHEN {any_sql(RISK)} THEN 'blocked' WHEN {hits_sql(CORE)} >= 3 THEN 'clear' WHEN {hits_sql(CORE)} >= 1 THEN 'partial' ELSE 'none' END AS extractable FROM documents")
def c18(spark, d):
    kind = F.when(T.any_of(C("text"), RISK), "blocked").when(T.hits(C("text"), CORE) >= 3, "clear").when(T.hits(C("text"), CORE) >= 1, "partial").otherwise("none")
    return table(spark, d, "documents").select("doc_id", kind.alias("extractable"))


@query("c11_structured_case", f"WITH {SENTENCES} SELECT d.doc_id, any_value(left(d.text, (length(d.text) // 2)::BIGINT)) AS pre, count(s.i) FILTER (WHERE {any_sql(EVIDENCE, 's.text')})::INT AS evidence, any_value(CASE WHEN d.text <> '' THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END) AS confidence FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id")
def c11(spark, d):
    x = C("text")
    half = F.substr(x, F.lit(1), F.floor(F.length(x) / 2).cast("int"))
    evidence = F.size(F.filter("s", lambda s: T.any_of(s["text"], EVIDENCE)))
    return spans(spark, d).select("doc_id", half.alias("pre"), evidence.alias("evidence"), F.when(x != "", 0.55).otherwise(0.0).alias("confidence"))
