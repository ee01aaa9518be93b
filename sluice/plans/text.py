"""Queries on cleaning, keys, splitting and shortening of text (2-B)."""

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

DOCS, PAGES, TALK = "documents", "pages", "conversations"
#: Words that play anchors, markers and terms in the four languages of the tables.
ANCHORS = ["Erst", "Enti", "Eau", "Ciónos"]
TERMS = ["tion", "und", "que", "para"]


@query("b1_whitespace", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line,
 regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS tidy,
 length(regexp_replace(text, '\s+', '', 'g'))::INT AS solid_chars FROM documents""")
def b1(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.one_line(F.col("text")).alias("one_line"), T.tidy_lines(F.col("text")).alias("tidy"), F.length(T.without_space(F.col("text"))).alias("solid_chars"))


@query("b2_markup", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', chr(10), 'g'), '&(nbsp|quot|amp);', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS plain FROM pages""")
def b2(spark, d):
    return table(spark, d, PAGES).select("page_id", T.without_markup(F.col("html")).alias("plain"))


@query("b3_content_hash", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def b3(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.content_hash(F.col("text")).alias("text_sha256"))


@query("b4_page_id", "SELECT page_id, page_id::VARCHAR AS plain FROM pages")
def b4(spark, d):
    return table(spark, d, PAGES).select("page_id", T.plain_id(F.concat(F.col("page_id").cast("string"), F.lit(".0"))).alias("plain"))


@query("b5_file_name", r"SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 40) AS file_name FROM pages")
def b5(spark, d):
    return table(spark, d, PAGES).select("page_id", T.file_name(F.col("url")).alias("file_name"))


@query("b6_case_id", "SELECT doc_id, 'case_' || doc_id || '_' || left(sha256(text), 12) AS case_id FROM documents")
def b6(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.case_id("case", F.col("doc_id").cast("string"), T.content_hash(F.col("text"))).alias("case_id"))


@query("b7_title_year", r"""SELECT event_id, try_cast(nullif(regexp_extract('case (' || year(ts)::VARCHAR || ') ' || event_type, '\((\d{4})\)', 1), '') AS INT) AS title_year FROM events""")
def b7(spark, d):
    title = F.concat(F.lit("case ("), F.year("ts").cast("string"), F.lit(") "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.year_between(title, r"\((\d{4})\)", 1000, 9999).alias("title_year"))


@query("b8_case_year", r"""SELECT order_, CASE WHEN y BETWEEN 1990 AND 2035 THEN y END AS case_year FROM
 (SELECT o_orderkey AS order_, try_cast(nullif(regexp_extract(o_orderpriority || ' ' || year(o_orderdate)::VARCHAR, '(20\d{2})', 1), '') AS INT) AS y FROM orders)""")
def b8(spark, d):
    text = F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_"), T.case_year(text).alias("case_year"))


@query("b9_first_year", r"""SELECT page_id, list_filter(list_transform(regexp_extract_all(left(url || ' ' || html, 2500), '(\d{4})', 1), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2026)[1] AS first_year FROM pages""")
def b9(spark, d):
    return table(spark, d, PAGES).select("page_id", T.first_year(F.concat_ws(" ", "url", "html")).alias("first_year"))


@query("b10_char_class", "SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g'))::INT AS accented, length(regexp_replace(text, '[^一-鿿]', '', 'g')) > 0 AS residue FROM documents")
def b10(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.count_matching(F.col("text"), "À-ÿ").alias("accented"), (T.count_matching(F.col("text"), "一-鿿") > 0).alias("residue"))


@query("b11_sentences", r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
 o AS (SELECT doc_id, i, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
 s AS (SELECT doc_id, i, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS body, pos + length(p) - length(regexp_replace(p, '^\s+', '')) AS b FROM o)
 SELECT doc_id, count(*)::INT AS n, sum(b)::BIGINT AS starts, sum(b + length(body))::BIGINT AS ends, max(length(body))::INT AS longest FROM s WHERE length(body) > 0 GROUP BY doc_id""")
def b11(spark, d):
    s = table(spark, d, DOCS).select("doc_id", T.sentences(F.col("text")).alias("s"))
    total = lambda field: F.aggregate(F.transform("s", lambda x: x[field].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.filter(F.size("s") > 0).select("doc_id", F.size("s").alias("n"), total("span_start").alias("starts"), total("span_end").alias("ends"), F.array_max(F.transform("s", lambda x: F.length(x["text"]))).alias("longest"))


@query("b12_short_sentences", r"""SELECT doc_id, len(s)::INT AS n, s[1] AS first_, list_sum(list_transform(s, lambda x: CASE WHEN length(x) > 260 THEN ceil(length(x) / 240.0) ELSE 1 END))::BIGINT AS n_chunks
 FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: trim(x)), lambda x: length(x) >= 6) AS s FROM documents) WHERE len(s) > 0""")
def b12(spark, d):
    s = table(spark, d, DOCS).select("doc_id", T.short_sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first_"), F.size(F.flatten(F.transform("s", lambda x: T.chunks(x)))).cast("bigint").alias("n_chunks"))


@query("b13_sections", """WITH h AS (SELECT page_id, html, strpos(html, '<title>') - 1 AS t, strpos(html, '<nav>') - 1 AS n, strpos(html, '<p>') - 1 AS p FROM pages),
 c AS (SELECT *, (t >= 0)::INT + (n >= 0)::INT + (p >= 0)::INT AS k FROM h)
 SELECT page_id, k AS found, CASE WHEN k >= 2 AND t >= 0 THEN substr(html, t + 1, coalesce((SELECT min(x) FROM unnest([n, p]) u(x) WHERE x > t), length(html)) - t) END AS title,
 CASE WHEN k >= 2 AND p >= 0 THEN length(substr(html, p + 1, coalesce((SELECT min(x) FROM unnest([t, n]) u(x) WHERE x > p), length(html)) - p)) END::INT AS body_chars FROM c""")
def b13(spark, d):
    heads = {"title": "<title>", "nav": "<nav>", "body": "<p>"}
    found = F.array(*[(F.instr(F.col("html"), h) > 0).cast("int") for h in heads.values()])
    rows = table(spark, d, PAGES).select("page_id", "html", F.aggregate(found, F.lit(0), lambda a, x: a + x).alias("found"), T.sections(F.col("html"), heads).alias("s"))
    return rows.select("page_id", "found", T.section_text(F.col("html"), F.col("s"), "title").alias("title"), F.length(T.section_text(F.col("html"), F.col("s"), "body")).alias("body_chars"))


@query("b14_split_at_anchor", f"""WITH a AS (SELECT doc_id, text, (SELECT min(x) FROM unnest([{', '.join(f"strpos(text, '{a}')" for a in ANCHORS)}]) u(x) WHERE x > 0) - 1 AS pos FROM documents),
 c AS (SELECT *, coalesce(pos, floor(length(text) * 0.72::DOUBLE)::INT) AS cut FROM a)
 SELECT doc_id, md5(substr(text, 1, cut)) AS pre, length(text) - least(cut, length(text)) AS post_chars, CASE WHEN pos IS NULL THEN 0.45::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM c""")
def b14(spark, d):
    s = table(spark, d, DOCS).select("doc_id", T.split_at_anchor(F.col("text"), ANCHORS).alias("s"))
    return s.select("doc_id", F.md5(F.col("s.pre").cast("binary")).alias("pre"), F.length("s.post").cast("bigint").alias("post_chars"), "s.confidence")


@query("b15_pre_post_from_sections", r"""WITH s AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS f, regexp_extract(html, '<h1>([^<]*)', 1) AS i, html FROM pages),
 p AS (SELECT page_id, html, concat_ws(chr(10), nullif(trim(f), ''), nullif(trim(i), '')) AS pre FROM s)
 SELECT page_id, CASE WHEN pre = '' THEN left(html, (length(html) // 2)::BIGINT) ELSE pre END AS pre, CASE WHEN pre <> '' THEN 0.9::DOUBLE WHEN html <> '' THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM p""")
def b15(spark, d):
    part = lambda tag: T.blank_null(F.regexp_extract(F.col("html"), f"<{tag}>([^<]*)", 1))
    rows = table(spark, d, PAGES).withColumn("p", F.concat_ws("\n", part("title"), part("h1")))
    half = F.substr(F.col("html"), F.lit(1), F.floor(F.length(F.col("html")) / 2).cast("int"))
    return rows.select("page_id", F.when(F.col("p") == "", half).otherwise(F.col("p")).alias("pre"), F.when(F.col("p") != "", 0.9).when(F.col("html") != "", 0.55).otherwise(0.0).alias("confidence"))


def compact_sql(source: str, budget: int, head: float, tail: float) -> str:
    h, limit = int(budget * head), int(budget * tail)
    return rf"""p AS (SELECT doc_id, unnest(string_split(regexp_replace(substr(text, {h + 1}), '([.!?\n])', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(substr(text, {h + 1}), '([.!?\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM {source} WHERE length(text) > {budget}),
 k AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE {' OR '.join(f"contains(p, '{t}')" for t in TERMS)}),
 j AS (SELECT doc_id, string_agg(p, '' ORDER BY i) AS kept FROM k WHERE before < {limit} GROUP BY doc_id),
 out AS (SELECT s.doc_id, CASE WHEN length(text) <= {budget} THEN text ELSE left(left(text, {h}) || chr(10) || coalesce(kept, ''), {budget}) END AS short FROM {source} s LEFT JOIN j USING (doc_id))"""


@query("b17_compaction", f"WITH {compact_sql('documents', 1200, 0.45, 0.5)} SELECT doc_id, md5(short) AS short, length(short)::INT AS chars FROM out")
def b17(spark, d):
    short = table(spark, d, DOCS).select("doc_id", T.compact(F.col("text"), 1200, 0.45, 0.5, TERMS).alias("s"))
    return short.select("doc_id", F.md5(F.col("s").cast("binary")).alias("short"), F.length("s").alias("chars"))


@query("b16_pre_text_budget", f"""WITH a AS (SELECT doc_id, text, (SELECT min(x) FROM unnest([{', '.join(f"strpos(text, '{a}')" for a in ANCHORS)}]) u(x) WHERE x > 600) - 1 AS pos FROM documents),
 cut AS (SELECT doc_id, CASE WHEN pos IS NULL THEN text ELSE left(text, pos) END AS text FROM a), {compact_sql('cut', 900, 0.45, 0.5)} SELECT doc_id, md5(short) AS short, length(short)::INT AS chars FROM out""")
def b16(spark, d):
    late = F.array_min(F.filter(F.array(*[F.instr(F.col("text"), a) for a in ANCHORS]), lambda p: p > 600)) - 1
    cut = table(spark, d, DOCS).select("doc_id", F.when(late.isNull(), F.col("text")).otherwise(F.substr(F.col("text"), F.lit(1), late)).alias("text"))
    short = cut.select("doc_id", T.compact(F.col("text"), 900, 0.45, 0.5, TERMS).alias("s"))
    return short.select("doc_id", F.md5(F.col("s").cast("binary")).alias("short"), F.length("s").alias("chars"))


@query("b18_marker_windows", f"""WITH a AS (SELECT doc_id, text, (SELECT min(x) FROM unnest([{', '.join(f"strpos(text, '{a}')" for a in ANCHORS)}]) u(x) WHERE x > 0) - 1 AS pos FROM documents),
 w AS (SELECT doc_id, text, CASE WHEN pos IS NULL THEN '' ELSE substr(text, greatest(pos - 50, 0) + 1, pos + 150 - greatest(pos - 50, 0)) END AS near FROM a)
 SELECT doc_id, md5(CASE WHEN length(text) <= 700 THEN text ELSE array_to_string(list_filter([left(text, 400), near, right(text, 300)], lambda x: x <> ''), chr(10) || '...' || chr(10)) END) AS short FROM w""")
def b18(spark, d):
    return table(spark, d, DOCS).select("doc_id", F.md5(T.marker_windows(F.col("text"), 400, 300, ANCHORS, 50, 150).cast("binary")).alias("short"))


@query("b19_tail_and_amounts", r"""SELECT doc_id, right(text, 200) AS tail, len(m)::INT AS n, array_to_string(m[1:18], '|') AS amounts FROM
 (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[.!?\n]'), lambda x: regexp_matches(x, '[0-9]{2,}') AND NOT contains(x, 'card')) AS m FROM documents)""")
def b19(spark, d):
    money = F.filter(F.split(F.col("text"), r"[.!?\n]"), lambda x: x.rlike("[0-9]{2,}") & ~F.contains(x, F.lit("card")))
    rows = table(spark, d, DOCS).select("doc_id", F.right(F.col("text"), F.lit(200)).alias("tail"), money.alias("m"))
    return rows.select("doc_id", "tail", F.size("m").alias("n"), F.array_join(F.slice("m", 1, 18), "|").alias("amounts"))


@query("b20_snippet", f"""WITH a AS (SELECT doc_id, text, coalesce({', '.join(f"nullif(strpos(text, '{t}'), 0)" for t in ["Erst", "que", "und", "the"])}) - 1 AS pos FROM documents)
 SELECT doc_id, CASE WHEN pos IS NULL THEN left(text, 80) ELSE substr(text, greatest(pos - 30, 0) + 1, pos + 60 - greatest(pos - 30, 0)) END AS snippet FROM a""")
def b20(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.snippet(F.col("text"), ["Erst", "que", "und", "the"], 30, 60, 80).alias("snippet"))


@query("b21_whole_sentences", r"""WITH c AS (SELECT doc_id, text, left(text, 500) AS cut, regexp_extract(reverse(left(text, 500)), '^([^.!?]*)[.!?]', 1) AS after, regexp_matches(left(text, 500), '[.!?]') AS has FROM documents)
 SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN has AND 500 - length(after) > 360 THEN left(cut, 500 - length(after)) ELSE cut END AS short FROM c""")
def b21(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.whole_sentences(F.col("text"), 500).alias("short"))


@query("b22_numbers", r"""SELECT doc_id, array_to_string(list_distinct_ordered[1:5], '|') AS numbers FROM (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_ordered FROM documents)""")
def b22(spark, d):
    return table(spark, d, DOCS).select("doc_id", F.array_join(T.distinct_matches(F.col("text"), r"[0-9]+(?:[.,][0-9]+)*", 5), "|").alias("numbers"))


@query("b23_prompt_fields", "SELECT doc_id, doc_id::VARCHAR AS case_id, lang AS title FROM documents")
def b23(spark, d):
    prompt = F.concat(F.lit("Case: "), F.col("doc_id").cast("string"), F.lit("\nTitle: "), "lang", F.lit("\nBody: "), F.regexp_replace("text", "\n", " "))
    rows = table(spark, d, DOCS).select("doc_id", prompt.alias("p"))
    return rows.select("doc_id", T.labelled(F.col("p"), "Case").alias("case_id"), T.labelled(F.col("p"), "Title").alias("title"))


@query("b24_header_sections", r"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS heading FROM pages")
def b24(spark, d):
    part = lambda tag: F.trim(F.regexp_extract(F.col("html"), f"(?s)<{tag}>(.*?)</{tag}>", 1))
    return table(spark, d, PAGES).select("page_id", part("title").alias("title"), part("h1").alias("heading"))


GLOSSARY = [("tion", "action"), ("und", "and"), ("que", "that"), ("para", "for"), ("ing", "action"), ("ment", "way")]


@query("b25_glossary", f"""WITH g AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(GLOSSARY))}) g(i, a, b)),
 f AS (SELECT doc_id, b, min(i) AS i FROM documents JOIN g ON contains(text, a) GROUP BY doc_id, b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
 SELECT d.doc_id, coalesce(string_agg(b, '|' ORDER BY r) FILTER (WHERE r <= 3), '') AS targets FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def b25(spark, d):
    return table(spark, d, DOCS).select("doc_id", F.array_join(T.glossary(F.col("text"), GLOSSARY, 3), "|").alias("targets"))


@query("b28_title_classes", """SELECT page_id, concat_ws('; ', CASE WHEN contains(url, 'blog') THEN 'Blog' END, CASE WHEN contains(url, '?') THEN 'Query' END, CASE WHEN contains(url, '#') THEN 'Anchor' END) AS classes FROM pages""")
def b28(spark, d):
    url = F.col("url")
    return table(spark, d, PAGES).select("page_id", F.concat_ws("; ", *[F.when(F.contains(url, F.lit(t)), name) for t, name in (("blog", "Blog"), ("?", "Query"), ("#", "Anchor"))]).alias("classes"))


DELAY, EVIDENCE, CLAIM = ["ting", "ion"], ["and"], ["ble", "whst"]
WEIGHTS = [(DELAY, 4), (EVIDENCE, 3), (CLAIM, 3)]
B27 = " + ".join(f"{w} * ({' + '.join(f'contains(x, {t!r})::INT' for t in terms)})" for terms, w in WEIGHTS)


@query("b27_section_summary", f"""WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM s),
 h AS (SELECT *, {' + '.join(f"contains(x, '{t}')::INT" for t in CLAIM)} AS hits, {B27} + CASE WHEN i < 6 THEN 2 ELSE 0 END + CASE WHEN length(x) BETWEEN 35 AND 220 THEN 1 ELSE 0 END AS own FROM e),
 q AS (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS most FROM h), c AS (SELECT *, hits * 10 + own AS score FROM q WHERE (most > 0 AND hits > 0) OR (most = 0 AND i BETWEEN 3 AND 10)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i DESC) AS r FROM c),
 a AS (SELECT doc_id, trim(left(string_agg(x, ' ' ORDER BY i), 420), ' ') AS section FROM r WHERE r <= 6 GROUP BY doc_id)
 SELECT doc_id, coalesce(section, '') AS section FROM documents LEFT JOIN a USING (doc_id)""")
def b27(spark, d):
    sentences = F.filter(F.split("text", "\\. "), lambda x: x != "")
    return table(spark, d, DOCS).select("doc_id", T.section_of(sentences, CLAIM, WEIGHTS, 420, start=3).alias("section"))
