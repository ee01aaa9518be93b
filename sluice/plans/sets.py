"""Queries on joins, set operations and deduplication (2-F), and on ingestion that is made of them (2-A)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sets as S
from .registry import query, table

C = F.col


@query("f1_left_join", "SELECT c_custkey, c_name, n.n_name AS nation FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 3")
def f1(spark, d):
    nation = table(spark, d, "nation").filter("n_regionkey < 3").select(C("n_nationkey").alias("c_nationkey"), C("n_name").alias("nation"))
    return S.left_join(table(spark, d, "customer"), nation, ["c_nationkey"]).select("c_custkey", "c_name", "nation")


@query("f2_multi_key_join", """SELECT a.l_returnflag, a.l_linestatus, a.l_linenumber, a.n, b.q FROM (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) a
 LEFT JOIN (SELECT l_returnflag, l_linestatus, l_linenumber, round(max(l_quantity), 6) AS q FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL) b USING (l_returnflag, l_linestatus, l_linenumber)""")
def f2(spark, d):
    keys, line = ["l_returnflag", "l_linestatus", "l_linenumber"], table(spark, d, "lineitem")
    return S.left_join(line.groupBy(*keys).agg(F.count("*").alias("n")), line.filter("l_linenumber < 4").groupBy(*keys).agg(F.round(F.max("l_quantity"), 6).alias("q")), keys)


@query("f3_inner_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def f3(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").filter("c_acctbal > 0"), C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("f4_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f4(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("f5_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f5(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("f6_lookup_join", "SELECT d.doc_id, l.quality, t.n_turns FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1) t ON t.conv_id = d.doc_id")
def f6(spark, d):
    turns = table(spark, d, "conversations").groupBy(C("conv_id").alias("doc_id")).agg(F.count("*").alias("n_turns"))
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(turns, "doc_id", "left")


@query("f7_prefer_right", "SELECT d.doc_id, l.quality AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def f7(spark, d):
    right = table(spark, d, "labels").select("doc_id", C("quality").alias("n_chars"))
    return S.prefer_right(table(spark, d, "documents").select("doc_id", "n_chars"), right, ["doc_id"])


@query("f8_join_by_position", """SELECT a.position, a.doc_id, b.page_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS position, doc_id FROM documents) a
 JOIN (SELECT row_number() OVER (ORDER BY page_id) AS position, page_id FROM pages) b USING (position)""")
def f8(spark, d):
    return S.join_by_position(table(spark, d, "documents").select("doc_id"), table(spark, d, "pages").select("page_id"), [C("doc_id")], [C("page_id")])


@query("f10_cross_product", "SELECT r_name, n_name, q FROM region, nation, (VALUES ('who'), ('when')) t(q) WHERE r_regionkey = n_regionkey OR (q = 'who' AND r_regionkey = 0)")
def f10(spark, d):
    questions = F.explode(F.array(F.lit("who"), F.lit("when"))).alias("q")
    pairs = F.broadcast(table(spark, d, "region")).crossJoin(table(spark, d, "nation")).select("*", questions)  # two fixed tables of the schema
    return pairs.filter("r_regionkey = n_regionkey or (q = 'who' and r_regionkey = 0)").select("r_name", "n_name", "q")


@query("f11_union_all", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def f11(spark, d):
    return table(spark, d, "documents").select(C("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(table(spark, d, "pages").select(C("page_id").alias("id"), F.lit("page").alias("kind")))


@query("f12_union_last_wins", "SELECT id, max_by(v, s) AS v FROM (SELECT doc_id AS id, lang AS v, 1 AS s FROM documents UNION ALL SELECT doc_id, 'label', 2 FROM labels) GROUP BY id")
def f12(spark, d):
    both = table(spark, d, "documents").select(C("doc_id").alias("id"), C("lang").alias("v"), F.lit(1).alias("s")).unionByName(table(spark, d, "labels").select(C("doc_id").alias("id"), F.lit("label").alias("v"), F.lit(2).alias("s")))
    return both.groupBy("id").agg(F.max_by("v", "s").alias("v"))


@query("f13_set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'first', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def f13(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n").union(a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("first").alias("part"), "n"))


@query("f14_keep_first_and_last", """SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS first_, max_by(event_id, (ts, event_id)) AS last_ FROM events GROUP BY ALL""")
def f14(spark, d):
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", order).alias("first_"), F.max_by("event_id", order).alias("last_"))


@query("f15_best_per_hash", """SELECT text_sha256, doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY tier DESC, n_chars DESC, doc_id) AS r FROM
 (SELECT doc_id, n_chars, sha256(text) AS text_sha256, (n_chars >= 1200)::INT + (n_chars >= 1800)::INT AS tier FROM documents)) WHERE r = 1""")
def f15(spark, d):
    tier = (C("n_chars") >= 1200).cast("int") + (C("n_chars") >= 1800).cast("int")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", T.content_hash(C("text")).alias("text_sha256"), tier.alias("tier"))
    best = F.struct(-C("tier"), -C("n_chars"), C("doc_id").alias("doc_id"), C("tier").alias("tier"))  # partial aggregation instead of a sort of all rows
    return rows.groupBy("text_sha256").agg(F.min(best).alias("m")).select("text_sha256", "m.doc_id", "m.tier")


STATUS = {"purchase": 3, "signup": 2, "view": 1}


@query("f16_best_status", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, event_id) AS r FROM events) WHERE r = 1")
def f16(spark, d):
    rank = F.coalesce(*[F.when(C("event_type") == k, v) for k, v in STATUS.items()], F.lit(0))
    return S.keep_first(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], rank.desc(), C("event_id"))


@query("f17_two_stage_dedup", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents),
 b AS (SELECT *, row_number() OVER (PARTITION BY source || lang ORDER BY n_chars DESC, doc_id) AS q FROM a WHERE r = 1) SELECT source || lang AS case_id, doc_id FROM b WHERE q = 1""")
def f17(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.concat("source", "lang").alias("case_id"), T.content_hash(C("text")).alias("h"))
    once = S.keep_first(rows, ["h"], C("n_chars").desc(), C("doc_id"))
    return S.keep_first(once, ["case_id"], C("n_chars").desc(), C("doc_id")).select("case_id", "doc_id")


@query("f18_prefix_duplicates", r"SELECT doc_id, row_number() OVER (PARTITION BY sha256(left(regexp_replace(text, '\s+', '', 'g'), 5000)) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def f18(spark, d):
    key = T.content_hash(F.left(T.without_space(C("text")), F.lit(5000)))
    rows = table(spark, d, "documents").select("doc_id", key.alias("k"))
    first = rows.groupBy("k").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "k").select("doc_id", (C("doc_id") > C("first")).alias("duplicate"))


@query("f19_split_duplicates", """WITH s AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents)
 SELECT doc_id, split, count(*) OVER (PARTITION BY split, h) > 1 AS duplicate, h IN (SELECT h FROM s o WHERE o.split <> s.split) AS crosses FROM s""")
def f19(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(C("text").cast("binary")).alias("h"), F.when(C("doc_id") % 10 == 0, "dev").otherwise("train").alias("split"))
    counts = rows.groupBy("h").agg(*[F.count(F.when(C("split") == s, 1)).alias(s) for s in ("dev", "train")])
    own, other = F.when(C("split") == "dev", C("dev")).otherwise(C("train")), F.when(C("split") == "dev", C("train")).otherwise(C("dev"))
    return rows.join(counts, "h").select("doc_id", "split", (own > 1).alias("duplicate"), (other > 0).alias("crosses"))


@query("f20_overlap_report", """WITH p AS (SELECT 'dev' AS s, md5(text) AS h FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'train', md5(text) FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'frozen', md5(text) FROM benchmark),
 n(s) AS (VALUES ('dev'), ('frozen'), ('train')) SELECT a.s AS left_, b.s AS right_, (SELECT count(*) FROM (SELECT h FROM p WHERE s = a.s INTERSECT SELECT h FROM p WHERE s = b.s)) AS shared FROM n a JOIN n b ON a.s < b.s""")
def f20(spark, d):
    h = F.md5(C("text").cast("binary")).alias("h")
    docs = table(spark, d, "documents")
    return S.overlap_report({"dev": docs.filter("doc_id % 10 = 0").select(h), "train": docs.filter("doc_id % 10 <> 0").select(h), "frozen": table(spark, d, "benchmark").select(h)}, "h")


@query("a5_first_filled", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END), ''), nullif(trim(props), ''), '-') AS value FROM events")
def a5(spark, d):
    return table(spark, d, "events").select("event_id", T.first_filled(F.when(C("event_type") == "view", "  ").otherwise(C("event_type")), C("props"), F.lit("-")).alias("value"))


@query("a6_union_manifests", "SELECT doc_id, lang, NULL AS url, 'docs' AS source_batch FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages")
def a6(spark, d):
    parts = {"docs": table(spark, d, "documents").select("doc_id", "lang"), "pages": table(spark, d, "pages").select(C("page_id").alias("doc_id"), "url")}
    return S.union_tagged(parts)


@query("a7_source_log", "SELECT s.source, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'missing' ELSE 'loaded' END AS status FROM (VALUES ('src0'), ('src1'), ('nowhere')) s(source) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c USING (source)")
def a7(spark, d):
    wanted = spark.createDataFrame([("src0",), ("src1",), ("nowhere",)], "source string")
    rows = wanted.join(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "left")
    return rows.select("source", F.coalesce("n", F.lit(0)).alias("n_rows"), F.when(C("n").isNull(), "missing").otherwise("loaded").alias("status"))


@query("a14_artifact_diff", """SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS status
 FROM (SELECT doc_id AS k, md5(text) AS v FROM documents) a FULL JOIN (SELECT min(doc_id) AS k, md5(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS v FROM documents GROUP BY text) b ON a.k = b.k""")
def a14(spark, d):
    """Documents against their cleaned version: one of equal texts, white space as single blanks."""
    docs = table(spark, d, "documents").select(C("doc_id").alias("k"), F.md5(C("text").cast("binary")).alias("v"), F.md5(F.regexp_replace("text", r"[ \t\r\n]+", " ").cast("binary")).alias("clean"))
    old, new = docs.select("k", "v"), docs.groupBy("v").agg(F.min("k").alias("k"), F.first("clean").alias("clean")).select("k", C("clean").alias("v"))
    return S.differences(old, new, "k", "v")
