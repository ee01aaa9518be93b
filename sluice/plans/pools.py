"""Queries on tiers, pools and queues (2-E) and on split outputs (2-A)."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pools as O
from ..operators import sets as S
from .features import CORE, RISK, TOPIC, any_sql, hits_sql
from .registry import query, table

C = F.col
MANIFEST = f"""m AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, {hits_sql(CORE, 'd.text')} AS core, {hits_sql(TOPIC, 'd.text')} AS topic, {any_sql(RISK, 'd.text')} AS risk, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
 t AS (SELECT *, CASE WHEN quality = 1 AND toxic = 0 AND core > 0 THEN 'accepted' WHEN core > 0 AND n_chars >= 1800 AND NOT risk THEN 'high_quality' WHEN core > 0 AND n_chars >= 500 THEN 'local_candidate' ELSE 'excluded_or_pending' END AS tier FROM m)"""
RANK = "CASE tier WHEN 'accepted' THEN 3 WHEN 'high_quality' THEN 2 WHEN 'local_candidate' THEN 1 ELSE 0 END"


def manifest(spark, d, *more):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", T.hits(C("text"), CORE).alias("core"), T.hits(C("text"), TOPIC).alias("topic"), T.any_of(C("text"), RISK).alias("risk"), *more)
    rows = rows.join(table(spark, d, "labels"), "doc_id", "left")
    good = F.coalesce((C("quality") == 1) & (C("toxic") == 0), F.lit(False)) & (C("core") > 0)
    return rows.withColumn("tier", O.tier((C("core") > 0) & (C("n_chars") >= 500), (C("core") > 0) & (C("n_chars") >= 1800) & ~C("risk"), good))


@query("e1_tier", f"WITH {MANIFEST} SELECT doc_id, tier FROM t")
def e1(spark, d):
    return manifest(spark, d).select("doc_id", "tier")


@query("e2_retier", f"WITH {MANIFEST}, n AS (SELECT doc_id, tier, CASE WHEN topic > 2 THEN 'high_quality' ELSE 'excluded_or_pending' END AS new FROM t) SELECT doc_id, CASE WHEN {RANK} > CASE new WHEN 'high_quality' THEN 2 ELSE 0 END THEN tier ELSE new END AS tier FROM n")
def e2(spark, d):
    new = F.when(C("topic") > 2, "high_quality").otherwise("excluded_or_pending")
    return manifest(spark, d).select("doc_id", O.raised(C("tier"), new).alias("tier"))


@query("e3_tier_rank", f"WITH {MANIFEST} SELECT doc_id, {RANK} AS tier_rank FROM t")
def e3(spark, d):
    return manifest(spark, d).select("doc_id", O.rank(C("tier")).alias("tier_rank"))


@query("e4_upgrade_accepted", f"WITH {MANIFEST} SELECT doc_id, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 'accepted' ELSE tier END AS tier FROM t")
def e4(spark, d):
    accepted = table(spark, d, "pages").select(C("page_id").alias("doc_id"), F.lit(True).alias("yes")).distinct()
    return manifest(spark, d).join(accepted, "doc_id", "left").select("doc_id", F.when(C("yes"), "accepted").otherwise(C("tier")).alias("tier"))


@query("e5_pool_views", f"WITH {MANIFEST} SELECT doc_id, 'strict' AS view FROM t WHERE tier = 'accepted' UNION ALL SELECT doc_id, 'broad' FROM t WHERE topic > 0 UNION ALL SELECT doc_id, 'wide' FROM t WHERE core > 0")
def e5(spark, d):
    views = {"strict": C("tier") == "accepted", "broad": C("topic") > 0, "wide": C("core") > 0}
    return O.pool_views(manifest(spark, d), views).select("doc_id", "view")


@query("e6_lexical_pools", f"WITH {MANIFEST} SELECT doc_id, (n_chars >= 1200 AND core >= 1 AND topic >= 1 AND NOT risk)::INT AS candidate, (n_chars >= 1500 AND core >= 1 AND topic >= 2 AND NOT risk)::INT AS relaxed, (n_chars >= 1800 AND core >= 2 AND topic >= 2 AND NOT risk)::INT AS usable FROM m")
def e6(spark, d):
    flag = lambda n, core, topic: ((C("n_chars") >= n) & (C("core") >= core) & (C("topic") >= topic) & ~C("risk")).cast("int")
    return manifest(spark, d).select("doc_id", flag(1200, 1, 1).alias("candidate"), flag(1500, 1, 2).alias("relaxed"), flag(1800, 2, 2).alias("usable"))


@query("e8_candidate_rank", f"WITH {MANIFEST} SELECT doc_id, round(least(core, 3) * 0.2::DOUBLE + least(topic, 4) * 0.1::DOUBLE + least(n_chars / 5000::DOUBLE, 1) * 0.3::DOUBLE, 6) AS score FROM t WHERE core > 0 AND topic > 0 AND n_chars > 400 AND NOT risk AND tier <> 'accepted'")
def e8(spark, d):
    score = F.least(C("core"), F.lit(3)) * 0.2 + F.least(C("topic"), F.lit(4)) * 0.1 + F.least(C("n_chars") / 5000, F.lit(1.0)) * 0.3
    return manifest(spark, d).filter("core > 0 and topic > 0 and n_chars > 400 and not risk and tier <> 'accepted'").select("doc_id", F.round(score, 6).alias("score"))


@query("e9_strict_pool", f"WITH {MANIFEST} SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM t WHERE tier IN ('accepted', 'high_quality') GROUP BY sha256(text)")
def e9(spark, d):
    rows = manifest(spark, d, T.content_hash(C("text")).alias("h")).filter(C("tier").isin("accepted", "high_quality"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query("e10_fetch_queue", "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS r FROM pages WHERE length(html) > 300) WHERE r = 1 AND page_id NOT IN (SELECT doc_id FROM labels)")
def e10(spark, d):
    pages = table(spark, d, "pages").filter(F.length("html") > 300).select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("k"))
    first = S.keep_first(pages, ["k"], C("page_id"))
    return O.minus(first, table(spark, d, "labels").select(C("doc_id").alias("page_id")), key="page_id").select("page_id", "url")


REASONS = "CASE WHEN quality IS NOT NULL THEN 'labelled' WHEN risk THEN 'risk' WHEN n_chars < 300 THEN 'short' WHEN core = 0 THEN 'off_topic' ELSE 'kept' END"


def reasons():
    return [("labelled", C("quality").isNotNull()), ("risk", C("risk")), ("short", C("n_chars") < 300), ("off_topic", C("core") == 0)]


@query("e11_label_queue", f"WITH {MANIFEST} SELECT {REASONS} AS reason, count(*) AS n FROM t GROUP BY 1")
def e11(spark, d):
    return O.waterfall(manifest(spark, d), reasons()).groupBy("reason").agg(F.count("*").alias("n"))


@query("e12_labelling_pool", f"WITH {MANIFEST} SELECT doc_id, {RANK} AS tier_rank, topic FROM t WHERE quality IS NULL ORDER BY tier_rank DESC, topic DESC, doc_id LIMIT 100")
def e12(spark, d):
    rows = O.minus(manifest(spark, d).drop("quality", "toxic"), table(spark, d, "labels"), key="doc_id").withColumn("tier_rank", O.rank(C("tier")))
    return rows.orderBy(C("tier_rank").desc(), C("topic").desc(), "doc_id").limit(100).select("doc_id", "tier_rank", "topic")  # the report is the 100 best


@query("e13_quality_waterfall", f"WITH {MANIFEST}, f AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS copy FROM t) SELECT doc_id, CASE WHEN copy THEN 'duplicate' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 300 THEN 'short' ELSE 'kept' END AS reason FROM f")
def e13(spark, d):
    rows = manifest(spark, d, T.content_hash(C("text")).alias("h"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    rules = [("duplicate", C("doc_id") > C("first")), ("toxic", C("toxic") == 1), ("short", C("n_chars") < 300)]
    return O.waterfall(rows.join(firsts, "h"), rules).select("doc_id", "reason")


@query("e15_frozen_exclusion", "SELECT 'benchmark' AS list, count(*) AS n FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) UNION ALL SELECT 'toxic', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def e15(spark, d):
    lists = table(spark, d, "benchmark").select(C("item_id").alias("doc_id"), F.lit("benchmark").alias("list")).union(table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic")))
    return lists.distinct().join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("list").agg(F.count("*").alias("n"))


@query("e16_funnel", f"WITH {MANIFEST} SELECT 1 AS stage, 'all' AS name, count(*) AS n FROM t UNION ALL SELECT 2, 'long', count(*) FROM t WHERE n_chars >= 500 UNION ALL SELECT 3, 'on_topic', count(*) FROM t WHERE n_chars >= 500 AND core > 0 UNION ALL SELECT 4, 'clean', count(*) FROM t WHERE n_chars >= 500 AND core > 0 AND NOT risk")
def e16(spark, d):
    return O.funnel(manifest(spark, d), [("all", F.lit(True)), ("long", C("n_chars") >= 500), ("on_topic", C("core") > 0), ("clean", ~C("risk"))])


@query("e17_year_window", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1993 AND 1997 THEN 'in' WHEN year(o_orderdate) < 1993 THEN 'before' ELSE 'after' END AS reason FROM orders")
def e17(spark, d):
    year = F.year("o_orderdate")
    return O.waterfall(table(spark, d, "orders"), [("in", year.between(1993, 1997)), ("before", year < 1993)], "after").select("o_orderkey", "reason")


@query("e18_unlabelled_pool", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def e18(spark, d):
    frozen = table(spark, d, "benchmark").select(C("item_id").alias("doc_id"))
    return O.minus(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), frozen, key="doc_id")


@query("e20_clean_subset", f"WITH {MANIFEST} SELECT doc_id FROM t WHERE coalesce(toxic, 1) = 0 AND coalesce(quality, 0) = 1")
def e20(spark, d):
    return manifest(spark, d).filter("coalesce(toxic, 1) = 0 and coalesce(quality, 0) = 1").select("doc_id")


@query("e21_representatives", f"WITH {MANIFEST} SELECT tier, doc_id FROM (SELECT tier, doc_id, row_number() OVER (PARTITION BY tier ORDER BY core DESC, n_chars DESC, doc_id) AS r FROM t) WHERE r <= 2")
def e21(spark, d):
    return S.top_per_group(manifest(spark, d), ["tier"], 2, C("core").desc(), C("n_chars").desc(), C("doc_id")).select("tier", "doc_id")


@query("a8_split_outputs", f"WITH {MANIFEST} SELECT source, tier, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM t GROUP BY ALL")
def a8(spark, d):
    return manifest(spark, d).groupBy("source", "tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a17_run_counts", f"""WITH {MANIFEST}, b AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY {RANK} DESC, n_chars DESC, doc_id) AS r FROM t)
 SELECT tier, count(*) AS n_in, count(*) FILTER (WHERE r = 1) AS n_kept FROM b GROUP BY tier""")
def a17(spark, d):
    rows = manifest(spark, d, T.content_hash(C("text")).alias("h"))
    best = rows.groupBy("h").agg(F.min(F.struct(-O.rank(C("tier")), -C("n_chars"), C("doc_id").alias("id"))).alias("b")).select("h", C("b.id").alias("best"))
    return rows.join(best, "h").groupBy("tier").agg(F.count("*").alias("n_in"), F.count(F.when(C("doc_id") == C("best"), 1)).alias("n_kept"))


@query("e7_prefilter", f"WITH {MANIFEST} SELECT doc_id, (n_chars >= 300 AND core > 0 AND NOT risk) AS keep FROM t")
def e7(spark, d):
    return manifest(spark, d).select("doc_id", ((C("n_chars") >= 300) & (C("core") > 0) & ~C("risk")).alias("keep"))


@query("e14_queue_score", f"WITH {MANIFEST} SELECT doc_id, round(0.4::DOUBLE * core / 4 + 0.4::DOUBLE * topic / 4 + 0.2::DOUBLE * least(n_chars / 3000::DOUBLE, 1), 6) AS score FROM t WHERE quality IS NULL")
def e14(spark, d):
    score = 0.4 * C("core") / 4 + 0.4 * C("topic") / 4 + 0.2 * F.least(C("n_chars") / 3000, F.lit(1.0))
    return O.minus(manifest(spark, d).drop("quality", "toxic"), table(spark, d, "labels"), key="doc_id").select("doc_id", F.round(score, 6).alias("score"))


@query("e19_benchmark_pools", f"WITH {MANIFEST} SELECT doc_id, CASE WHEN tier = 'accepted' THEN 'strict' ELSE 'extended' END AS pool FROM t WHERE core > 0 AND NOT risk AND coalesce(toxic, 0) = 0")
def e19(spark, d):
    rows = manifest(spark, d).filter("core > 0 and not risk and coalesce(toxic, 0) = 0")
    return rows.select("doc_id", F.when(C("tier") == "accepted", "strict").otherwise("extended").alias("pool"))
