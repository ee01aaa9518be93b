"""Queries on aggregates, windows and profiles (2-G)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sets as S
from .registry import query, table

C = F.col


@query("g1_value_counts", "SELECT l.lang, count(d.doc_id) AS n, round(count(d.doc_id) / (SELECT count(*) FROM documents), 6) AS share FROM (VALUES ('en'), ('de'), ('zh')) l(lang) LEFT JOIN documents d USING (lang) GROUP BY 1")
def g1(spark, d):
    wanted = spark.createDataFrame([("en",), ("de",), ("zh",)], "lang string")
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("t"))
    return wanted.join(counts, "lang", "left").crossJoin(F.broadcast(total)).select("lang", F.coalesce("k", F.lit(0)).alias("n"), F.round(F.coalesce("k", F.lit(0)) / C("t"), 6).alias("share"))  # one row


@query("g2_length_profile", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, min(n_chars) AS shortest, median(n_chars) AS middle, max(n_chars) FILTER (WHERE r = floor(0.9::DOUBLE * n) + 1) AS p90, max(n_chars) AS longest FROM r GROUP BY 1")
def g2(spark, d):
    # Lengths are counted first; the 0.9 place is found in the running counts of distinct lengths.
    by = table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    run = by.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("lang")))
    p90 = F.min(F.when(C("upto") >= F.floor(0.9 * C("n")) + 1, C("n_chars"))).alias("p90")
    place = lambda at: F.min(F.when(C("upto") >= at, C("n_chars")))
    return run.groupBy("lang").agg(F.min("n_chars").alias("shortest"), ((place(F.floor((C("n") + 1) / 2)) + place(F.floor(C("n") / 2) + 1)) / 2).alias("middle"), p90, F.max("n_chars").alias("longest"))


@query("g3_class_weights", "SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality")
def g3(spark, d):
    counts = table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.crossJoin(total).select("quality", F.round(C("t") / (C("k") * C("n")), 6).alias("weight"))


@query("g4_crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\", count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def g4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().fillna(0)


@query("g5_pivot_first", "SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS user, min_by(text, turn) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY 1")
def g5(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.min_by("text", "turn"))


@query("g6_group_means_long", "SELECT event_type, 'value' AS name, round(avg(value), 6) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'user', round(avg(user_id), 6) FROM events GROUP BY 1")
def g6(spark, d):
    wide = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"), F.avg("user_id").alias("user"))
    return wide.unpivot("event_type", ["value", "user"], "name", "mean").withColumn("mean", F.round("mean", 6))


@query("g7_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def g7(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("g8_histogram_trend", "WITH h AS (SELECT day, count(e.event_id) AS n FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day) g LEFT JOIN events e ON e.ts::DATE = day GROUP BY 1) SELECT count(*) AS days, sum(n)::BIGINT AS n, round(regr_slope(n, epoch(day) / 86400), 4) AS slope, round(regr_r2(n, epoch(day) / 86400), 6) AS r2 FROM h")
def g8(spark, d):
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("k"))
    days = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    full = days.join(counts, "day", "left").select(F.unix_date("day").cast("double").alias("x"), F.coalesce("k", F.lit(0)).cast("double").alias("y"))
    return full.agg(F.count("*").alias("days"), F.sum("y").cast("bigint").alias("n"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query("g9_trailing_mean", "WITH h AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM h")
def g9(spark, d):
    h = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return h.select("day", "event_type", F.round(F.avg("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-4, 0)), 6).alias("mean"))


@query("g10_change_summary", "SELECT source, round(avg((lang = 'en' AND l.quality = 0)::INT), 6) AS changed, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels l USING (doc_id) GROUP BY 1")
def g10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg(((C("lang") == "en") & (C("quality") == 0)).cast("int")), 6).alias("changed"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("g11_review_aggregate", "SELECT role, count(*) AS n_rows, count(DISTINCT conv_id) AS cases, round(avg(length(text)), 4) AS mean_score FROM conversations GROUP BY 1")
def g11(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_rows"), F.count_distinct("conv_id").alias("cases"), F.round(F.avg(F.length("text")), 4).alias("mean_score"))


@query("g12_disagreement", "SELECT conv_id, count(DISTINCT length(text) % 5) AS scores FROM conversations GROUP BY 1 HAVING count(DISTINCT length(text) % 5) > 1")
def g12(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct(F.length("text") % 5).alias("scores")).filter("scores > 1")


@query("g13_top_per_group", "SELECT source, doc_id, rank::INT AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def g13(spark, d):
    return S.top_per_group(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], 3, C("n_chars").desc(), C("doc_id")).select("source", "doc_id", "rank")


@query("g14_status_rollup", "SELECT s, sum(a)::BIGINT AS total, sum(b)::BIGINT AS errors, max(m)::BIGINT AS most FROM (SELECT event_type AS s, count(*) AS a, 0 AS b, greatest(count(*), count(DISTINCT user_id)) AS m FROM events GROUP BY 1 UNION ALL SELECT 'error', 0, count(*), 0 FROM events WHERE event_type = 'error') GROUP BY 1")
def g14(spark, d):
    ev = table(spark, d, "events")
    a = ev.groupBy(C("event_type").alias("s")).agg(F.count("*").alias("a"), F.lit(0).cast("bigint").alias("b"), F.greatest(F.count("*"), F.count_distinct("user_id")).alias("m"))
    b = ev.filter("event_type = 'error'").agg(F.count("*").alias("b")).select(F.lit("error").alias("s"), F.lit(0).cast("bigint").alias("a"), "b", F.lit(0).cast("bigint").alias("m"))
    return a.unionByName(b).groupBy("s").agg(F.sum("a").alias("total"), F.sum("b").alias("errors"), F.max("m").alias("most"))


@query("g15_split_report", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS long_, count(*) FILTER (WHERE lang = 'en') AS english FROM documents GROUP BY 1")
def g15(spark, d):
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "documents").groupBy(F.when(C("doc_id") % 10 == 0, "dev").otherwise("train").alias("split")).agg(F.count("*").alias("n"), count(C("n_chars") > 2000).alias("long_"), count(C("lang") == "en").alias("english"))


@query("g16_ratios", "SELECT round(avg((l.doc_id IS NULL)::INT), 6) AS unknown, round((SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) / count(*), 6) AS largest_class FROM documents d LEFT JOIN labels l USING (doc_id)")
def g16(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    by = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(C("quality").isNull(), 1)).alias("u"))
    return by.agg(F.round(F.sum("u") / F.sum("n"), 6).alias("unknown"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_class"))


@query("g17_profile_table", "SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS en, round(count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS en_share FROM documents GROUP BY 1")
def g17(spark, d):
    en = F.count(F.when(C("lang") == "en", 1))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), en.alias("en"), F.round(en / F.count("*"), 6).alias("en_share"))


@query("g18_strongest_class", "WITH m AS (SELECT source, lang, round(avg(n_chars), 4) AS a FROM documents GROUP BY ALL) SELECT source, max_by(lang, (a, lang)) AS strongest, min_by(lang, (a, lang)) AS weakest FROM m GROUP BY 1")
def g18(spark, d):
    m = table(spark, d, "documents").groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 4).alias("a"))
    return m.groupBy("source").agg(F.max_by("lang", F.struct("a", "lang")).alias("strongest"), F.min_by("lang", F.struct("a", "lang")).alias("weakest"))


@query("g20_report_table", "SELECT p AS place, name, n FROM (VALUES (1, 'click', 'Clicks'), (2, 'purchase', 'Sales')) o(p, event_type, name) JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def g20(spark, d):
    order = spark.createDataFrame([(1, "click", "Clicks"), (2, "purchase", "Sales")], "place int, event_type string, name string")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(order), "event_type").select("place", "name", "n")
