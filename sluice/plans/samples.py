"""Queries on splits, samples and dataset packages (2-H, 2-A sinks)."""

from pyspark.sql import functions as F

from ..operators import sample as O
from .registry import query, table

C = F.col
LAB = "l AS (SELECT doc_id, quality FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256(doc_id || '|7'), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM l)"


def labels(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality")


@query("h1_stratified_split", f"WITH {LAB} SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM r")
def h1(spark, d):
    return O.stratified(labels(spark, d), "quality", "doc_id", 7, F.floor(C("n") * 0.2))


@query("h1_split_rounded", f"WITH {LAB} SELECT doc_id, quality, CASE WHEN r <= CASE WHEN n >= 10 THEN greatest(round(n * 0.1::DOUBLE), 1) ELSE round(n * 0.1::DOUBLE) END THEN 'dev' ELSE 'train' END AS split FROM r")
def h1_rounded(spark, d):
    size = F.round(C("n") * 0.1)
    return O.stratified(labels(spark, d), "quality", "doc_id", 7, F.when(C("n") >= 10, F.greatest(size, F.lit(1.0))).otherwise(size))


@query("h2_folds", f"WITH {LAB} SELECT doc_id, quality, ((r - 1) % 5)::INT AS fold FROM r")
def h2(spark, d):
    return O.folds(labels(spark, d), "quality", "doc_id", 7, 5)


@query("h4_time_split", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), k AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM y), c AS (SELECT y AS cut FROM k WHERE i = greatest(0, floor(n * 0.7::DOUBLE) - 1)) SELECT o_orderkey, CASE WHEN year(o_orderdate) <= cut THEN 'train' ELSE 'test' END AS split FROM orders, c")
def h4(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    years = rows.agg(F.array_sort(F.collect_set("y")).alias("ys"))  # as many as there are years
    cut = years.select(F.get("ys", F.greatest(F.lit(0), F.floor(F.size("ys") * 0.7) - 1).cast("int")).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).select("o_orderkey", F.when(C("y") <= C("cut"), "train").otherwise("test").alias("split"))


@query("h5_balanced_selection", f"WITH {LAB}, a AS (SELECT *, r <= 40 AS own FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY r, quality) AS k FROM a) SELECT doc_id, quality FROM f WHERE own OR k <= 20")
def h5(spark, d):
    rows = O.ranked(labels(spark, d), "quality", "doc_id", 7)
    own, rest = rows.filter("r <= 40"), rows.filter("r > 40").orderBy("r", "quality").limit(20)  # the feature: a fixed target
    return own.union(rest).select("doc_id", "quality")


@query("h6_equal_classes", f"WITH {LAB} SELECT doc_id, quality FROM r WHERE r <= (SELECT min(n) FROM r)")
def h6(spark, d):
    return O.balanced(labels(spark, d), "quality", "doc_id", 7)


@query("h7_audit_subset", "SELECT doc_id, quality, rank::INT AS rank FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY toxic DESC, doc_id) AS rank FROM labels) WHERE rank <= 15")
def h7(spark, d):
    from ..operators.sets import top_per_group

    return top_per_group(table(spark, d, "labels"), ["quality"], 15, C("toxic").desc(), C("doc_id")).select("doc_id", "quality", "rank")


@query("h10_augmented_views", "SELECT doc_id || '_head' AS new_id, doc_id, left(text, 100) AS view FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id || '_tail', doc_id, right(text, 100) FROM documents WHERE lang = 'es' AND length(text) > 200")
def h10(spark, d):
    views = F.array(F.struct(F.lit("_head").alias("k"), F.left("text", F.lit(100)).alias("view")), F.struct(F.lit("_tail").alias("k"), F.when(F.length("text") > 200, F.right("text", F.lit(100))).alias("view")))
    rows = table(spark, d, "documents").filter("lang = 'es'").select("doc_id", F.inline(views)).filter("view <> ''")
    return rows.select(F.concat(C("doc_id").cast("string"), "k").alias("new_id"), "doc_id", "view")


@query("h11_training_pairs", "SELECT a.item_id AS block, b.item_id AS question, (a.item_id = b.item_id)::INT AS positive FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id OR b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)")
def h11(spark, d):
    # The near negative of each block is the next one: keys, not pairs of all.
    items = table(spark, d, "benchmark").select("item_id")
    n = items.agg(F.count("*").alias("n"))
    keyed = items.crossJoin(F.broadcast(n)).select(C("item_id").alias("block"), F.explode(F.array("item_id", (C("item_id") + 1) % C("n"))).alias("question"))
    return keyed.join(items.withColumnRenamed("item_id", "question"), "question").select("block", "question", (C("block") == C("question")).cast("int").alias("positive")).distinct()


@query("h14_master_labels", "SELECT min(d.doc_id) AS doc_id, sha256(d.text) AS h FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1) AND length(d.text) >= 200 GROUP BY sha256(d.text)")
def h14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality in (0, 1)"), "doc_id").filter(F.length("text") >= 200)
    return rows.groupBy(F.sha2(C("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("h16_rename_label", "SELECT doc_id, CASE quality WHEN 1 THEN 'partial_support' ELSE 'not_support' END AS label FROM labels")
def h16(spark, d):
    return labels(spark, d).select("doc_id", F.when(C("quality") == 1, "partial_support").otherwise("not_support").alias("label"))


@query("a9_instruction_records", """SELECT conv_id, turn, '{"instruction":"Reply","input":' || to_json(text) || ',"output":' || to_json(role) || '}' AS line FROM conversations WHERE NOT contains(text, '/')""")
def a9(spark, d):
    rows = table(spark, d, "conversations").filter(~F.contains("text", F.lit("/")))
    return rows.select("conv_id", "turn", F.to_json(F.struct(F.lit("Reply").alias("instruction"), C("text").alias("input"), C("role").alias("output"))).alias("line"))


@query("a10_prompt_text", "SELECT conv_id, turn, '### Instruction' || chr(10) || role || chr(10) || '### Response' || chr(10) || text AS prompt FROM conversations")
def a10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("\n", F.lit("### Instruction"), "role", F.lit("### Response"), "text").alias("prompt"))


@query("a11_shards", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS shard FROM documents")
def a11(spark, d):
    from ..operators.sets import numbered

    return numbered(table(spark, d, "documents").select("doc_id"), C("doc_id")).select("doc_id", F.floor((C("position") - 1) / 300).alias("shard"))


@query("a15_input_only", "SELECT doc_id, md5(text) AS input FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def a15(spark, d):
    return table(spark, d, "documents").join(labels(spark, d), "doc_id", "left_semi").select("doc_id", F.md5(C("text").cast("binary")).alias("input"))


@query("h3_test_split", f"WITH {LAB} SELECT doc_id, quality, CASE WHEN r <= greatest(1, least(n - 1, round(n * 0.25::DOUBLE))) THEN 'dev' ELSE 'train' END AS split FROM r")
def h3(spark, d):
    size = F.greatest(F.lit(1.0), F.least(C("n") - 1, F.round(C("n") * 0.25)))
    return O.stratified(labels(spark, d), "quality", "doc_id", 7, size)


@query("h9_diverse_pool", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents), t AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) SELECT doc_id FROM r WHERE r <= 10 UNION SELECT doc_id FROM t")
def h9(spark, d):
    from ..operators.sets import top_per_group

    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    each = top_per_group(docs, ["lang"], 10, C("n_chars").desc(), C("doc_id")).select("doc_id")
    return each.union(docs.orderBy(C("n_chars").desc(), "doc_id").limit(20).select("doc_id")).distinct()  # the feature: a fixed pool


@query("h15_package_distribution", f"WITH {LAB} SELECT CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'dev' ELSE 'train' END AS split, quality, count(*) AS n, min(length(text))::INT AS shortest, max(length(text))::INT AS longest FROM r JOIN documents USING (doc_id) GROUP BY ALL")
def h15(spark, d):
    split = O.stratified(labels(spark, d), "quality", "doc_id", 7, F.floor(C("n") * 0.2))
    chars = table(spark, d, "documents").select("doc_id", F.length("text").alias("c"))
    return split.join(chars, "doc_id").groupBy("split", "quality").agg(F.count("*").alias("n"), F.min("c").alias("shortest"), F.max("c").alias("longest"))


H8 = """f AS (SELECT l.doc_id, quality, toxic, sha256(l.doc_id || '|5') AS h FROM labels l),
 u AS (SELECT * FROM f WHERE quality = 0 AND toxic = 0 ORDER BY h, doc_id LIMIT 24), c AS (SELECT * FROM f WHERE quality = 1 AND toxic = 1 ORDER BY h, doc_id LIMIT 18),
 t AS (SELECT * FROM f WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM c) ORDER BY h, doc_id LIMIT 18),
 p AS (SELECT *, 'uncertain' AS sample_strategy, 1 AS k FROM u UNION ALL SELECT *, 'conflict', 2 FROM c UNION ALL SELECT *, 'tail', 3 FROM t),
 a AS (SELECT * FROM p UNION ALL SELECT * FROM (SELECT *, 'random_fill', 4 FROM f WHERE doc_id NOT IN (SELECT doc_id FROM p) ORDER BY h, doc_id LIMIT 60))"""


@query("h8_mixed_sample", f"WITH {H8} SELECT doc_id, sample_strategy FROM (SELECT * FROM a ORDER BY k, h, doc_id LIMIT 60)")
def h8(spark, d):
    plain, odd = (C("quality") == 0) & (C("toxic") == 0), (C("quality") == 1) & (C("toxic") == 1)
    parts = [("uncertain", plain, 24), ("conflict", odd, 18), ("tail", C("quality") == 1, 18)]
    return O.mixed(table(spark, d, "labels"), "doc_id", 5, parts, 60).select("doc_id", "sample_strategy")


TAXONOMY = ["notice", "delay", "payment", "design", "site", "labour", "weather", "records"]


@query("h12_rotating_blocks", f"WITH s AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) SELECT item_id, (k * 6 + i + 1)::BIGINT AS block_no, ({TAXONOMY})[((k * 6 + i) % {len(TAXONOMY)})::INT + 1] AS category FROM s CROSS JOIN generate_series(0, 5) g(i)")
def h12(spark, d):
    from ..operators.sets import numbered

    return O.rotating_blocks(numbered(table(spark, d, "benchmark").select("item_id"), C("item_id")), "position", TAXONOMY, 6).select("item_id", "block_no", "category")
