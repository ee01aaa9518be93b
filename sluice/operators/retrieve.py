"""The most similar rows by shared items, exactly, however frequent some items are (2-K).

Items are split by how many rows have them. Rare ones, in at most `cap` rows, pair rows through an inverted
index, which is linear in the rows. The k-th best of these pairs is a floor: rows that share nothing but frequent
items with a query have at most as many in common as it has frequent items, so most queries are done. For
the others only as many frequent items are looked up, the rarest first, as the floor leaves open, and not by row:
what two rows share of frequent items depends on their frequent items and sizes alone, so rows that agree in both
are one class, classes meet classes, and of a class the k + 1 smallest ids stand for all.

Defined cases: rows without an id or without items match nothing; a row does not match itself; equal similarities (6
digits) go to the smaller id; repeated ids in one side count as one row with all their items; an empty side gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import _kept


def similarity(shared: Column, a: Column, b: Column) -> Column:
    return F.round(shared / (a + b - shared), 6)


def _sides(left: DataFrame, right: DataFrame, key: str, items: str, group: str | None, cap: int) -> list[DataFrame]:
    """id, n, hot (frequent items, the rarest first), rare [, g] of both sides."""
    made = []
    for side, grouped in ((left, False), (right, group is not None)):
        rows = side.select(F.col(key).alias("id"), *([F.col(group).alias("g")] if grouped else [F.lit(0).alias("g")]), F.explode(items).alias("item")).filter("id is not null and item is not null").distinct()
        made.append(rows)
    counts = made[1].groupBy("item").agg(F.count("*").alias("c"))
    out = []
    for rows in made:
        marked = rows.join(counts, "item", "left")
        frequent = F.when(F.col("c") > cap, F.struct("c", "item"))
        sides = marked.groupBy("id", "g").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(frequent)).alias("h"), F.collect_list(F.when(F.col("c") <= cap, F.col("item"))).alias("rare"))
        out.append(_kept(sides.withColumn("hot", F.transform("h", lambda x: x["item"])).drop("h")))
    return out


def nearest_by_items(left: DataFrame, right: DataFrame, key: str, items: str, k: int, group: str | None = None, cap: int = 1000) -> DataFrame:
    """query [, group], match, similarity, rank: the k best rows of `right` for each row of `left` (and value of its column `group`) by Jaccard, among those that share an item."""
    asked, held = _sides(left, right, key, items, group, cap)
    a = asked.select(F.col("id").alias("query"), F.explode("rare").alias("item"))
    b = held.select(F.col("id").alias("match"), "g", F.explode("rare").alias("item"))
    met = a.join(b, "item").filter("query <> match").groupBy("query", "match", "g").agg(F.count("*").alias("shared"))
    met = met.join(asked.select(F.col("id").alias("query"), F.col("n").alias("nq"), F.col("hot").alias("hq")), "query").join(held.select(F.col("id").alias("match"), "g", F.col("n").alias("nd"), F.col("hot").alias("hd")), ["match", "g"])
    shared = F.col("shared") + F.size(F.array_intersect("hq", "hd"))
    order = Window.partitionBy("query", "g").orderBy(F.desc("similarity"), "match")
    best = met.select("query", "g", "match", similarity(shared, F.col("nq"), F.col("nd")).alias("similarity"))
    best = _kept(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
    both = best.unionByName(_by_classes(asked, held, best, k)).groupBy("query", "g", "match").agg(F.max("similarity").alias("similarity"))
    out = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query", *([F.col("g").alias(group)] if group else []), "match", "similarity", "rank")


def _by_classes(asked: DataFrame, held: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Candidates that share frequent items, for queries whose k-th best does not rule them out; similarities are lower bounds, exact for rows that share no rare item."""
    # How many a query has, and the least similar of them, for each group that there is.
    floor = best.groupBy("query", "g").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(0.0).alias("floor"))
    open_ = asked.filter(F.size("hot") > 0).select(F.col("id").alias("query"), F.col("n").alias("nq"), F.col("hot").alias("hq"))
    open_ = open_.crossJoin(held.select("g").distinct())  # a row for each label
    open_ = open_.join(floor, ["query", "g"], "left").fillna(0.0, ["floor"])
    least = F.greatest(F.lit(1), F.ceil((F.col("floor") - 1e-6) * F.col("nq"))).cast("int")
    open_ = open_.withColumn("prefix", F.size("hq") - least + 1).filter("prefix >= 1").select("query", "g", "nq", "hq", "prefix")
    kinds = open_.groupBy("g", "nq", "hq", "prefix").agg(F.count("*").alias("queries")).drop("queries")
    members = held.filter(F.size("hot") > 0).select("g", F.col("n").alias("nd"), F.col("hot").alias("hd"), F.col("id").alias("match"))
    first = Window.partitionBy("g", "nd", "hd").orderBy("match")
    members = members.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).groupBy("g", "nd", "hd").agg(F.collect_list("match").alias("matches"))
    looked = kinds.withColumn("_p", F.slice("hq", F.lit(1), F.col("prefix"))).select("*", F.explode("_p").alias("item"))
    found = looked.join(members.select("*", F.explode("hd").alias("item")), ["g", "item"])
    # Two classes meet at each item that they share; the first one of them counts.
    found = found.filter(F.get(F.array_intersect("_p", "hd"), F.lit(0)) == F.col("item"))
    shared = F.size(F.array_intersect("hq", "hd"))
    found = found.select("g", "nq", "hq", "prefix", F.explode("matches").alias("match"), similarity(shared, F.col("nq"), F.col("nd")).alias("similarity"))
    order = Window.partitionBy("g", "nq", "hq", "prefix").orderBy(F.desc("similarity"), "match")
    found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")
    return open_.join(found, ["g", "nq", "hq", "prefix"]).filter("query <> match").select("query", "g", "match", "similarity")


def pairs_above(left: DataFrame, right: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """query, match, similarity of all pairs of at least `least`, in 6 digits.

    Items are ordered by rarity; two sets as similar as that share one of their first items already, so
    the most frequent items of a row are not looked up. Sizes that cannot reach the bar do not meet.
    """
    counts = right.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    made = []
    for side in (left, right):
        rows = side.select(F.col(key).alias("id"), F.explode(items).alias("item")).filter("id is not null and item is not null").distinct().join(counts, "item", "left")
        sets = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "item"))).alias("s"))
        sets = _kept(sets.select("id", F.transform("s", lambda x: x["item"]).alias("s"), F.size("s").alias("n")))
        prefix = F.col("n") - F.ceil((least - 1e-6) * F.col("n")).cast("int") + 1
        made.append((sets, sets.select("id", "n", F.slice("s", F.lit(1), F.least("n", prefix)).alias("p"))))
    (a, pa), (b, pb) = made
    heads = pa.select(F.col("id").alias("query"), F.col("n").alias("nq"), F.col("p").alias("pq"), F.explode("p").alias("item")).join(pb.select(F.col("id").alias("match"), F.col("n").alias("nd"), F.col("p").alias("pd"), F.explode("p").alias("item")), "item")
    sized = (F.least("nq", "nd") >= (least - 1e-6) * F.greatest("nq", "nd")) & (F.col("query") != F.col("match")) & (F.get(F.array_intersect("pq", "pd"), F.lit(0)) == F.col("item"))
    met = heads.filter(sized).select("query", "match", "nq", "nd").join(a.select(F.col("id").alias("query"), F.col("s").alias("sq")), "query").join(b.select(F.col("id").alias("match"), F.col("s").alias("sd")), "match")
    return met.select("query", "match", similarity(F.size(F.array_intersect("sq", "sd")), F.col("nq"), F.col("nd")).alias("similarity")).filter(F.col("similarity") >= least)
