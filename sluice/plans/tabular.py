"""Queries of the tabular feature job (2-L) on events."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tabular as O
from .registry import query, table

C = F.col
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("l1_encodings", "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS freq, dense_rank() OVER (ORDER BY event_type) AS code FROM events")
def l1(spark, d):
    ev = table(spark, d, "events")
    codes = ev.groupBy("event_type").agg(F.count("*").alias("freq")).withColumn("code", F.dense_rank().over(Window.orderBy("event_type")))  # one row for each type
    return ev.join(codes, "event_type").select("event_id", "freq", "code")


@query("l2_row_statistics", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_extendedprice + l_discount + l_tax) / 4, 4) AS mean, least(l_quantity, l_extendedprice, l_discount, l_tax) AS low, greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS high FROM lineitem")
def l2(spark, d):
    total = reduce(lambda a, b: a + b, map(C, LINE))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(total / 4, 4).alias("mean"), F.least(*LINE).alias("low"), F.greatest(*LINE).alias("high"))


@query("l3_top_variance", "SELECT name, round(v, 4) AS variance FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, unnest([var_samp(l_quantity), var_samp(l_extendedprice), var_samp(l_discount), var_samp(l_tax)]) AS v FROM lineitem) ORDER BY v DESC LIMIT 2")
def l3(spark, d):
    one = table(spark, d, "lineitem").agg(*[F.var_samp(c).alias(c) for c in LINE])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), C(c).alias("v")) for c in LINE])))
    return long.orderBy(C("v").desc()).limit(2).select("name", F.round("v", 4).alias("variance"))


MIXED = ["l_quantity", "l_extendedprice", "l_discount"]
MIXED_SQL = ", ".join(f"round({e}, 4) AS {a}_{k}_{b}" for a, b in combinations(MIXED, 2) for k, e in (("plus", f"{a} + {b}"), ("minus", f"{a} - {b}"), ("mul", f"{a} * {b}"), ("div", f"{a} / (abs({b}) + 1e-6)")))


@query("l4_interactions", f"SELECT l_orderkey, l_linenumber, {MIXED_SQL} FROM lineitem")
def l4(spark, d):
    rows = O.interactions(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *MIXED), MIXED).drop(*MIXED)
    return rows.select(*rows.columns[:2], *[F.round(c, 4).alias(c) for c in rows.columns[2:]])


@query("l5_lags", """SELECT event_id, round(lag(value) OVER w, 6) AS value_lag1, round(lag(value, 2) OVER w, 6) AS value_lag2, round(avg(value) OVER w3, 6) AS value_roll3_mean, round(avg(value) OVER w5, 6) AS value_roll5_mean, round(stddev_samp(value) OVER w5, 4) AS value_roll5_std,
 round(value - lag(value) OVER w, 6) AS value_delta_lag1, round(value - avg(value) OVER w3, 6) AS value_delta_roll3 FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), w3 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def l5(spark, d):
    rows = O.lags(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], ["value"])
    return rows.select("event_id", *[F.round(c, 4 if c.endswith("std") else 6).alias(c) for c in rows.columns[4:]])


@query("l6_constant_columns", "SELECT unnest(['l_quantity', 'l_tax', 'one']) AS name, unnest([count(DISTINCT l_quantity) <= 1, count(DISTINCT l_tax) <= 1, TRUE]) AS dropped FROM lineitem")
def l6(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("one"))
    one = rows.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in rows.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), C(c).alias("dropped")) for c in rows.columns])))


TWINS = [*LINE, "twice", "discounted"]
TWINS_SQL = ", ".join(f"{' OR '.join([f'abs(corr({x}, {c})) > 0.985' for x in TWINS[:i]]) or 'FALSE'}" for i, c in enumerate(TWINS))


@query("l7_correlated", f"SELECT unnest({TWINS}) AS name, unnest([{TWINS_SQL}]) AS dropped FROM (SELECT *, l_quantity * 2 + 1 AS twice, l_extendedprice * (1 - l_discount) AS discounted FROM lineitem)")
def l7(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE, (C("l_quantity") * 2 + 1).alias("twice"), (C("l_extendedprice") * (1 - C("l_discount"))).alias("discounted"))
    return O.correlated(rows, TWINS)


@query("l9_time_folds", "WITH r AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), b AS (SELECT value, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END::INT AS fold FROM r), g AS (SELECT fold, count(*) AS n_valid, round(avg(value), 6) AS mean FROM b GROUP BY fold) SELECT fold, n_valid, (sum(n_valid) OVER (ORDER BY fold) - n_valid)::BIGINT AS n_train, mean FROM g")
def l9(spark, d):
    rows = O.time_folds(table(spark, d, "events").select("event_id", "ts", "value"), [C("ts"), C("event_id")], 5)
    each = rows.groupBy("fold").agg(F.count("*").alias("n_valid"), F.round(F.avg("value"), 6).alias("mean"))
    return each.withColumn("n_train", F.sum("n_valid").over(Window.orderBy("fold")) - C("n_valid"))  # a row for each fold
