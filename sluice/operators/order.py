"""Running sums, order statistics and the area under a curve without one task for all rows.

Rows are dealt into ranges of their order, so a group of any size is split over tasks; each range is summed,
the sums of the ranges before it (a row for each range and group) are added to what a range finds within itself.

Defined cases: nulls in an order column come first and in a score are left out; rows of equal order are
summed in any sequence (make the order total where that matters); an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import _kept


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with a running sum under each name, its own row included, within each group in the given order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{n}": c for n, c in sums.items()}
    # Kept, since Spark samples its ranges anew each time.
    rows = _kept(df.withColumns(values).repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.groupBy("_part", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    before = total.select(F.col("_part").alias("_earlier"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(v).over(earlier.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{v}") for v in values])
    same = F.col("_part") == F.col("_earlier")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumns({n: F.sum(f"_v_{n}").over(within) for n in sums}).join(before, same)
    return out.withColumns({n: F.col(n) + F.col(f"_b_v_{n}") for n in sums}).select(*df.columns, *sums)


def quantiles(df: DataFrame, column: str, at: list[float], by: list[str] = (), parts: int | None = None) -> DataFrame:
    """by, q (its place in `at`), value: exact quantiles with linear interpolation between neighbours."""
    by = list(by)
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = running(rows, by, [F.col("_x")], {"_at": F.lit(1)}, parts)
    sizes = placed.groupBy(*by).agg(F.max("_at").alias("_n"))
    spot = F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("q") + 1) * (F.col("_n") - 1)
    asked = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))).alias("q")).withColumn("_spot", spot).filter("_n > 0")
    ends = F.array(F.struct((F.floor("_spot") + 1).alias("_at"), (1 - F.col("_spot") + F.floor("_spot")).alias("_w")), F.struct((F.floor("_spot") + 2).alias("_at"), (F.col("_spot") - F.floor("_spot")).alias("_w")))
    asked = asked.select(*by, "q", F.inline(ends)).filter("_w > 0")
    asked = asked.toDF(*[f"_by_{c}" for c in by], "q", "_to", "_w")
    same = F.col("_at") == F.col("_to")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = placed.join(asked, same)
    value = F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.sum(F.col("_x") * F.col("_w")))
    return met.groupBy(*by, "q").agg(value.alias("value"))


def auc(df: DataFrame, label: Column, score: Column, by: list[str] = (), digits: int = 9, parts: int | None = None) -> DataFrame:
    """by, auc: the share of pairs of a 1 and a 0 in which the 1 scores higher, equal scores counting half; null without both.

    Rows are counted by distinct score first; the running sum goes over these.
    """
    by = list(by)
    rows = df.select(*by, label.cast("int").alias("_y"), F.round(score, digits).alias("_s")).filter("_y is not null and _s is not null")
    counts = rows.groupBy(*by, "_s").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
    below = running(counts, by, [F.col("_s")], {"_below": F.col("_q")}, parts)
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2))
    return below.groupBy(*by).agg(F.try_divide(wins, F.sum("_p") * F.sum("_q")).alias("auc"))


def longest_prefix(df: DataFrame, by: list[str], order: list[Column], good: Column, target: float, parts: int | None = None) -> DataFrame:
    """by, n: the longest prefix of the order whose share of good rows reaches the target. Observed, not predictive."""
    placed = running(df, by, order, {"_n": F.lit(1), "_good": good.cast("int")}, parts)
    return placed.filter(F.col("_good") / F.col("_n") >= target).groupBy(*by).agg(F.max("_n").alias("n"))
