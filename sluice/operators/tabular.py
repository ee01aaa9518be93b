"""Features of numeric columns (2-L); columns are named by the caller."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sets import numbered

#: Added to a divisor's size.
EPS = 1e-6


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum, difference, product and quotient of each pair of columns, the earlier one first."""
    made: dict[str, Column] = {}
    for a, b in combinations(columns, 2):
        x, y = F.col(a), F.col(b)
        made |= {f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y, f"{a}_mul_{b}": x * y, f"{a}_div_{b}": x / (F.abs(y) + EPS)}
    return df.withColumns(made)


def finite(column: Column) -> Column:
    """A number without infinite values and NaN, which are missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def row_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """row_mean, row_std (sample; null for fewer than two values), row_min, row_max, row_median, row_na_count, row_abs_mean over the columns' values; nulls, NaN and infinite values do not count."""
    values = F.filter(F.array(*[finite(F.col(c)) for c in columns]), lambda x: x.isNotNull())

    def figures(v: Column) -> Column:
        n, order = F.size(v), F.array_sort(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        middle = (F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2
        return F.struct(
            mean.alias("row_mean"), F.when(n >= 2, F.sqrt(square / (n - 1))).alias("row_std"), F.array_min(v).alias("row_min"), F.array_max(v).alias("row_max"), F.when(n > 0, middle).alias("row_median"),
            (F.lit(len(columns)) - n).alias("row_na_count"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(n, F.lit(0))).alias("row_abs_mean"),
        )

    return df.withColumn("_figures", T.once(values, figures)).select("*", "_figures.*").drop("_figures")


def useless(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, dropped: a column goes if it is missing in all rows, or the same in all; a null beside a value is a second value. One pass."""
    there = {c: finite(F.col(c)) for c in columns}
    gone = [((F.count(x) == 0) | ((F.count(x) == F.count("*")) & (F.min(x) == F.max(x)))).alias(c) for c, x in there.items()]
    return df.agg(*gone).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("dropped")) for c in columns])))


def without_useless(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns' infinite values as nulls, without those that useless() drops; a row for each column reaches the driver."""
    gone = [r["name"] for r in useless(df, columns).filter("dropped").collect()]
    return df.withColumns({c: finite(F.col(c)) for c in columns if c not in gone}).drop(*gone)


def lags(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each column the last two values before a row, means of the last 3 and 5, deviation of the last 5 (two at least), and the gaps to the last one and to the mean of 3."""
    w = Window.partitionBy(group).orderBy(*order)
    last3, last5 = w.rowsBetween(-3, -1), w.rowsBetween(-5, -1)
    made: dict[str, Column] = {}
    for c in columns:
        lag, mean = F.lag(c).over(w), F.avg(c).over(last3)
        made |= {f"{c}_lag1": lag, f"{c}_lag2": F.lag(c, 2).over(w), f"{c}_roll3_mean": mean, f"{c}_roll5_mean": F.avg(c).over(last5)}
        made |= {f"{c}_roll5_std": F.when(F.count(c).over(last5) >= 2, F.stddev_samp(c).over(last5)), f"{c}_delta_lag1": F.col(c) - lag, f"{c}_delta_roll3": F.col(c) - mean}
    return df.withColumns(made)


def correlated(df: DataFrame, columns: list[str], threshold: float = 0.985) -> DataFrame:
    """name, dropped: a column goes if it correlates with an earlier one beyond the threshold. One pass over the rows; constant columns stay."""
    size = lambda a, b: F.abs(F.try_divide(F.covar_pop(*both(a, b)), F.stddev_pop(both(a, b)[0]) * F.stddev_pop(both(a, b)[1])))
    both = lambda a, b: [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b)]
    beyond = lambda a, b: F.coalesce(size(a, b) > threshold, F.lit(False))
    gone = [F.lit(False) if not i else F.greatest(F.lit(False), *[beyond(a, c) for a in columns[:i]]) for i, c in enumerate(columns)]
    one = df.agg(*[g.alias(c) for g, c in zip(gone, columns, strict=True)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("dropped")) for c in columns])))


def without_correlated(df: DataFrame, columns: list[str], threshold: float = 0.985) -> DataFrame:
    """df without the columns that correlated() drops; a row for each column reaches the driver."""
    return df.drop(*[r["name"] for r in correlated(df, columns, threshold).filter("dropped").collect()])


def time_folds(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """fold: which of k blocks of equal size, at the end of the order, a row is in; 0 for the rows before them.

    Fold f trains on the rows with a smaller number and validates on its own. A table of at most k rows has 0 alone.
    """
    placed = numbered(df, *order, name="_at")
    size = placed.agg(F.count("*").alias("_n")).withColumn("_size", F.floor(F.col("_n") / (k + 1)))
    into = F.col("_at") - 1 - (F.col("_n") - k * F.col("_size"))
    fold = F.when((F.col("_size") == 0) | (into < 0), 0).otherwise(F.floor(F.try_divide(into, F.col("_size"))) + 1)
    return placed.crossJoin(F.broadcast(size)).withColumn("fold", fold.cast("int")).drop("_at", "_n", "_size")  # one row
