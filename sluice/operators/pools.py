"""Tiers, pools and queues over a manifest (2-E)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import numbered

TIERS = ("excluded_or_pending", "local_candidate", "high_quality", "accepted")


def tier(candidate: Column, high_quality: Column, accepted: Column) -> Column:
    """The highest tier whose rule holds."""
    return F.when(accepted, TIERS[3]).when(high_quality, TIERS[2]).when(candidate, TIERS[1]).otherwise(TIERS[0])


def rank(name: Column) -> Column:
    return F.coalesce(*[F.when(name == t, i) for i, t in enumerate(TIERS)], F.lit(0))


def raised(old: Column, new: Column) -> Column:
    """The higher of two tiers."""
    return F.when(rank(old) > rank(new), old).otherwise(new)


def pool_views(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """A row for each view that a row belongs to, in one pass."""
    names = F.array_compact(F.array(*[F.when(cond, name) for name, cond in views.items()]))
    return df.withColumn("view", F.explode(names))


def waterfall(df: DataFrame, rules: list[tuple[str, Column]], passed: str = "kept") -> DataFrame:
    """`reason`: the first rule that removes a row, or that it is kept."""
    return df.withColumn("reason", F.coalesce(*[F.when(cond, name) for name, cond in rules], F.lit(passed)))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """How many rows pass each stage and all before it, in one aggregate."""
    conds = [reduce(lambda a, b: a & b, [c for _, c in stages[: i + 1]]) for i in range(len(stages))]
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(conds)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(stages)])
    return counts.select(F.inline(rows))


def minus(df: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the other tables."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), others, df)


def first_of(df: DataFrame, same: str, key: str) -> DataFrame:
    """`first`: whether a row has the smallest key of all rows that are the same; by an aggregate and a join, not by a sort of each group."""
    least = df.groupBy(same).agg(F.min(key).alias("_least"))
    return df.join(least.withColumnRenamed(same, "_same"), F.col(same).eqNullSafe(F.col("_same"))).withColumn("first", F.col(key) == F.col("_least")).drop("_least", "_same")


def ranked_pool(df: DataFrame, conditions: list[Column], same: str, key: str, score: Column, *then: Column) -> DataFrame:
    """The first of equal rows among those that meet all conditions, with score and rank by score, then the further order, then key; positions are counted by range, not in one task."""
    kept = df.filter(reduce(lambda a, b: a & b, conditions))
    return numbered(first_of(kept, same, key).filter("first").drop("first").withColumn("score", score), F.desc("score"), *then, F.col(key), name="rank")


def wide_score(delay: Column, procedure: Column, evidence: Column, chars: Column) -> Column:
    return delay * 5 + procedure * 2 + evidence + F.least(F.greatest(chars / 5000, F.lit(0.0)), F.lit(5.0))


def label_queue(df: DataFrame, known: list[tuple[str, Column]], later: list[tuple[str, Column]], same: str, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The queue with its positions, and the report of what was left out.

    `known` reasons are counted each by itself (a row may have several); then a row that repeats an earlier one, kept or not,
    goes; `later` reasons are counted among the rows that are left. The report: metric, value, in that order.
    """
    rows = first_of(df.withColumns({f"_k{i}": F.coalesce(c, F.lit(False)) for i, (_, c) in enumerate(known)} | {f"_l{i}": F.coalesce(c, F.lit(False)) for i, (_, c) in enumerate(later)}), same, key)
    count = lambda c: F.count(F.when(c, 1))
    keep = reduce(lambda a, b: a & b, [~F.col(f"_k{i}") for i in range(len(known))], F.lit(True))
    metrics = [(name, count(F.col(f"_k{i}"))) for i, (name, _) in enumerate(known)] + [("repeated_text", count(keep & ~F.col("first")))]
    keep = keep & F.col("first")
    for i, (name, _) in enumerate(later):
        metrics.append((name, count(keep & F.col(f"_l{i}"))))
        keep = keep & ~F.col(f"_l{i}")
    metrics = [("source_rows", F.count("*")), ("queue_rows", count(keep)), *metrics]
    one = rows.agg(*[c.alias(f"m{i}") for i, (_, c) in enumerate(metrics)])
    report = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, (name, _) in enumerate(metrics)])))
    marks = [*(f"_k{i}" for i in range(len(known))), *(f"_l{i}" for i in range(len(later))), "first"]
    return numbered(rows.filter(keep).drop(*marks), *order, F.col(key)), report


def lexical_pools(chars: Column, construction: Column, delay: Column, core: Column, evidence: Column, decision: Column, procedural: Column) -> list[Column]:
    """Four flags from counts of terms: research candidate, relaxed, usable, strong. core: whether a core term of delay occurs; two delay terms do as well."""
    fit = (construction >= 1) & (decision >= 1) & (procedural == 0)
    on_topic = fit & ((delay >= 2) | core)
    usable = on_topic & (chars >= 1800)
    flags = {"research_candidate": fit & (delay >= 1) & (chars >= 1200), "relaxed": on_topic & (chars >= 1500), "usable": usable, "strong": usable & (evidence >= 1) & (decision >= 2)}
    return [F.coalesce(flag, F.lit(False)).cast("int").alias(name) for name, flag in flags.items()]


def representatives(df: DataFrame, category: str, preferred: list[str], order: list[str], key: str, n: int, eligible: Column) -> DataFrame:
    """At most n rows of df with their position: the best of each preferred category in turn, then the best of all that are left.

    Only eligible rows are looked at, unless there are none. order: numeric columns, more is better, null is least;
    ties go to the smaller key. Keys are distinct. An empty table gives no rows.
    """
    rows = df.withColumn("ok_", F.coalesce(eligible, F.lit(False)))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.bool_or("ok_"), F.lit(False)).alias("any_")))).filter("ok_ or not any_").drop("ok_", "any_")
    worth = [(-F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(f"by{i}") for i, c in enumerate(order)]
    ranked = rows.withColumn("worth_", F.struct(*worth, F.col(key)))
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(category)).cast("int")
    best = ranked.filter(F.col(category).isin(preferred)).groupBy(category).agg(F.min_by(F.struct("*"), "worth_").alias("r")).select("r.*").withColumn("place_", place)
    rest = ranked.orderBy("worth_").limit(n + len(preferred)).withColumn("place_", F.lit(len(preferred) + 1))
    few = best.unionByName(rest).groupBy(key).agg(F.min_by(F.struct("*"), "place_").alias("r")).select("r.*")
    # At most n and twice the preferred categories are left, so one task may number them.
    return few.withColumn("position", F.row_number().over(Window.orderBy("place_", "worth_"))).filter(F.col("position") <= n).drop("worth_", "place_")
