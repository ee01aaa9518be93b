"""Connected components of links that are too many for one machine: alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Links that a task writes: a small graph need not keep hundreds of tasks busy.
LINKS = 250_000


def _round(links: DataFrame, tasks: int) -> DataFrame:
    """One large-star and one small-star step, written by so many tasks. links: a > b, without repeats.

    The least neighbours are written before they are joined back, so that both sides of each join
    are plain scans and Spark can split a node with very many links.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks), "star-least")
    large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct().coalesce(tasks), "star-large")
    least = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "star-least")
    joined = large.join(least, "a")
    small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return written(small.distinct().coalesce(tasks), "star-small")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach. links: two columns of longs; nodes without a link are not listed."""
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    now = written(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state, now = seen, _round(now, 2 + 2 * seen[0] // LINKS)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
