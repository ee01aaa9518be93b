"""Joins that keep one side's names, set operations by key, deduplication with a total order (2-F)."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def left_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_right") -> DataFrame:
    """Left join; columns of the right side that clash get a suffix."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, "left")


def prefer_right(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which the right side's columns overwrite equal names, with nulls too."""
    return left.drop(*[c for c in right.columns if c in left.columns and c not in on]).join(right, on, "left")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _folder(df: DataFrame) -> str:
    """The checkpoint folder, in spark.checkpoint.dir, which all executors share; a local folder is set only on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not (context.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def _kept(df: DataFrame) -> DataFrame:
    """df by checkpoint()."""
    _folder(df)
    return df.checkpoint()


def _stored(df: DataFrame, *by: str, schema: StructType | None = None, rows: int = 256, ascending: tuple[str, ...] = ()) -> DataFrame:
    """df as compressed Parquet beside the checkpoints, in folders by the columns `by`, read back (as `schema`): integers and counts take a fraction of a checkpoint's bytes, and readers take only the columns and folders they need.

    Python in df gets so many rows at once. Arrays of integers named in `ascending` are stored by their steps.
    """
    spark, path, batch = df.sparkSession, f"{_folder(df)}/stored-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.getAll.get(batch)
    spark.conf.set(batch, str(rows))
    try:
        options = {"parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ascending}
        df.write.options(compression="zstd", **options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(batch) if own is None else spark.conf.set(batch, own)
    return spark.read.schema(schema or df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str = "position", parts: int | None = None) -> DataFrame:
    """Positions from 1 in an order, without one task for all rows: rows are ranged (into the session's shuffle partitions), counted by range, then numbered within.

    Spark samples a table for its ranges, each time anew, so the ranged rows are kept: counts and numbers are of the same ranges.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _kept((df.repartitionByRange(parts, *order) if order else df).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_part", "_before")


def join_by_position(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Row i with row i; the shorter side decides."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "position")


def union_tagged(parts: dict[str, DataFrame], tag: str = "source_batch") -> DataFrame:
    """Union of tables whose columns may differ, each row tagged with its table's name."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same for each key of two versions."""
    both = old.select(key, F.col(value).alias("old"), F.lit(1).alias("_o")).join(new.select(key, F.col(value).alias("new"), F.lit(1).alias("_n")), key, "full")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.select(key, "old", "new", status.alias("status"))


def overlap_report(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """left, right, shared: how many keys two tables have in common, for each pair of them."""
    names, out = sorted(parts), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one = parts[a].select(key).distinct().join(parts[b], key, "left_semi").agg(F.count("*").alias("shared")).select(F.lit(a).alias("left_"), F.lit(b).alias("right_"), "shared")
            out = one if out is None else out.union(one)
    return out


def pool_overlap(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """part, n: how many different keys both pools have, and how many one of them alone has; null keys are left out."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("side")).unionByName(right.select(F.col(key).alias("k"), F.lit(2).alias("side"))).filter("k is not null")
    each = sides.groupBy("k").agg(F.bit_or("side").alias("sides"))
    counts = each.agg(*[F.count(F.when(F.col("sides") == v, 1)).alias(f"n{v}") for v in (1, 2, 3)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("part"), F.col(f"n{v}").alias("n")) for v, name in ((3, "both"), (1, f"{names[0]}_only"), (2, f"{names[1]}_only"))])))


def forbidden_fields(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """field, n: in how many rows' records (JSON text) a field name stands that must not be there, every name listed."""
    counts = df.agg(*[F.count(F.when(F.col(column).rlike(f'"{name}"\\s*:'), 1)).alias(f"f{i}") for i, name in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"f{i}").alias("n")) for i, name in enumerate(names)])))
