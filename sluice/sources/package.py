"""Outputs of a corpus in folders of their own: splits, instruction records, prompts, shards and the package of a fine-tune (2-A, 2-H).

Folders go where the caller says; `shared_path` names a new one that all executors share. Nothing here is collected: files
are written by the tasks that hold the rows, and reports are aggregates of what was written.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import numbered


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; below a local folder only where it is unset and there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_splits(df: DataFrame, path: str, usable: Column, text: str = "text", tier: str = "tier") -> None:
    """full, usable, excluded (Parquet), manifest (without the text) and tier_counts below a path. A null condition excludes.

    The rows are computed once: `full` is written with its decision, and the others are read from it.
    """
    spark = df.sparkSession
    df.withColumn("usable", F.coalesce(usable, F.lit(False))).write.parquet(f"{path}/full")
    full = spark.read.parquet(f"{path}/full")
    full.filter("usable").drop("usable").write.parquet(f"{path}/usable")
    full.filter("not usable").drop("usable").write.parquet(f"{path}/excluded")
    full.drop(text).write.parquet(f"{path}/manifest")
    full.groupBy(tier, "usable").agg(F.count("*").alias("n")).write.parquet(f"{path}/tier_counts")


def records(instruction: Column, input_: Column, output: Column) -> Column:
    """An instruction record; nulls are empty strings, so that every record has all fields."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(plain(instruction).alias("instruction"), plain(input_).alias("input"), plain(output).alias("output"))


def prompt(record: Column) -> Column:
    """A record as one text with headings; a record without input has no heading for it."""
    middle = F.when(record["input"] != "", F.concat(F.lit("\n\n### Input:\n"), record["input"])).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), record["instruction"], middle, F.lit("\n\n### Response:\n"), record["output"])


def write_records(df: DataFrame, record: Column, path: str) -> None:
    """JSON lines of a record's fields, one file for each task."""
    df.select(record.alias("r")).select("r.*").write.json(path)


def write_prompts(df: DataFrame, record: Column, path: str, between: str = "\n\n\n") -> None:
    """Prompt texts, each followed by `between`."""
    df.select(prompt(record).alias("value")).write.option("lineSep", between).text(path)


def read_prompts(spark: SparkSession, path: str, between: str = "\n\n\n") -> DataFrame:
    """value: the prompts of write_prompts(); a record must not hold `between` itself."""
    return spark.read.option("lineSep", between).text(path)


def write_shards(df: DataFrame, path: str, size: int, *order: Column) -> None:
    """Folders shard=0, shard=1 ... of `size` rows each, the last one with the rest; positions are counted by range, not in one task."""
    placed = numbered(df, *order)
    placed.withColumn("shard", F.floor((F.col("position") - 1) / size)).drop("position").write.partitionBy("shard").parquet(path)


def write_package(df: DataFrame, path: str, key: str, split: str, label: str, record: Column) -> None:
    """A fine-tune's folder: <split>/records (JSON lines), <split>/inputs (records without the answer), manifest (key, split, label, hashes), distribution, quality.

    quality: rows, missing ids and empty outputs, repeated inputs, and inputs that more than one split has.
    """
    spark = df.sparkSession
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    made = df.select(F.col(key).alias("key"), F.col(split).alias("split"), F.col(label).alias("label"), record.alias("r"))
    made.write.partitionBy("split").parquet(f"{path}/rows")
    rows = spark.read.schema(made.schema).parquet(f"{path}/rows")
    rows.select("split", "r.instruction", "r.input", "r.output").write.partitionBy("split").json(f"{path}/records")
    rows.select("split", "key", "r.instruction", "r.input").write.partitionBy("split").json(f"{path}/inputs")
    rows.select("key", "split", "label", hashed(F.col("r.input")).alias("input_sha256"), hashed(F.col("r.output")).alias("output_sha256")).write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    manifest.groupBy("split", "label").agg(F.count("*").alias("n")).write.parquet(f"{path}/distribution")
    by_input = manifest.groupBy("input_sha256").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    repeated = by_input.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_inputs"), F.count(F.when(F.col("splits") > 1, 1)).alias("inputs_across_splits"))
    empty = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("key").isNull(), 1)).alias("missing_ids"), F.count(F.when(F.trim("r.output") == "", 1)).alias("empty_outputs"))
    empty.crossJoin(F.broadcast(repeated)).write.parquet(f"{path}/quality")  # one row each
