"""Files in and out: records in JSON, JSON lines, CSV and text, one table each (2-A)."""

import io

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, otherwise: str = "gbk") -> DataFrame:
    """The rows of CSV files; none where the path does not exist.

    Lines in UTF-8 are read by Spark. Where one is not valid UTF-8, each file is decoded whole by `otherwise`.
    """
    empty = spark.createDataFrame([], schema)
    try:
        plain = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    if plain:
        return spark.read.csv(path, header=True, schema=empty.schema, multiLine=True, escape='"')

    names = empty.columns

    def decoded(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.read_csv(io.BytesIO(content), encoding=otherwise, dtype=str)[names]

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decoded, ", ".join(f"`{c}` string" for c in names))
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in empty.schema])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record for each line; files are split over tasks, and a line that is no record fails."""
    return spark.read.schema(schema.replace(":", " ")).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, read whole: an array, one object, lines, or an object that holds records under data, predictions or records.

    schema: name:type pairs. A file that is none of these fails. Large files of lines are for read_json_lines().
    """
    record, text = f"struct<{schema}>", F.col("t")
    strict = {"mode": "FAILFAST"}
    wrapped = f"struct<data:array<{record}>,predictions:array<{record}>,records:array<{record}>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\s\ufeff]+|\s+$", "").alias("t")).filter("t <> ''")
    held = F.expr("json_object_keys(t)")  # null for arrays, and for text that is not one JSON value

    def filled(line: Column) -> Column:
        return F.length(F.trim(line)) > 0

    lines = F.transform(F.filter(F.split("t", r"\r?\n"), filled), lambda x: F.from_json(x, record, strict))
    inner = F.from_json("t", wrapped, strict)
    many = F.forall(F.filter(F.split("t", r"\r?\n"), filled), lambda x: F.expr("true") & x.rlike(r"^\s*\{.*\}\s*$")) & (F.size(F.split("t", r"\r?\n")) > 1)
    whole = F.when(text.startswith("["), F.from_json("t", f"array<{record}>", strict)).when(many, lines)
    whole = whole.when(F.arrays_overlap(held, F.array(F.lit("data"), F.lit("predictions"), F.lit("records"))), F.coalesce(inner["data"], inner["predictions"], inner["records"]))
    return files.select(F.inline(whole.otherwise(F.array(F.from_json("t", record, strict)))))


def with_text(df: DataFrame, path_column: str = "raw_text_path", text_column: str = "text") -> DataFrame:
    """The full text of the file that each row names, read for the paths that occur alone; null where a path is null or no such file is found.

    Files are listed by their folders, then only those that rows name are read.
    """
    spark = df.sparkSession
    named = df.select(F.col(f"`{path_column}`").alias("_path")).filter("_path is not null").distinct()
    folders = [r[0] for r in named.select(F.regexp_replace("_path", "/[^/]*$", "")).distinct().toLocalIterator()]
    if not folders:
        return df.withColumn(text_column, F.lit(None).cast("string"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    texts = spark.read.text(folders, wholetext=True).select("value", plain(F.col("_metadata.file_path")).alias("_plain"))
    texts = texts.join(named.select(plain(F.col("_path")).alias("_plain")).distinct(), "_plain", "left_semi")
    return df.withColumn("_plain", plain(F.col(f"`{path_column}`"))).join(texts.withColumnRenamed("value", text_column), "_plain", "left").drop("_plain")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.write.partitionBy(shard).parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook's summary tables: one Parquet table for each sheet, in a folder of its name."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
