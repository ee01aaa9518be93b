"""Incremental intake of raw documents: files that arrive are cleaned, keyed and appended once (A12)."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def append_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, audit: str | None = None) -> StreamingQuery:
    """Read JSON files as they come; append rows whose pageid the sink does not have. Stops when all is read.

    audit: a folder that gets a row for every arrival, `appended`, `known` (the sink has its pageid) or `repeated` (within its batch).

    Of a batch's rows of one pageid the least by text hash and text is kept, so a replay gives the same. A batch
    writes its own partition of the sink and replaces what a failed run of it left there.
    """

    def put(batch: DataFrame, number: int) -> None:
        first = Window.partitionBy("pageid").orderBy("text_sha256", "raw_text")
        arrived = batch.withColumn("text_sha256", T.content_hash(F.col("raw_text"))).withColumn("_r", F.row_number().over(first))
        rows, known = arrived.filter("_r = 1").drop("_r"), None
        try:
            known = spark.read.parquet(sink).filter(F.col("batch") != number).select("pageid").distinct()
            rows = rows.join(known, "pageid", "left_anti")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if audit:
            seen = arrived.withColumn("_known", F.lit(None).cast("boolean")) if known is None else arrived.join(known.withColumn("_known", F.lit(True)), "pageid", "left")
            status = F.when(F.col("_known"), "known").when(F.col("_r") > 1, "repeated").otherwise("appended")
            seen.select("pageid", "text_sha256", F.length("raw_text").alias("chars"), status.alias("status"), F.col("_r").alias("place")).write.mode("overwrite").parquet(f"{audit}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_manifest(spark: SparkSession, sink: str) -> DataFrame:
    """The first row of each text, in the order of intake."""
    w = Window.partitionBy("text_sha256").orderBy("batch", "pageid")
    return spark.read.parquet(sink).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def last_audit(spark: SparkSession, audit: str) -> DataFrame:
    """Of each pageid the row of its last arrival, by batch, then by place within it; an aggregate, not a sort of each pageid's rows."""
    rows = spark.read.parquet(audit)
    last = F.max(F.struct("batch", "place", "text_sha256", "chars", "status"))
    return rows.groupBy("pageid").agg(last.alias("a")).select("pageid", "a.batch", "a.text_sha256", "a.chars", "a.status")
