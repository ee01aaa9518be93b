"""Documents made ready for training, in five stages; each works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir); run() writes its result as Parquet and reads it back as the
next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, packing, pii, toxicity
from sluice.llm.common import table, written
from sluice.llm.tokens import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below 0.7 (operator 4)."""
    score = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    return score(docs, list(COLUMNS)).filter("score < 0.7").select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach (five-word shingles, Jaccard 0.8 or more) the one with the smallest doc_id (operator 9).

    Rows without a doc_id stay. Rows of one doc_id are documents each for itself: of equal ones one stays, and
    one with another text stays or goes by its own links.
    """
    docs = docs.select(*COLUMNS)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        linked = jaccard.join(docs, width=5, num=80, den=100)
        return docs.join(linked.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    linked = jaccard.join(rows.filter("doc_id is not null"), width=5, num=80, den=100, id_column="row")
    group = linked.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    stays = group.groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row")).select("row")
    return rows.join(stays, "row", "left_semi").select(*COLUMNS).union(rows.filter("doc_id is null").select(*COLUMNS))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (operator 5)."""
    return decontaminate.without_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the words that disclose it replaced; n_chars follows (operator 8)."""
    found = pii.sanitise(docs, keep=("text", "lang", "source"))
    text = pii.sanitised_text(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence of at most 1024 tokens (operator 2)."""
    pieces = packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("ngram_jaccard_join", near_copies_out), ("benchmark_decontamination", benchmark_out), ("pii", personal_data_out), ("packing", packed)]

#: Trees, latent vectors and tokenizers are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
