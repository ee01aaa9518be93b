import pytest

from sluice.llm import common, huffman, packing, warc
from sluice.llm.tokens import vocabulary_path

PREFIX = "spark.sql.execution.arrow."


def settings(spark):
    return {r.key: r.value for r in spark.sql("SET").collect() if r.key.startswith(PREFIX)}


def test_operators_leave_the_session_as_it_is(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(300)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", f"<p>{i % 7}</p>") for i in range(300)], "page_id long, url string, html string")
    before = settings(spark)
    archives = warc.round_trip(pages)
    ids = huffman.round_trip(docs, vocabulary_path("word_bpe_49k.json"))
    pieces = packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))
    assert settings(spark) == before
    assert pieces.select("doc_id").distinct().count() == ids.count() == archives.count() == 300
    assert settings(spark) == before


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
