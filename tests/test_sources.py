import hashlib
import json

import pytest

from sluice.sources import files
from sluice.streaming import ingest


def test_records_of_any_wrapping(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    for name in ("array.json", "wrapped.json", "lines.jsonl"):
        assert [tuple(r) for r in files.read_records(spark, str(tmp_path / name), "a:int,b:string").collect()] == [(1, "x"), (2, None)]


def test_csv_and_manifest(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('k,t\n1,"工期, ""x""\n延误"\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), "k int, t string").collect()] == [(1, '工期, "x"\n延误')]
    m = files.manifest(spark, str(tmp_path)).collect()
    assert [(r.bytes, r.sha256) for r in m] == [((tmp_path / "t.csv").stat().st_size, hashlib.sha256((tmp_path / "t.csv").read_bytes()).hexdigest())]


def test_stream_appends_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"pageid": p, "raw_text": t}) for p, t in rows))
        ingest.append_new(spark, source, "pageid string, raw_text string", sink, state).awaitTermination()

    arrive("a.json", ("1", "x"), ("2", "y"))
    arrive("b.json", ("2", "changed"), ("3", "x"))
    assert sorted(r.pageid for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]
    assert sorted(r.pageid for r in ingest.final_manifest(spark, sink).collect()) == ["1", "2"]


def test_one_object_per_file_and_malformed_files(spark, tmp_path):
    folder = tmp_path / "cases"
    folder.mkdir()
    for k in (1, 2):
        (folder / f"{k}.json").write_text(json.dumps({"a": k, "b": {"c": ["x", "y"]}}, indent=2))
    got = files.read_records(spark, str(folder), "a:int,b:struct<c:array<string>>").collect()
    assert sorted((r.a, r.b.c) for r in got) == [(1, ["x", "y"]), (2, ["x", "y"])]
    (tmp_path / "bad.json").write_text("{nonsense")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, str(tmp_path / "bad.json"), "a:int").collect()
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path / "lines.jsonl"), "a:int").collect()) == [1, 2]


def test_csv_encodings_and_missing_files(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("k,t\n1,工期延误\n".encode("gbk"))
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbf" + "k,t\n1,工期延误\n".encode())
    for name in ("g.csv", "u.csv"):
        assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / name), "k int, t string").collect()] == [(1, "工期延误")]
    gone = files.read_csv(spark, str(tmp_path / "gone.csv"), "k int, t string")
    assert gone.count() == 0 and gone.columns == ["k", "t"]


def test_full_text_by_path(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(3):
        (tmp_path / "a" / f"{k}.txt").write_text(f"line {k}\nmore")
    rows = [(1, str(tmp_path / "a" / "1.txt")), (2, None), (3, str(tmp_path / "a" / "nowhere.txt")), (4, str(tmp_path / "a" / "1.txt"))]
    got = files.with_text(spark.createDataFrame(rows, "id int, raw_text_path string")).collect()
    assert sorted((r.id, r.text) for r in got if r.text) == [(1, "line 1\nmore"), (4, "line 1\nmore")] and len(got) == 4


def test_sheets_are_tables_of_their_names(spark, tmp_path):
    files.write_sheets({"counts": spark.range(3), "tiers": spark.range(2).selectExpr("id AS tier")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/counts").count() == 3 and spark.read.parquet(f"{tmp_path}/tiers").columns == ["tier"]


def test_audit_keeps_the_last_arrival_of_each_page(spark, tmp_path):
    source, sink, state, audit = (str(tmp_path / n) for n in ("in", "out", "state", "audit"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"pageid": p, "raw_text": t}) for p, t in rows))
        ingest.append_new(spark, source, "pageid string, raw_text string", sink, state, audit).awaitTermination()

    arrive("a.json", ("1", "x"), ("2", "y"), ("2", "y"))
    arrive("b.json", ("2", "changed"), ("3", "x"))
    got = {r.pageid: (r.batch, r.chars, r.status) for r in ingest.last_audit(spark, audit).collect()}
    assert got == {"1": (0, 1, "appended"), "2": (1, 7, "known"), "3": (1, 1, "appended")}
    assert spark.read.parquet(audit).count() == 5 and spark.read.parquet(sink).count() == 3


def test_package_folders(spark, tmp_path):
    from pyspark.sql import functions as F

    from sluice.sources import package

    rows = [(1, "train", "a", "in", "out"), (2, "dev", "b", "in", ""), (None, "train", "a", None, None), (4, "train", "b", "line\n\nbreak", "é")]
    df = spark.createDataFrame(rows, "id long, split string, label string, i string, o string")
    record = package.records(F.lit("Do"), F.col("i"), F.col("o"))
    package.write_package(df, str(tmp_path / "p"), "id", "split", "label", record)
    assert tuple(spark.read.parquet(str(tmp_path / "p/quality")).first()) == (4, 1, 2, 1, 1)
    assert sorted((r.input, r.output) for r in spark.read.schema("input string, output string, split string").json(str(tmp_path / "p/records")).collect()) == [("", ""), ("in", ""), ("in", "out"), ("line\n\nbreak", "é")]
    assert "output" not in spark.read.json(str(tmp_path / "p/inputs")).columns
    package.write_prompts(df.filter("id is not null"), record, str(tmp_path / "t"), "\n@@\n")
    assert sorted(r.value for r in package.read_prompts(spark, str(tmp_path / "t"), "\n@@\n").collect()) == ["### Instruction:\nDo\n\n### Input:\nin\n\n### Response:\n", "### Instruction:\nDo\n\n### Input:\nin\n\n### Response:\nout", "### Instruction:\nDo\n\n### Input:\nline\n\nbreak\n\n### Response:\né"]
    package.write_shards(df.filter("id is not null"), str(tmp_path / "s"), 2, F.col("id"))
    assert sorted((r.id, r.shard) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, 0), (2, 0), (4, 1)]
    package.write_splits(df.withColumn("text", F.col("i")).withColumn("tier", F.col("label")), str(tmp_path / "x"), F.length("o") > 0)
    assert [spark.read.parquet(str(tmp_path / f"x/{n}")).count() for n in ("full", "usable", "excluded", "manifest")] == [4, 2, 2, 4] and "text" not in spark.read.parquet(str(tmp_path / "x/manifest")).columns
