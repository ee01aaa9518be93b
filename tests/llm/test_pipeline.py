import random
import zlib

import numpy as np
from test_jaccard import brute

import corpus_pipeline as C
from sluice.llm.tokens import PieceEncoder, vocabulary_path


def test_stages_one_after_the_other(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    bench = [(i, " ".join(say(40)) + ".") for i in range(5)]
    rows, toxic, leaked = [], set(), set()
    for i in range(400):
        text = say(rng.randint(30, 200))
        if i % 5 == 0:
            text[3:3] = ["zorghx", "idiot", "blarknq", "moron"]
            toxic.add(i)
        if i % 40 == 1:
            text += bench[i // 40 % 5][1].split()
            leaked.add(i)
        if i % 40 == 2:
            text.insert(7, f"user{i}@mail.example.org")
        rows.append((i, " ".join(text)))
    rows += [(500 + i, rows[i][1] + " tail") for i in range(3, 33, 3)] + [(600, None), (601, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == C.STAGES[-1][0] or docs.columns == columns
        kept.append(docs.collect())
    ids = [{r.doc_id for r in k} for k in kept]
    bad = toxic | {500 + i for i in range(3, 33, 3) if i in toxic}
    assert len(ids[0] & bad) <= 0.05 * len(bad) and {i for i, _ in rows} - bad <= ids[0]
    groups = brute([(r.doc_id, r.text) for r in kept[0]], 5, 80, 100)
    assert ids[1] == {d for _, d, _, c in groups if d == c}
    assert ids[1] - ids[2] == leaked & ids[1]
    before, after = {r.doc_id: r for r in kept[2]}, {r.doc_id: r for r in kept[3]}
    assert set(before) == set(after)
    for i, r in after.items():
        assert (r.text is None) == (before[i].text is None) and r.n_chars == (None if r.text is None else len(r.text))
        assert "@mail" not in (r.text or "") and ("[EMAIL]" in (r.text or "")) == ("@mail" in (before[i].text or ""))
    enc = PieceEncoder(vocabulary_path("byte_bpe_50k.json"), "byte").alone
    for i, r in after.items():
        want = np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 0], np.uint32)
        parts = sorted((p for p in kept[4] if p.doc_id == i), key=lambda p: p.start)
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in parts] and sum(p.length for p in parts) == len(want)


def test_near_copies_with_repeated_and_missing_ids(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, say(1)), (1, say(1)), (2, say(2)), (2, say(1)), (3, say(3)), (None, say(3)), (None, say(3)), (4, None), (4, None), (5, say(2) + " more")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "row") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n string")
    got = sorted((r.doc_id or 0, r.text or "") for r in C.near_copies_out(spark, docs, "").collect())
    assert got == sorted([(1, say(1)), (2, say(2)), (3, say(3)), (0, say(3)), (0, say(3)), (4, ""), (4, "")])
    assert C.near_copies_out(spark, docs.limit(0), "").count() == 0


def test_empty_tables_and_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, left in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame([(None, "mail a@b.example now", None, None, None), (7, None, "en", "s", 0)], schema), 2)):
        for name, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.select("doc_id", "doc_tokens" if name == "packing" else "text").distinct().count() == left
