import random
import zlib

import numpy as np

from sluice.llm import toxicity as T


def made(n, seed=1):
    rng = random.Random(seed)
    syllables = "ta ri mo ne lu ka shi do pe wa".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 200))], rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgh", "blarkn"]) + word())
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_scores_of_held_out_rows(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "plain", "x"), (0, rows[0][1], "x")], "doc_id long, text string, features string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(7000, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = T.scorer(docs, labels, trees=5)(docs, ["doc_id"]).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 for r in got)
    score, right = {r.doc_id: r.score for r in got}, 0
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((score[i] >= 0.7) == bool(y) for i, y in held)
    assert right >= 0.97 * len(held) and score[5000] < 0.7
    flags = {r.doc_id: r.h for r in docs.select("doc_id", T.held_out(docs.doc_id).alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows) and flags[None] is False


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.scorer(docs, none)(docs, ["doc_id"]).collect()] == [0.0, 0.0]
    assert T.scorer(docs.limit(0), none)(docs.limit(0), ["doc_id"]).count() == 0


def test_features():
    data = [b"YOU are an IDIOT! really?", b"", b"l0ser sooo plain", b"idiot " + b"far " * 20 + b"you"]
    raw, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    x = {k: T.features(raw, ends, {})[:, i] for i, k in enumerate(T.FEATURES)}
    assert x["seed_density"][0] == 1 / 5 and x["near_second"].tolist()[0] == 1 / 5 and x["near_second"][3] == 0 < x["seed_density"][3]
    assert x["shouted"][0] == 2 / 5 and x["exclaimed"][0] > 0 and x["asked"][0] > 0 and not any(v[1] for v in x.values())
    assert x["digits_within"][2] == 1 / 3 and x["drawn_out"][2] > 0
