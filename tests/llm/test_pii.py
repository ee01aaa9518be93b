import math
import random
import re
import time
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import pii as P
from sluice.llm.spans import listed


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text) if valid(k, m[0]))


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.b for r in df.select("i", listed(P.patterns(F.col("text")), "order", "start").alias("b")).orderBy("i").collect()]


TEXTS = ["", "a@b.c.d+e@f.g @x.y a@@b.c é𝄞 x.y@z-1.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 9999999999999999999999.1.1.1", "4111 1111-1111 1111 4111111111111112 1 2", "+1 (454) 555-9913 +12 +1234567890123456 ++49.30.123456-7", "1 " * 30_000, "9" * 50_000, "a." * 50_000 + "@" + "b." * 20_000, "x@y" + ".z" * 20_000]


def test_patterns(spark):
    assert base_of(spark, TEXTS[:5]) == [brute(t) for t in TEXTS[:5]]
    assert len(base_of(spark, TEXTS[5:])) == 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from("ab1@.-_+"), max_size=30), st.text(alphabet=st.sampled_from("0123459.+-() "), max_size=50)), min_size=1, max_size=60))
def test_patterns_at_random(spark, texts):
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_terms_that_disclose(spark):
    mail, others = "ann@corp.example", "common words everywhere around"
    rows = [(1, f"the zebrafish wrote {mail} about {others}"), (2, f"{others} zebrafish replied to {mail} today"), (3, f"someone {others} bob@x.org once"), (4, f"again {others} bob@x.org twice")]
    rows += [(10 + i, f"{others} number {i}") for i in range(60)] + [(5, None), (6, ""), (None, f"copy of {mail}"), (90, "lonely carl@x.org hapaxword"), (91, "lonely carl@x.org hapaxword")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, spans string")
    got = P.sanitise(df, keep=("text",))
    out = {r.doc_id: r for r in got.select("doc_id", P.sanitised_text(F.col("text"), F.col("spans")).alias("t"), F.size("base").alias("n")).collect()}
    assert len(out) == len(rows) and out[1].t == f"the [REMOVED] wrote [EMAIL] about {others}" and out[2].t.split()[4] == "[REMOVED]"
    assert out[3].t == f"someone {others} [EMAIL] once" and out[90].t == "lonely [EMAIL] hapaxword"
    assert out[None].t == "copy of [EMAIL]" and out[5].t is None and out[6].t == "" and out[12].t == f"{others} number 2"
    assert P.sanitise(df.limit(0)).count() == 0


def test_terms_are_found_in_whole_texts(spark):
    far, mail = "plain words stand here " * 30, "ann@corp.example"
    rows = [(1, f"Kim wrote {mail}. {far} and KIM left"), (2, f"{far} later kim, {mail} again"), (3, f"nobody but Kim; {far}"), (4, f"kimono {far}")]
    rows += [(10 + i, f"{far} number{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.sanitise(df, keep=("text",))
    out = {r.doc_id: r.t for r in got.select("doc_id", P.sanitised_text(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out[1] == f"[GENERALISED] wrote [EMAIL]. {far} and [GENERALISED] left" and out[2] == f"{far} later [GENERALISED], [EMAIL] again"
    assert out[3] == f"nobody but [GENERALISED]; {far}" and out[4] == rows[3][1] and out[20] == rows[14][1]


def test_a_text_of_many_hits(spark):
    text = " ".join(f"user{i}@mail{i % 9}.example.org" for i in range(50_000))
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(P.patterns(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.get("s", 49_999).alias("last")).first()
    assert got.n == 50_000 and text[got.last.start : got.last.end] == got.last.hit == "user49999@mail4.example.org"
    assert time.time() - began < 60


def brute_actions(texts, generalise=0.8, remove=0.95, support=2):
    """term -> action, from all pairs of the distinct documents."""
    docs = {}
    for text in texts:
        mails = {m[0].lower() for m in re.finditer(PLAIN[0][1], text)}
        words = frozenset(w.lower() for w in re.findall(r"\w+", re.sub(PLAIN[0][1], " ", text)))
        docs[words] = docs.get(words, set()) | mails
    df_t, df_e, co = defaultdict(int), defaultdict(int), defaultdict(int)
    for words, mails in docs.items():
        for w in words:
            df_t[w] += 1
        for e in mails:
            df_e[e] += 1
            for w in words:
                co[w, e] += 1
    out = {}
    for (w, e), n in co.items():
        if n >= support and df_e[e] < len(docs):
            share = 1 - math.log(df_t[w] / n) / math.log(len(docs) / df_e[e])
            if share >= generalise:
                out[w] = max(out.get(w, ""), "removed" if share >= remove else "generalised")
    return out


def actions_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = P.sanitise(rows).select(F.explode("spans").alias("s")).filter("s.order > 3").select("s.hit", "s.kind").distinct().collect()
    return {r.hit: r.kind for r in spans}


def test_shares_against_all_pairs(spark):
    draw = random.Random(5)
    people = [f"p{i}@mail{i % 3}.org" for i in range(12)]
    texts = []
    for _ in range(300):
        who = draw.randrange(40)
        words = [f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(draw.randrange(1, 25))]
        if who < 12:
            words += [people[who]] + [f"nick{who}"] * (draw.random() < 0.9) + [f"team{who // 3}"] * (draw.random() < 0.8)
        elif draw.random() < 0.03:
            words.append(f"nick{draw.randrange(12)}")
        texts.append(" ".join(words))
    expected = brute_actions(texts)
    assert set(expected.values()) == {"removed", "generalised"} and actions_of(spark, texts) == expected


def test_many_entities_beside_many_terms(spark):
    mails, words = " ".join(f"u{i}@list.org" for i in range(5000)), " ".join(f"term{i}" for i in range(5000))
    texts = [f"{mails} {words} one", f"{mails} {words} two"] + [f"filler text number {i}" for i in range(50)]
    began = time.time()
    assert actions_of(spark, texts) == dict.fromkeys(words.split(), "removed")
    assert time.time() - began < 120


def test_parts_of_a_document_of_many_entities(spark):
    held = spark.createDataFrame([(k, f"e{i}", 2, 9.0) for k in "ab" for i in range(30)], "key string, entity string, df_e long, most double")
    near = spark.createDataFrame([("a", "x", 2), ("b", "x", 2), ("a", "y", 3), ("b", "z", 99)], "key string, term string, df_t long")
    got = {(r.entity, r.term): r.co for r in P.co_occurrences(near, held, 7).collect()}
    assert got == {(f"e{i}", t): n for i in range(30) for t, n in (("x", 2), ("y", 1))}


def test_repeated_rows_are_scanned_each(spark):
    rows = spark.createDataFrame([(1, "a@b.co twice"), (1, "a@b.co twice"), (None, None)], "doc_id long, text string")
    assert sorted(r.n for r in P.sanitise(rows).select(F.size("spans").alias("n")).collect()) == [0, 1, 1]


def test_classes_without_a_shuffle_of_terms(spark):
    texts = [f"w{i % 700} x" for i in range(40_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, terms string").repartition(3)
    base = P.written(rows.select(F.md5("terms").cast("binary").alias("key"), "terms", F.monotonically_increasing_id().alias("row")), "test-base")
    got = P.classes_of(base)
    assert sorted(r.terms for r in got.select("terms").collect()) == sorted(set(texts))
    assert got.select("key").distinct().count() == 700 and P.classes_of(base.limit(0)).count() == 0
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
