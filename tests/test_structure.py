"""Defined results of summaries, structured cases and grades of labels for nulls, empty texts, long texts and clashing names."""

from pyspark.sql import functions as F

from sluice.operators import features, labels, summaries

C = F.col
PARTS = [("Claims", ["claim"], 60, 0), ("Delay", ["late"], 60, 1)]
WEIGHTS = [(["late"], 4), (["claim"], 3)]


def summaries_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "id string, text string, title string, made int")
    made = summaries.case_summaries(df, C("text"), C("id"), C("title"), PARTS, WEIGHTS, opening="Facts:", ends=".", **how)
    assert made.columns == [*df.columns, "summary"]
    return [r.summary for r in made.orderBy("made").collect()]


def test_summary(spark):
    text = "The works began. They were late. A claim was made. Rain fell. The claim was late. Nobody paid."
    got = summaries_of(spark, [("7", text, "T", 0), (None, None, None, 1), ("", " \n ", "", 2)], least=60, most=400)
    context = "Project context: The works began. They were late. A claim was made."
    assert got[0] == f"Case ID: 7\nTitle: T\nFacts:\n{context}\nClaims: A claim was made. The claim was late.\nDelay: They were late. The claim was late."
    assert got[1:] == ["Facts:", "Facts:"]


def test_summary_is_topped_up_by_worth_and_cut(spark):
    text = "The works began. They were late. A claim was made. " + "".join(f"Sentence number {i} of the rest is here. " for i in range(20))
    (topped,) = summaries_of(spark, [("7", text, "", 0)], least=260, most=400)
    head, more = topped.split("\nAdditional relevant facts: ")
    added = more.split(". ")
    # Of equal worth the greater sentence is taken first and stands last; the first six sentences of a text are worth more.
    assert [a[16:18].strip() for a in added] == ["9", "0", "1", "2"] and 260 <= len(head) + len(more) < 400
    (cut,) = summaries_of(spark, [("7", text, "", 0)], least=10, most=100)
    assert cut.endswith(".") and len(cut) <= 100 and head.startswith(cut[:-1])
    (dotted,) = summaries_of(spark, [("7", "word " * 100, "", 0)], least=10, most=50)
    assert dotted == "Case ID: 7\nFacts:\nProject context: word word word..."


def test_long_sentences_come_in_parts(spark):
    got = spark.createDataFrame([("x" * 261 + "。 y；z　",), (None,), ("",)], "t string").select(summaries.summary_sentences(C("t")).alias("s")).collect()
    assert [list(map(len, r.s)) if r.s is not None else None for r in got] == [[240, 22, 2, 1], None, []]


def structured(spark, rows):
    df = spark.createDataFrame(rows, "facts string, issues string, reasoning string, raw string, made int")
    lists = dict.fromkeys(summaries.LISTS, ["late"])
    made = summaries.structured_cases(df, C("facts"), C("issues"), C("reasoning"), F.lit(None), C("raw"), lists, {"works": ["works"]}, {"cause": ["late"], "impact": ["late"]}, "granted")
    return made.select("*", *features.numeric_features(*[C(c) for c in ("delay_events", "procedure_cues", "evidence_mentions", "claims", "defences", "pre_decision_text", "chain", "leakage")])).orderBy("made").collect()


def test_structured_case(spark):
    rows = [("　The works. ", "Late? It was late.", "Granted in 2019.", "raw", 0), (None, None, None, "ab granted cd 2031 late", 1), (None, "", " ", None, 2)]
    parts, halves, empty = structured(spark, rows)
    assert parts.pre_decision_text == "The works.\nLate? It was late." and parts.post_decision_text == "Granted in 2019." and (parts.split_confidence, parts.anchor_found, parts.case_year) == (0.9, 1, 2019)
    assert parts.has_works and [(s.text, parts.pre_decision_text[s.span_start : s.span_end]) for s in parts.claims] == [("It was late.", "It was late.")]
    assert [(u.role, u.text, u.duplicate) for u in parts.chain] == [("cause", "It was late.", 0), ("impact", "It was late.", 1)]
    assert halves.pre_decision_text + halves.post_decision_text == rows[1][3] and halves.leakage == 1 and (halves.split_confidence, halves.anchor_found, halves.case_year) == (0.55, 0, 2031)
    assert (empty.pre_decision_text, empty.summary, empty.claims, empty.split_confidence, empty.case_year) == ("", "", [], 0.0, None)
    assert empty.missing_role_rate == 1.0 and empty.claim_count == 0.0 and empty.evidence_sufficiency == 0.0


def test_lists_are_bounded(spark):
    (row,) = structured(spark, [("late. " * 40, None, None, None, 0)])
    assert {name: len(row[name]) for name in summaries.LISTS} == summaries.LISTS


def test_grades_of_labels(spark):
    df = spark.createDataFrame([("support", 0.9, 0, None), ("not_support", 0.1, 0, "the claim is REJECTED: not_support"), ("partial", 0.1, 0, "部分支持"), ("support", 0.9, None, "support"), ("odd", 1.0, 0, "odd"), (None, None, None, None)], "label string, conf double, review int, reply string")
    got = [tuple(r) for r in df.select(labels.label_consistency(C("label"), C("conf"), C("review"), C("reply")), labels.extractability_score(C("label"), C("reply"), F.lit(None), ["支持"])).collect()]
    assert got == [(1, 0.45), (1, 0.45), (1, 0.7), (0, 0.45), (0, 0.0), (0, 0.0)]
