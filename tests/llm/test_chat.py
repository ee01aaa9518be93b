import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<", "<\\", "<\\\\s>", "<|>", "<||>", "||", "|>", "[INST]", "[\\/INST]", "<<SYS>>\n", "\n<</SYS>>", "<<s>", "s>", "", " ", "é𝄞\n", "\\", "a||b", "[/INST", "<</s>", "x" * 700]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows):
    """The contract's columns but formatted_chars, from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-(2**63) if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt))
    return out


def digests(back):
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return {r[0]: tuple(r)[1:] for r in back.select("conv_id", F.size("turns"), F.sha2(spoken, 256), F.length(learnt), F.sha2(learnt, 256)).collect()}


def test_turns_come_back_whatever_they_say(spark):
    roles = ["user", "assistant", "system", "tool", None, "a|>", "<|", "|", "assistant"]
    rows = [(i % 7, i, roles[(i * 5 + j) % len(roles)], a + b) for i, (j, a, b) in enumerate((j, a, b) for a in HARD for j, b in enumerate(HARD))]
    rows += [(50, 1, "assistant", None), (50, None, "user", "first"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (None, 0, "assistant", "none"), (51, 0, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = chat.read_back(chat.render(chat.fold(chat.log_of(df, chunk=3))))
    assert digests(back) == by_hand(rows)
    assert chat.log_of(df.limit(0)).count() == 0 and chat.read_back(chat.render(chat.fold(chat.log_of(df.limit(0))))).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("<>[]/|\\sINSTY ", max_size=12), min_size=40, max_size=40))
def test_escapes_are_reversible_and_hide_marks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("safe", chat.escaped(F.col("text")))
    marks = "|".join([r"</?s>", r"\[/?INST\]", r"<</?SYS>>", r"<\|", r"\|>"])
    assert df.filter((chat.unescaped(F.col("safe")) != F.col("text")) | F.col("safe").rlike(marks)).count() == 0


def folded(events):
    """Final (role, text) of one conversation's events (seq, message, kind, role, text), one by one."""
    order = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}
    first, text, role = {}, {}, {}
    for seq, m, kind, r, x in sorted(set(events), key=lambda e: (e[0], order[e[2]], e[4] or "")):
        if m not in first:
            first[m], text[m], role[m] = seq, "", None
        role[m] = r if role[m] is None else role[m]
        if kind == "regenerate":
            for other in list(text):
                if first[m] < first[other] < seq:
                    text[other] = None
        if text[m] is not None:
            text[m] = (text[m] if kind == "delta" else "") + (x or "")
    return [(role[m] or "", text[m]) for m in sorted((m for m in text if text[m] is not None), key=lambda m: (first[m], role[m] or "", text[m]))]


def test_fold_follows_the_log(spark):
    import random

    rng, rows = random.Random(5), []
    for conv in range(60):
        events, opened, gone = [], [], set()
        for seq in range(rng.randint(1, 25)):
            live = [m for m in opened if m not in gone]
            if not live or rng.random() < 0.3:
                opened.append(f"m{seq}")
                events.append((seq, opened[-1], "open", rng.choice(["user", "assistant", None]), rng.choice(["", "hi ", None])))
            else:
                m, kind = rng.choice(live), rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
                if kind == "regenerate":
                    gone |= set(opened[opened.index(m) + 1 :])
                events.append((seq, m, kind, None, rng.choice(["a", "bc", "d ", None])))
        rows += [(conv, *e) for e in events + rng.sample(events, len(events) // 3)]
    df = spark.createDataFrame(rows, "conv_id long, seq int, message string, kind string, role string, text string")
    got = {}
    for r in sorted(chat.fold(df).collect(), key=lambda r: (r["conv_id"], r["opened"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: folded([tuple(r[1:]) for r in rows if r[0] == c]) for c in range(60)}


def test_deltas_without_an_open_and_unknown_kinds(spark):
    rows = [(1, 5, "m", "delta", None, "a"), (1, 6, "m", "ping", "assistant", "b"), (1, 6, "m", "ping", "assistant", "b"), (2, 1, "m", "edit", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, seq int, message string, kind string, role string, text string")
    assert sorted(tuple(r) for r in chat.fold(df).collect()) == [(1, 5, "assistant", "ab"), (2, 1, "", "")]


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(4000)] + [(2, 0, "assistant", "<s>word " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert digests(chat.read_back(chat.render(chat.fold(chat.log_of(df))))) == by_hand(rows)


def test_query_equals_sql(spark, tmp_path):
    rows = [(i % 9, i // 9, ["user", "assistant", "system", "tool"][i % 4], h) for i, h in enumerate(HARD * 4)] + [(3, None, None, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    got = chat.op11_chat_formatting(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.OP11_SQL)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in got._jdf.queryExecution().toString()]
