"""Chat logs folded into their final messages and rendered with a loss mask (operator 11). DataFrame functions only.

A log has a row for each event: conv_id, seq (any type with an order), message (what tells the messages of
a conversation apart), kind, role, text. `open` begins a message, `delta` appends to it, `edit` puts its text
in place of all so far, and `regenerate` begins it anew and drops every message opened after it until
then. Events are folded in order of seq by message first, on all tasks, and messages by conversation after
that, so that the deltas of a long conversation are not gathered in one task; its text is, since it is one row.

A turn is its role's opening mark, the text, the closing mark. Where a text has one of the marks, a backslash
goes behind the mark's first character, and one more where there are some already, so that no text can
close its turn and every text can be read back; texts without marks stay as they are. The loss mask has the
start and end (code points) of each assistant text.

Defined cases: a null text is empty, a null role the empty role; events of one seq go open, regenerate,
edit, delta, then by text; an event that is there twice counts once; a message without `open` begins
with its first event and has the first role that its events name; an unknown kind is a delta; messages of
one seq go by role, then text; a null conv_id is a conversation too; an empty log gives no rows; further
columns are not read. In `log_of` repeated rows are turns each for itself, and a null turn comes first.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import offsets
from .common import picked, table, written
from .spans import let

#: Marks around a turn by its role; other roles are named within their marks.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|", "|>", "<||>")
#: Each mark's first character, and what may follow it.
HEADS = ((r"<", r"(?:/?s>|</?SYS>>|\|)"), (r"\[", r"/?INST\]"), (r"\|", r">"))
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>|\[INST\] .*? \[/INST\]|<s>.*?</s>|<\|.*?\|>.*?<\|\|>"
KINDS = ("open", "regenerate", "edit", "delta")
EVENT = ("conv_id", "seq", "message", "kind", "role", "text")


def escaped(text: Column) -> Column:
    heads = "|".join(rf"{head}(?=\\*+{rest})" for head, rest in HEADS)
    return F.regexp_replace(text, f"({heads})", r"$1\\")


def unescaped(text: Column) -> Column:
    heads = "|".join(rf"({head})\\(?=\\*+{rest})" for head, rest in HEADS)
    return F.regexp_replace(text, heads, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, opened, role, text of the messages that remain. events: the columns of EVENT."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)], F.lit(3))
    rows = picked(events, *EVENT).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rank", rank)
    made = rows.groupBy("conv_id", "message").agg(
        F.min("seq").alias("opened"), F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "rank", "role")))["role"].alias("role"), F.sort_array(F.collect_set(F.struct("seq", "rank", "text"))).alias("log")
    )
    # From the last event on that sets the text; all deltas where none does.
    since = F.array_max(F.transform(F.filter("log", lambda e: e["rank"] < 3), lambda e: F.struct(e["seq"].alias("seq"), e["rank"].alias("rank"))))
    text = let(since, lambda last: F.array_join(F.transform(F.filter("log", lambda e: last.isNull() | (F.struct(e["seq"].alias("seq"), e["rank"].alias("rank")) >= last)), lambda e: e["text"]), ""))
    again = F.transform(F.filter("log", lambda e: e["rank"] == 1), lambda e: e["seq"])
    made = made.select("conv_id", "opened", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), again.alias("again"))
    return _remaining(made).select("conv_id", "opened", "role", "text")


def _remaining(made: DataFrame) -> DataFrame:
    """Messages but those opened between an earlier message and its regeneration: a running minimum, from the last event back."""
    own = F.array(F.struct(F.col("opened").alias("at"), F.lit(None).cast(made.schema["opened"].dataType).alias("begun"), F.lit(True).alias("own")))
    more = F.transform("again", lambda s: F.struct(s.alias("at"), F.col("opened").alias("begun"), F.lit(False).alias("own")))
    rows = made.withColumn("e", F.explode(F.concat(own, more))).select("conv_id", "opened", "role", F.when(F.col("e.own"), F.col("text")).alias("text"), "e.*")
    back = Window.partitionBy("conv_id").orderBy(F.desc("at"), F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.min("begun").over(back)
    return rows.withColumn("least", least).filter(F.col("own") & (F.col("least").isNull() | (F.col("least") >= F.col("opened"))))


def marks(role: Column) -> tuple[Column, Column]:
    opening, closing = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (before, after) in MARKS.items():
        opening, closing = F.when(role == name, before).otherwise(opening), F.when(role == name, after).otherwise(closing)
    return opening, closing


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss (array of start, end). messages: of fold(); learn: roles under the loss mask."""
    opening, closing = marks(F.col("role"))
    turns = messages.select("conv_id", "opened", "role", F.col("text"), opening.alias("before"), escaped(F.col("text")).alias("body"), closing.alias("after"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("opened", "role", "text", "before", "body", "after"))).alias("turns"))
    size = lambda t: F.length(t["before"]) + F.length(t["body"]) + F.length(t["after"])
    span = lambda t, at: F.struct((at + F.length(t["before"])).alias("start"), (at + F.length(t["before"]) + F.length(t["body"])).alias("end"), t["role"].isin(*learn).alias("learn"))
    spans = F.filter(F.zip_with("turns", offsets(F.transform("turns", size)), span), lambda s: s["learn"])
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["body"], t["after"])), "")
    return rows.select("conv_id", formatted.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"))


def _parsed(piece: Column) -> Column:
    """role, text of a turn as it stands in a formatted text."""
    cut = lambda before, after: F.substr(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))
    role, text = unescaped(F.regexp_extract(piece, r"(?s)^<\|(.*?)\|>", 1)), F.regexp_extract(piece, r"(?s)^<\|.*?\|>(.*)<\|\|>$", 1)
    for name, (before, after) in MARKS.items():
        role, text = F.when(piece.startswith(before), name).otherwise(role), F.when(piece.startswith(before), cut(before, after)).otherwise(text)
    return F.struct(role.alias("role"), unescaped(text).alias("text"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), learnt (the unescaped texts under the mask), formatted: from formatted texts and masks alone."""
    rows = rendered.select("conv_id", "formatted", "loss", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)).alias("pieces"))
    rows = rows.withColumn("placed", F.zip_with("pieces", offsets(F.transform("pieces", F.length)), lambda p, at: F.struct(p.alias("piece"), at.alias("at"))))
    # A span lies within one turn, so the turns that the mask meets go with its spans in order.
    starts = F.transform("loss", lambda s: s["start"])
    learnt = let(F.array_sort(F.concat(F.transform("placed", lambda p: F.struct(p["at"].alias("at"), F.lit(0).alias("is_span"), F.lit(0).alias("end"), p["piece"].alias("piece"))), F.zip_with("loss", starts, lambda s, at: F.struct(at.alias("at"), F.lit(1).alias("is_span"), s["end"].alias("end"), F.lit("").alias("piece"))))), _masked)
    return rows.select("conv_id", "formatted", F.transform("pieces", _parsed).alias("turns"), learnt.alias("learnt"))


def _masked(events: Column) -> Column:
    """Spans and turns in one order: the text of each span, cut from the turn right before it."""
    shifted = F.concat(F.array(F.get(events, 0)), F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0))))
    both = F.zip_with(events, shifted, lambda e, last: F.struct(e.alias("e"), last.alias("last")))
    return F.transform(F.filter(both, lambda x: x["e"]["is_span"] == 1), lambda x: unescaped(F.substr(x["last"]["piece"], x["e"]["at"] - x["last"]["at"] + 1, x["e"]["end"] - x["e"]["at"])))


def log_of(rows: DataFrame, chunk: int = 256) -> DataFrame:
    """The log that a table of turns (conv_id, turn, role, text) would have left: each text streamed in deltas of `chunk` code points."""
    turns = picked(rows, "conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    turns = turns.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    message = F.struct("turn", "role", F.md5("text").alias("digest"), "copy")
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0))
    event = lambda step, kind, text: F.struct(step.alias("step"), kind.alias("kind"), text.alias("text"))
    events = F.concat(F.array(event(F.lit(0), F.lit("open"), F.lit(""))), F.transform(parts, lambda p, i: event(i + 1, F.lit("delta"), p)))
    rows = turns.select("conv_id", "turn", message.alias("message"), "role", F.explode(events).alias("e"))
    return rows.select("conv_id", F.struct("turn", "e.step").alias("seq"), "message", "e.kind", F.when(F.col("e.step") == 0, F.col("role")).alias("role"), "e.text")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of marks, formatted and read back: digests of turns and of what is learnt."""
    marked = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(marked)
    back = read_back(written(render(fold(log_of(turns))), "chat"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Escapes in three passes, since RE2 has no lookahead; the passes meet different first characters.
_ESC = r"""regexp_replace(regexp_replace(regexp_replace({0}, '<(\\*(/?s>|</?SYS>>|\|))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g'), '\|(\\*>)', '|\\\1', 'g')"""
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
s AS (SELECT *, CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 8 + length({_ESC.format("role")}) END + length({_ESC.format("text")}) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
