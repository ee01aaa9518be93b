"""Whole records of a case: its summary in sections, and the parts of its text with their places (2-B, 2-C)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import features

SPACE = r"[\s　]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def summary_sentences(text: Column, ends: str = "。！？；;", longest: int = 260, size: int = 240) -> Column:
    """Trimmed sentences of a text read as one line; one longer than `longest` comes in parts of `size` characters."""
    line = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    parts = F.filter(F.transform(F.split(line, f"(?<=[{ends}])"), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: T.chunks(p, longest, size)))


def cut_at_sentence(text: Column, most: int, ends: str = "。；.\n", share: float = 0.72) -> Column:
    """A text of at most `most` characters as it is; a longer one up to its last sentence end beyond that share, else cut with dots."""
    cut = F.left(text, F.lit(most))
    after = F.regexp_instr(F.reverse(cut), F.lit(f"[{ends}]")) - 1
    whole = stripped(F.left(cut, F.lit(most) - after))
    dotted = F.concat(F.regexp_replace(cut, f"{SPACE}+$", ""), F.lit("..."))
    return F.when(F.length(text) <= most, text).when((after >= 0) & (most - after - 1 > most * share), whole).otherwise(dotted)


def chosen(scored: Column, k: int, limit: int, start: int, most: int = 6) -> Column:
    """The text of section k: its `most` best sentences of those with a term, in their order; without any, of eight from `start` on."""
    hit = lambda r: r[f"hits{k}"]
    found = F.filter(scored, lambda r: hit(r) > 0)
    may = F.when(F.size(found) > 0, found).otherwise(F.slice(scored, start + 1, 8))
    ranked = F.sort_array(F.transform(may, lambda r: F.struct((hit(r) * 10 + r["own"]).alias("score"), r["i"].alias("i"), r["text"].alias("text"))), asc=False)
    ordered = F.sort_array(F.transform(F.slice(ranked, 1, most), lambda r: F.struct(r["i"].alias("i"), r["text"].alias("text"))))
    return F.trim(F.left(F.array_join(F.transform(ordered, lambda r: r["text"]), " "), F.lit(limit)))


def topped_up(head: Column, extras: Column, least: int, most: int) -> Column:
    """Of sentences in the order of their worth, those that bring `head` to `least` characters: the first that may pass `most` ends it. Last first."""
    state = F.struct(F.lit(0).alias("size"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = s["size"] + F.length(x) + F.when(F.size(s["out"]) > 0, 1).otherwise(0)
        ends = s["done"] | (F.length(head) + s["size"] + F.length(x) + 32 > most)
        more = F.struct(size.alias("size"), (F.length(head) + size >= least).alias("done"), F.concat(F.array(x), s["out"]).alias("out"))
        return F.when(ends, s.withField("done", F.lit(True))).otherwise(more)

    return F.aggregate(extras, state, step, lambda s: s["out"])


def case_summaries(df: DataFrame, text: Column, case_id: Column, title: Column, sections: list[tuple[str, list[str], int, int]], weights: list[tuple[list[str], int]],
                   least: int = 1200, most: int = 1600, opening: str = "Pre-decision factual summary:", context: str = "Project context", more: str = "Additional relevant facts", ends: str = "。！？；;") -> DataFrame:
    """df with `summary`: id, title, the first three sentences, then each section (heading, terms, limit of characters, place from
    which sentences are taken where none holds a term). Under `least` characters the best sentences not used yet are added, over
    `most` it is cut. Sections without text are left out; null texts, ids and titles are empty. An older `summary` is replaced;
    names that begin with `_` are for the steps in between."""
    body = stripped(F.coalesce(text, F.lit("")))

    def scored(x: Column, i: Column) -> Column:
        own = T.sentence_score(x, i, weights)
        return F.struct(own.alias("own"), i.alias("i"), x.alias("text"), *[T.hits(x, terms).alias(f"hits{k}") for k, (_, terms, _, _) in enumerate(sections)])

    rows = df.withColumn("_chars", F.length(body)).withColumn("_scored", F.transform(summary_sentences(body, ends), scored))
    first = F.trim(F.left(F.array_join(F.transform(F.slice("_scored", 1, 3), lambda r: r["text"]), " "), F.lit(360)))
    made = {"_part": first} | {f"_part{k}": chosen(F.col("_scored"), k, limit, start) for k, (_, _, limit, start) in enumerate(sections)}
    rows = rows.withColumns(made)
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    named = [line(name, F.col(part)) for name, part in zip([context, *[s[0] for s in sections]], made, strict=True)]
    head = F.concat_ws("\n", line("Case ID", case_id), line("Title", F.left(title, F.lit(120))), F.lit(opening), *named)
    used = F.flatten(F.array(*[summary_sentences(F.col(part), ends) for part in made]))
    rows = rows.withColumn("_head", head).withColumn("_used", used)
    unused = F.filter("_scored", lambda r: ~F.array_contains("_used", r["text"]))
    ranked = F.sort_array(F.transform(unused, lambda r: F.struct(r["own"].alias("own"), r["text"].alias("text"))), asc=False)
    # Each sentence added has a character and a blank, so no more than half of `most` can be looked at.
    extras = F.transform(F.slice(ranked, 1, most // 2 + 1), lambda r: r["text"])
    short = (F.length("_head") < least) & (F.col("_chars") > F.length("_head"))
    rows = rows.withColumn("_more", F.when(short, topped_up(F.col("_head"), extras, least, most)))
    whole = F.when(F.size("_more") > 0, F.concat("_head", F.lit(f"\n{more}: "), F.array_join("_more", " "))).otherwise(F.col("_head"))
    return rows.withColumn("summary", cut_at_sentence(whole, most)).drop("_chars", "_scored", *made, "_head", "_used", "_more")


#: How many sentences each list of a structured case holds.
LISTS = {"claims": 10, "defences": 10, "delay_events": 12, "procedure_cues": 12, "evidence_mentions": 15}


def structured_cases(df: DataFrame, facts: Column, issues: Column, reasoning: Column, decision: Column, full_text: Column, lists: dict[str, list[str]], flags: dict[str, list[str]],
                     roles: dict[str, list[str]], leakage: str, ends: str = ".!?\n") -> DataFrame:
    """df with the text before and after the decision and what is read from the former: summary, flags (has_NAME), the lists of LISTS,
    chain (a unit for each role), split_confidence, anchor_found, leakage, case_year.

    Text before the decision is facts and issues, after it reasoning and decision; what is missing is half of the full text.
    Null parts are empty; a case without any text has empty lists and a confidence of 0. Older columns of these names are
    replaced; names that begin with `_` are for the steps in between.
    """
    plain = {f"_{name}": stripped(F.coalesce(c, F.lit(""))) for name, c in (("facts", facts), ("issues", issues), ("reasoning", reasoning), ("decision", decision), ("raw", full_text))}
    rows = df.withColumns(plain)
    half = F.floor(F.length("_raw") / 2).cast("int")
    joined = lambda *parts: F.nullif(F.concat_ws("\n", *[F.nullif(F.col(p), F.lit("")) for p in parts]), F.lit(""))
    rows = rows.withColumns({
        "pre_decision_text": F.coalesce(joined("_facts", "_issues"), F.left("_raw", half)), "post_decision_text": F.coalesce(joined("_reasoning", "_decision"), F.substr(F.col("_raw"), half + 1, F.length("_raw"))),
        "split_confidence": F.when((F.col("_facts") != "") | (F.col("_issues") != ""), 0.9).when(F.col("_raw") != "", 0.55).otherwise(0.0), "anchor_found": ((F.col("_reasoning") != "") | (F.col("_decision") != "")).cast("int"),
    })
    pre, post = F.col("pre_decision_text"), F.col("post_decision_text")
    rows = rows.withColumn("_sentences", T.sentences(pre, ends))
    made = {"summary": F.left(F.array_join(F.transform(F.slice("_sentences", 1, 3), lambda s: s["text"]), " "), F.lit(500))}
    made |= {f"has_{name}": T.any_of(pre, terms) for name, terms in flags.items()} | {name: features.keyword_sentences(F.col("_sentences"), lists[name], most) for name, most in LISTS.items()}
    made |= {"chain": features.evidence_chain(F.col("_sentences"), roles), "leakage": pre.rlike(leakage).cast("int"), "case_year": T.case_year(F.coalesce(F.nullif(post, F.lit("")), F.col("_raw")))}
    return rows.withColumns(made).drop(*plain, "_sentences")
