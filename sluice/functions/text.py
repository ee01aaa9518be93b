"""Columns of cleaned, keyed, split and shortened text. All functions take and return Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<text:string,span_start:int,span_end:int>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row however often `use` has it, even within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that holds more than spaces, trimmed."""
    return F.coalesce(*[blank_null(c) for c in columns])


def one_line(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy_lines(text: Column) -> Column:
    """One kind of line end, no spaces around line ends, at most one empty line in a row."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def without_markup(html: Column) -> Column:
    """Scripts and tags out, entities of quotes and spaces resolved, white space to line ends."""
    text = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", "\n"), "&(nbsp|quot|amp);", " ")
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", "\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def plain_id(value: Column) -> Column:
    """Ids that went through a number type: "12.0" becomes "12", "nan" and null become empty."""
    as_whole = value.try_cast("double").try_cast("bigint").cast("string")
    return F.when(value.isNull() | F.lower(value).isin("nan", ""), "").otherwise(F.coalesce(as_whole, value))


def file_name(text: Column, longest: int = 40) -> Column:
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(longest))


def case_id(prefix: str, page: Column, text_hash: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), page, F.left(text_hash, F.lit(12)))


def year_between(text: Column, pattern: str, low: int, high: int) -> Column:
    """The first match's year, if it is in range."""
    year = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    return F.when(year.between(low, high), year)


def chinese_year(text: Column) -> Column:
    """A year in Chinese numerals before the character for year."""
    digits = F.regexp_extract(text, "([〇零一二三四五六七八九○]{4})年", 1)
    return F.nullif(F.translate(digits, "〇零○一二三四五六七八九", "000123456789"), F.lit("")).try_cast("int")


def case_year(text: Column, low: int = 1990, high: int = 2035) -> Column:
    named = chinese_year(text)
    return F.coalesce(year_between(text, r"(20\d{2})", low, high), F.when(named.between(low, high), named))


def first_year(text: Column, chars: int = 2500, low: int = 1900, high: int = 2026) -> Column:
    """Of all four-digit numbers in the first characters the first one in range."""
    years = F.transform(F.regexp_extract_all(F.left(text, F.lit(chars)), F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(low, high)), 0)


def count_matching(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def pieces(text: Column, ends: str = ".!?\n") -> Column:
    """Sentences with their terminator, untrimmed."""
    escaped = "".join("\\" + c if c in ".?!" else c for c in ends)
    return F.split(text, f"(?<=[{escaped}])")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often `use` has it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(sizes: Column, start: Column) -> Column:
    """Where each of consecutive parts begins; the array grows by one at each step, so for short arrays only."""
    state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def offsets(sizes: Column, block: int = 128) -> Column:
    """Where each of consecutive parts begins, from their sizes: block by block, so that long arrays take time in proportion."""

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / block).cast("int")), lambda k: F.slice(all_, k * block + 1, F.lit(block)))
        return once(parts, lambda ps: F.flatten(F.zip_with(ps, running(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y)), F.lit(0)), running)))

    return once(sizes, lambda x: F.when(F.size(x) <= block, running(x, F.lit(0))).otherwise(whole(x)))


def sentences(text: Column, ends: str = ".!?\n") -> Column:
    """Trimmed sentences with start and end offsets in the text, as array<struct<text, span_start, span_end>>."""

    def placed(piece: Column, at: Column) -> Column:
        left = F.regexp_replace(piece, r"^\s+", "")
        begin, body = at + F.length(piece) - F.length(left), F.regexp_replace(left, r"\s+$", "")
        return F.struct(body.alias("text"), begin.alias("span_start"), (begin + F.length(body)).alias("span_end"))

    found = once(pieces(text, ends), lambda ps: F.zip_with(ps, offsets(F.transform(ps, F.length)), placed))
    return F.filter(found, lambda s: F.length(s["text"]) > 0).cast(SPAN)


def short_sentences(text: Column, least: int = 6, ends: str = ".!?\n") -> Column:
    """Trimmed sentences without terminator, of at least so many characters."""
    parts = F.transform(F.split(text, f"[{ends.replace('.', chr(92) + '.').replace('?', chr(92) + '?')}]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= least)


def chunks(sentence: Column, longest: int = 260, size: int = 240) -> Column:
    """A sentence, or parts of a fixed size where it is too long."""
    cuts = F.sequence(F.lit(0), F.floor((F.length(sentence) - 1) / size).cast("int"))
    return F.when(F.length(sentence) > longest, F.transform(cuts, lambda k: F.substr(sentence, k * size + 1, F.lit(size)))).otherwise(F.array(sentence))


def earliest(text: Column, anchors: list[str]) -> Column:
    """0-based place of the first anchor of any kind, null without one."""
    places = F.filter(F.array(*[F.instr(text, a) for a in anchors]), lambda p: p > 0)
    return F.array_min(places) - 1


def split_at_anchor(text: Column, anchors: list[str], share: float = 0.72, sure: float = 0.9, unsure: float = 0.45) -> Column:
    """pre, post, confidence: at the earliest anchor, else at a share of the text."""
    at = earliest(text, anchors)
    cut = F.coalesce(at, F.floor(F.length(text) * share).cast("int"))
    return F.struct(F.substr(text, F.lit(1), cut).alias("pre"), F.substr(text, cut + 1, F.length(text)).alias("post"), F.when(at.isNull(), unsure).otherwise(sure).alias("confidence"))


def sections(text: Column, headings: dict[str, str]) -> Column:
    """Places (0-based) of each heading's first match, as sorted array<struct<at, name>>; fewer than two give an empty array."""
    found = F.array(*[F.struct((F.instr(text, h) - 1).alias("at"), F.lit(name).alias("name")) for name, h in headings.items()])
    found = F.array_sort(F.filter(found, lambda s: s["at"] >= 0))
    return F.when(F.size(found) >= 2, found).otherwise(F.filter(found, lambda s: F.lit(False)))


def section_text(text: Column, found: Column, name: str) -> Column:
    """From a section's heading to the next one or the end; null without that section."""
    own = F.get(F.filter(found, lambda s: s["name"] == name), 0)["at"]
    after = F.array_min(F.transform(F.filter(found, lambda s: s["at"] > own), lambda s: s["at"]))
    return F.substr(text, own + 1, F.coalesce(after, F.length(text)) - own)


def compact(text: Column, budget: int, head_share: float, tail_share: float, terms: list[str], ends: str = ".!?\n") -> Column:
    """Within a budget of characters: the head, then sentences of the rest that hold a term until their lengths pass the
    tail's share (the sentence that passes it is kept), cut to the budget. Shorter texts stay as they are."""
    head = int(budget * head_share)
    rest = F.filter(pieces(F.substr(text, F.lit(head + 1), F.length(text)), ends), lambda p: any_of(p, terms))
    limit = int(budget * tail_share)
    state = F.struct(F.lit(0).alias("size"), F.lit("").alias("out"))
    kept = F.aggregate(rest, state, lambda s, p: F.when(s["size"] < limit, F.struct((s["size"] + F.length(p)).alias("size"), F.concat(s["out"], p).alias("out"))).otherwise(s), lambda s: s["out"])
    return F.when(F.length(text) <= budget, text).otherwise(F.left(F.concat(F.left(text, F.lit(head)), F.lit("\n"), kept), F.lit(budget)))


def window(text: Column, at: Column, before: int, after: int) -> Column:
    """Characters around a 0-based place; empty without one."""
    begin = F.greatest(at - before, F.lit(0))
    return F.when(at.isNull(), "").otherwise(F.substr(text, begin + 1, at + after - begin))


def marker_windows(text: Column, head: int, tail: int, markers: list[str], before: int, after: int) -> Column:
    """Head, surroundings of the first marker, tail; texts that fit are left alone."""
    near = window(text, earliest(text, markers), before, after)
    parts = F.array(F.left(text, F.lit(head)), near, F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= head + tail, text).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), "\n...\n"))


def snippet(text: Column, terms: list[str], before: int, after: int, fallback: int) -> Column:
    """Surroundings of the first term of a priority list that occurs; else the beginning."""
    at = F.coalesce(*[F.nullif(F.instr(text, t), F.lit(0)) for t in terms]) - 1
    return F.when(at.isNull(), F.left(text, F.lit(fallback))).otherwise(window(text, at, before, after))


def whole_sentences(text: Column, limit: int, share: float = 0.72, ends: str = ".!?") -> Column:
    """Cut to a limit, at the last sentence end if that lies beyond a share of it."""
    cut = F.left(text, F.lit(limit))
    last = limit - F.regexp_instr(F.reverse(cut), F.lit(f"[{ends}]")) + 1
    has = F.regexp_instr(F.reverse(cut), F.lit(f"[{ends}]")) > 0
    return F.when(F.length(text) <= limit, text).otherwise(F.when(has & (last > limit * share), F.substr(cut, F.lit(1), last)).otherwise(cut))


def distinct_matches(text: Column, pattern: str, most: int) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def labelled(text: Column, header: str) -> Column:
    """What follows "header:" on its line."""
    return F.trim(F.regexp_extract(text, f"(?m)^{header}:[ ]*(.*)$", 1))


def any_of(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def found_terms(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def occurrences(text: Column, terms: list[str]) -> Column:
    """How often the terms occur, summed."""
    each = [F.floor((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)) for t in terms]
    return sum(each[1:], each[0]).cast("bigint")


def glossary(text: Column, entries: list[tuple[str, str]], most: int) -> Column:
    """Targets of the source terms that occur, in the glossary's order, each once."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in entries])
    return F.slice(F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(text, p["a"])), lambda p: p["b"])), 1, most)


def sentence_score(sentence: Column, index: Column, weights: list[tuple[list[str], int]]) -> Column:
    """Weighted numbers of terms that occur, 2 more for one of the first six sentences and 1 for 35 to 220 characters."""
    length = F.length(sentence)
    place = F.when(index < 6, 2).otherwise(0) + F.when((length >= 35) & (length <= 220), 1).otherwise(0)
    return sum((hits(sentence, terms) * w for terms, w in weights), place)


def section_of(sentences: Column, terms: list[str], weights: list[tuple[list[str], int]], limit: int, start: int = 0, most: int = 6) -> Column:
    """The best sentences that hold a term, in their own order and cut to `limit` characters; where none does, the best of eight from `start` on."""

    def scored(x: Column, i: Column) -> Column:
        own, found = sentence_score(x, i, weights), hits(x, terms)
        return F.struct((F.when(found > 0, found * 10).otherwise(0) + own).alias("score"), i.alias("i"), x.alias("text"), (found > 0).alias("hit"))

    def best(rows: Column) -> Column:
        any_hit = F.exists(rows, lambda r: r["hit"])
        may = F.filter(rows, lambda r: F.when(any_hit, r["hit"]).otherwise((r["i"] >= start) & (r["i"] < start + 8)))
        top = F.slice(F.sort_array(may, asc=False), 1, most)
        ordered = F.sort_array(F.transform(top, lambda r: F.struct(r["i"].alias("i"), r["text"].alias("text"))))
        return F.trim(F.left(F.array_join(F.transform(ordered, lambda r: r["text"]), " "), F.lit(limit)))

    return once(F.transform(sentences, scored), best)


def abstracted(text: Column, rules: list[tuple[str, str, str]], limits: dict[str, int], defaults: dict[str, str], joined: str = "; ") -> Column:
    """struct with a sentence list in one string for each section: those whose pattern the text has, in the rules' order, each once, at most the section's limit; else its default.

    rules: section, pattern, sentence; `{0}` in a sentence stands for the pattern's matches, different ones in order, at most three.
    """
    made = []
    for section, limit in limits.items():
        found = []
        for _, pattern, sentence in [r for r in rules if r[0] == section]:
            before, filled, after = sentence.partition("{0}")
            values = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), 1, 3), ", ")
            found.append(F.when(text.rlike(pattern), F.concat(F.lit(before), values, F.lit(after)) if filled else F.lit(sentence)))
        there = F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, limit)
        made.append(F.coalesce(F.nullif(F.array_join(there, joined), F.lit("")), F.lit(defaults[section])).alias(section))
    return F.struct(*made)
