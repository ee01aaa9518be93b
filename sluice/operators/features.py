"""Features of documents from lexicons and spans (2-C)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = "struct<role:string,text:string,span_start:int,span_end:int,pre_decision:int,duplicate:int>"


def keyword_sentences(sentences: Column, terms: list[str], most: int) -> Column:
    return F.slice(F.filter(sentences, lambda s: T.any_of(s["text"], terms)), 1, most)


def evidence_chain(sentences: Column, roles: dict[str, list[str]]) -> Column:
    """One unit for each role: its first sentence with a role's term, or an empty unit with places -1.

    duplicate is 1 where an earlier role took a sentence of the same text.
    """

    def unit(all_: Column, role: str, terms: list[str]) -> Column:
        def filled(hit: Column) -> Column:
            place = lambda field: F.coalesce(hit[field], F.lit(-1)).alias(field)
            return F.struct(F.lit(role).alias("role"), F.coalesce(hit["text"], F.lit("")).alias("text"), place("span_start"), place("span_end"), hit["text"].isNotNull().cast("int").alias("pre_decision"))

        return T.let(F.get(F.filter(all_, lambda s: T.any_of(s["text"], terms)), 0), filled)

    def marked(units: Column) -> Column:
        repeated = lambda u, i: (u["text"] != "") & F.exists(F.slice(units, 1, i), lambda e: e["text"] == u["text"])
        return F.transform(units, lambda u, i: u.withField("duplicate", F.when(i == 0, 0).otherwise(repeated(u, i).cast("int"))))

    return T.let(T.let(sentences, lambda all_: F.array(*[unit(all_, r, t) for r, t in roles.items()])), marked)


def chain_metrics(chain: Column) -> Column:
    """valid, pre_decision, duplicate, coverage and missing rates; an empty chain has 0, 0, 0, 0, 1."""
    n, filled = F.size(chain), lambda u: F.trim(u["text"]) != ""
    rate = lambda keep: F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(chain, keep)) / n)
    coverage = rate(filled)
    return F.struct(rate(lambda u: (u["span_start"] >= 0) & filled(u)).alias("valid"), rate(lambda u: (u["pre_decision"] == 1) & filled(u)).alias("pre_decision"), rate(lambda u: u["duplicate"] == 1).alias("duplicate"), coverage.alias("coverage"), (1 - coverage).alias("missing"))


def sufficiency(coverage: Column, procedures: Column, evidence: Column, claims: Column) -> Column:
    score = 0.45 * coverage + 0.15 * F.least(procedures / 5, F.lit(1.0)) + 0.2 * F.least(evidence / 5, F.lit(1.0)) + 0.2 * F.least(claims / 6, F.lit(1.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def local_quality(text: Column, groups: list[tuple[list[str], int, int, float]], title: Column, penalty: Column) -> Column:
    """Weighted hits of term groups, each (terms, characters that are looked at, most hits, weight), plus title, minus penalty, in [0, 1]."""
    parts = [F.least(T.hits(F.left(text, F.lit(chars)), terms), F.lit(most)) * weight for terms, chars, most, weight in groups]
    score = sum(parts[1:], parts[0]) + F.when(title, 0.1).otherwise(0.0) - F.when(penalty, 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def relevance(core: Column, topic: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.15 * F.least(core, F.lit(4)) + 0.18 * F.least(topic, F.lit(4)) + F.when((core > 0) & (topic > 0), 0.2).otherwise(0.0)), 6)


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The class of the first rule of which a term occurs."""
    return F.coalesce(*[F.when(T.any_of(text, terms), name) for name, terms in rules], F.lit(default))


def most_hits(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The class with the most terms that occur, ties to the earlier one: struct<label, hits>."""
    scored = F.array(*[F.struct(T.hits(text, terms).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("label")) for i, (name, terms) in enumerate(rules)])
    best = F.array_max(scored)
    return F.struct(F.when(best["hits"] > 0, best["label"]).otherwise(default).alias("label"), best["hits"].alias("hits"))


def role_summary(sentences: Column, terms: list[str], default: str, most: int = 3) -> Column:
    found = F.array_join(F.transform(keyword_sentences(sentences, terms, most), lambda s: s["text"]), " ")
    return F.when(found == "", default).otherwise(found)


def by_mode(mode: str, pre: Column, post: Column) -> Column:
    return {"pre_decision_only": pre, "post_decision_only": post}.get(mode, F.concat_ws("\n", pre, post))


def numbers(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def mechanism_indices(text: Column, groups: dict[str, tuple[list[str], float]]) -> list[Column]:
    """For each group (terms, divisor) how many of its terms the text has, over the divisor, held in [0, 1], 4 digits."""
    return [F.round(F.least(F.lit(1.0), T.hits(text, terms) / by), 4).alias(name) for name, (terms, by) in groups.items()]


def numeric_features(events: Column, cues: Column, mentions: Column, claims: Column, defences: Column, pre: Column, chain: Column, leakage: Column) -> list[Column]:
    """Ten numbers of a case: five list lengths, the text's length, the chain's coverage and missing rate, its sufficiency, a leakage flag. Null lists are empty."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("double")
    rates = chain_metrics(chain)
    return [
        size(events).alias("delay_event_count"), size(cues).alias("procedure_cue_count"), size(mentions).alias("evidence_mention_count"), size(claims).alias("claim_count"), size(defences).alias("defense_count"), F.length(F.coalesce(pre, F.lit(""))).cast("double").alias("pre_text_length"),
        F.round(rates["coverage"], 6).alias("role_coverage_rate"), F.round(rates["missing"], 6).alias("missing_role_rate"), sufficiency(rates["coverage"], size(cues), size(mentions), size(claims)).alias("evidence_sufficiency"), leakage.cast("double").alias("potential_leakage_flag"),
    ]


def record_checks(record: Column, label: Column, key: str, headers: list[str], required: int, risk: list[str], labels: tuple[str, ...]) -> list[Column]:
    """What a record of "Header: text" lines lacks, as columns; the first `required` headers must have text. A null record is empty, a null label invalid."""
    text = F.coalesce(record, F.lit(""))
    own = {h: T.labelled(text, h) for h in headers}
    body = F.concat_ws("\n", *own.values())
    missing = F.filter(F.array(*[F.when(own[h] == "", h) for h in headers[:required]]), lambda x: x.isNotNull())
    case, valid, terms = T.labelled(text, key), F.coalesce(label.isin(*labels), F.lit(False)), T.found_terms(body, risk)
    return [
        case.alias("case_id"), (case == "").alias("case_id_missing"), (F.trim(text) != "").alias("record_present"), valid.alias("label_valid"),
        F.size(missing).alias("missing_field_count"), F.array_join(missing, "|").alias("missing_fields"), (F.size(terms) > 0).alias("post_decision_risk"), F.array_join(terms, "|").alias("post_decision_terms"),
        F.length(body).alias("summary_chars"), T.count_matching(body, "\u4e00-\u9fff").alias("summary_chinese_chars"), F.length(text).alias("record_chars"), ((F.trim(text) != "") & (case != "") & valid).alias("field_parse_ok"),
    ]
