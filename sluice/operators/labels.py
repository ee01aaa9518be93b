"""Labels: normalisation, derivation, parsing and gating of response records (2-D)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Ties go to the first label.
OUTCOMES = ("support", "partial", "not_support")
#: Spellings of outcomes, and substrings that decide where no spelling fits, in order.
EXACT = {"support": "support", "partial": "partial", "partial_support": "partial", "partially_support": "partial", "not_support": "not_support", "not-support": "not_support", "notsupport": "not_support", "支持": "support", "部分支持": "partial", "不支持": "not_support", "驳回": "not_support"}
CONTAINED = (("部分", "partial"), ("不予", "not_support"), ("驳回", "not_support"), ("支持", "support"), ("partial", "partial"), ("not", "not_support"), ("support", "support"))


def outcome(value: Column, exact: dict[str, str] = EXACT, contained: tuple = (), default: str = "unknown") -> Column:
    """A label's plain name: by its spelling, else by what it contains, else the default."""
    key = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), *[F.when(F.contains(key, F.lit(part)), label) for part, label in contained], F.lit(default))


def clamp(value: Column, default: float = 0.0) -> Column:
    """A number held in [0, 1], 6 digits; the default where it is none."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 6))


def model_json(reply: Column) -> Column:
    """The outermost braces of a reply, without code fences; null without any."""
    bare = F.regexp_replace(reply, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def span_checks(pre: Column, spans: Column) -> Column:
    """For each quoted span its place in the text (or -1), whether it is there, and whether an earlier one is the same."""
    return F.transform(spans, lambda s, i: F.struct(s.alias("text"), F.when(F.length(s) > 0, F.instr(pre, s) - 1).otherwise(-1).alias("start"), ((F.length(s) > 0) & (F.instr(pre, s) > 0)).cast("int").alias("valid"), (i > F.array_position(spans, s) - 1).cast("int").alias("duplicate")))


def folded(value: Column, groups: dict[str, list[str]], default: str) -> Column:
    return F.coalesce(*[F.when(value.isin(*members), name) for name, members in groups.items()], F.lit(default))


def by_patterns(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    return F.coalesce(*[F.when(text.rlike(p), label) for label, p in patterns], F.lit(default))


def bucket(rules: list[tuple[str, Column]], default: str) -> Column:
    """The first rule that holds names the bucket."""
    return F.coalesce(*[F.when(cond, name) for name, cond in rules], F.lit(default))


def agreement(sources: list[Column]) -> Column:
    """How many sources give the label that most of them give, and whether known ones differ: struct<agree, conflict>."""
    known = F.filter(F.array(*sources), lambda x: x.isNotNull() & (x != "unknown"))
    votes = F.transform(F.array_distinct(known), lambda x: F.size(F.filter(known, lambda y: y == x)))
    return F.struct(F.coalesce(F.array_max(votes), F.lit(0)).alias("agree"), (F.size(F.array_distinct(known)) > 1).cast("int").alias("conflict"))


def aligned(requests: DataFrame, replies: DataFrame, key: str, status: str = "parse_missing_case") -> DataFrame:
    """Every requested row with its reply's fields; rows without one carry the given status."""
    return requests.join(replies, key, "left").withColumn("status", F.coalesce("status", F.lit(status)))


def merged(model: dict[str, Column], local: dict[str, Column]) -> list[Column]:
    """Model fields over local ones, one by one, and how many came from the model."""
    fields = [F.coalesce(T.blank_null(model[k]) if k in model else F.lit(None), local[k]).alias(k) for k in local]
    return [*fields, sum((T.blank_null(c).isNotNull().cast("int") for c in model.values()), F.lit(0)).alias("from_model")]


def new_label_score(relevance: Column, substantive: Column, confidence: Column, extractable: Column, conflict: Column, review: Column, coverage: Column) -> Column:
    """Seven terms: how far a new label of a case can be relied on."""
    terms = ((0.20, relevance), (0.18, substantive), (0.18, confidence), (0.18, extractable), (0.10, 1 - conflict), (0.08, 1 - review), (0.08, coverage))
    return sum((w * c for w, c in terms), F.lit(0.0))


def new_label_bucket(label: Column, frozen: Column, relevance: Column, substantive: Column, procedural: Column, confidence: Column, conflict: Column, review: Column, pre_length: Column, min_confidence: float = 0.9, min_pre: int = 500) -> Column:
    """frozen_test, strong_label_train_candidate, weak_label_candidate or discarded."""
    known = F.coalesce(label.isin(*OUTCOMES), F.lit(False))
    strong = known & (confidence >= min_confidence) & (conflict == 0) & (review == 0) & (relevance >= 0.8) & (substantive == 1) & (procedural == 0) & (pre_length >= min_pre)
    return bucket([("frozen_test", frozen), ("strong_label_train_candidate", strong), ("weak_label_candidate", known & (relevance >= 0.65))], "discarded")


def existing_label_score(relevance: Column, substantive: Column, confidence: Column, extractable: Column, consistent: Column, coverage: Column, valid_spans: Column, pre_length: Column) -> Column:
    """Eight terms: how far a label that is there already can be relied on."""
    one = lambda c: F.least(c, F.lit(1.0))
    terms = ((0.18, relevance), (0.15, substantive), (0.14, one(confidence)), (0.15, extractable), (0.12, consistent), (0.10, one(coverage)), (0.06, one(valid_spans)), (0.10, one(pre_length / 3000)))
    return sum((w * c for w, c in terms), F.lit(0.0))


def existing_label_bucket(score: Column, label: Column, frozen: Column, duplicate: Column, status: Column, relevance: Column, substantive: Column, procedural: Column, confidence: Column, review: Column, extractable: Column, pre_length: Column, min_confidence: float = 0.85, min_pre: int = 500) -> Column:
    """struct<bucket, reason>: the first rule that holds; reason is empty where no hard rule does."""
    known = F.coalesce(label.isin(*OUTCOMES), F.lit(False))
    strong = (confidence >= min_confidence) & (review == 0) & (relevance >= 0.80) & (extractable >= 0.70) & (score >= 0.78)
    rules = [
        (frozen, "frozen_test", "candidate_or_frozen_test_excluded"), (duplicate, "discarded", "duplicate_case"), (F.coalesce(status, F.lit("")).isin("", "api_available") == F.lit(False), "discarded", "api_not_available"),
        (~known, "discarded", "invalid_or_unknown_label"), (pre_length < min_pre, "discarded", "short_pre_decision_text"), ((substantive == 0) & (relevance >= 0.8), "rag_only", "no_substantive_decision_content"),
        (substantive == 0, "discarded", "no_substantive_decision_content"), (procedural == 1, "discarded", "procedural_only"), (strong, "strong_label_train_candidate", ""), (relevance >= 0.70, "weak_label_candidate", ""), (relevance >= 0.55, "rag_only", ""),
    ]
    named = [F.when(cond, F.struct(F.lit(b).alias("bucket"), F.lit(r).alias("reason"))) for cond, b, r in rules]
    return F.coalesce(*named, F.struct(F.lit("discarded").alias("bucket"), F.lit("").alias("reason")))


def contradictions(label: Column, reason: Column, items: Column, support: list[str], refuse: list[str], part: list[str]) -> Column:
    """Names of what contradicts a label in its reason and its items' evidence, sorted, each once.

    items: array of structs with `label` and `evidence`; the first six make up the case's evidence, cut at 2,000
    characters, and the first eight are looked at one by one. The lists are regular expressions.
    """
    hit = lambda text, patterns: F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    quoted = F.filter(F.transform(F.slice(items, 1, 6), lambda i: F.coalesce(i["evidence"], F.lit(""))), lambda e: e != "")
    evidence, label = F.left(F.array_join(quoted, " "), F.lit(2000)), F.coalesce(label, F.lit("unknown"))
    either = lambda patterns: hit(evidence, patterns) | hit(reason, patterns)
    among = lambda name, patterns: F.exists(F.slice(items, 1, 8), lambda i: (i["label"] == name) & hit(i["evidence"], patterns))
    rules = {
        "support_but_not_keywords": (label == "support") & either(refuse),
        "not_support_but_support_keywords": (label == "not_support") & either(support),
        "partial_without_partial_markers": (label == "partial") & ~either(part),
        "unknown_but_has_disposition_keywords": (label == "unknown") & (hit(evidence, support) | hit(evidence, refuse)),
        "item_support_but_not_kw": F.coalesce(among("support", refuse), F.lit(False)),
        "item_not_support_but_support_kw": F.coalesce(among("not_support", support), F.lit(False)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()])))


def flag_report(df: DataFrame, flags: str = "flags") -> DataFrame:
    """flag, n: how many rows carry each flag; rows without any count as none."""
    return df.select(F.explode(F.when(F.size(flags) > 0, F.col(flags)).otherwise(F.array(F.lit("none")))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def candidate(seed: Column, weak: Column, model: Column, post: Column, seed_confidence: Column, party: Column, coverage: Column, least: float = 0.78) -> Column:
    """struct<label, provenance, conflict, confidence, needs_review> of a case from up to four sources; unknown and null labels say nothing.

    A seed label decides; then two sources that agree (weak and post, model and post, weak and model); then a single one. A
    conflict is more than one label among weak, model and post. seed_confidence: null without a number.
    """
    plain = lambda c: F.when(F.coalesce(c.isin(*OUTCOMES), F.lit(False)), c)
    weak, model, post, seed_known = plain(weak), plain(model), plain(post), seed.isNotNull()
    rules = [("seed_reference", seed_known, F.coalesce(plain(seed), F.lit("unknown"))), ("weak+post_agree", weak == post, weak), ("llm+post_agree", model == post, model), ("weak+llm_agree", weak == model, weak), ("post_only", post.isNotNull(), post), ("weak_only", weak.isNotNull(), weak), ("llm_only", model.isNotNull(), model)]
    label = F.coalesce(*[F.when(cond, value) for _, cond, value in rules], F.lit("unknown"))
    provenance = F.coalesce(*[F.when(cond, name) for name, cond, _ in rules], F.lit("none"))
    conflict = (F.size(F.array_distinct(F.array_compact(F.array(weak, model, post)))) > 1).cast("int")
    same = lambda c: F.coalesce((c == label).cast("int"), F.lit(0))
    held = F.coalesce(party != "unknown", F.lit(False))
    seeded = F.when(seed_known, 0.25 + F.coalesce(F.least(seed_confidence * 0.3, F.lit(0.3)), F.lit(0.2))).otherwise(0.0)
    score = 0.2 + seeded + F.when(post.isNotNull(), 0.25).otherwise(0.0) + 0.15 * same(weak) + 0.15 * same(model) + F.when(held, 0.08).otherwise(0.0) + coverage * 0.12 - 0.18 * conflict
    confidence = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.98), score)), 4)
    review = ((conflict == 1) | (confidence < least) | ~held).cast("int")
    return F.struct(label.alias("label"), provenance.alias("provenance"), conflict.alias("conflict"), confidence.alias("confidence"), review.alias("needs_review"))


def accepted(bucket_: Column, score: Column, completeness: Column, sufficiency: Column, related: Column, material: Column, facts: Column, adjudicated: Column, procedural: Column, reason: Column, risky: str, least: float = 0.72, least_parts: float = 0.65) -> Column:
    """Whether a screening reply lets a case in: its bucket, three thresholds, five booleans, and no wording of doubt in its reason. Nulls refuse."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_doubt = ~F.coalesce(reason, F.lit("")).rlike(risky)
    return yes((bucket_ == "accept") & (score >= least) & (completeness >= least_parts) & (sufficiency >= least_parts)) & yes(related) & yes(material) & yes(facts) & yes(adjudicated) & ~F.coalesce(procedural, F.lit(True)) & no_doubt


def label_tiers(label: Column, confidence: Column, sufficiency: Column, basis: Column, material: Column, substantive: Column, procedural: Column, conflict: Column, review: Column, relaxed: tuple[float, float, int] = (0.6, 0.3, 2), allow_conflict: bool = False, ultra: bool = False, allow_empty: bool = False) -> Column:
    """struct<bucket, tier>: strong, usable, relaxed or weak. relaxed: least confidence, sufficiency and characters of the basis; ultra: only confidence and basis (or none, if `allow_empty`) count for relaxed."""
    known, said = F.coalesce(label.isin(*OUTCOMES), F.lit(False)), F.length(F.trim(F.coalesce(basis, F.lit(""))))
    merits = known & material & substantive & ~procedural
    usable = merits & (confidence >= 0.72) & (sufficiency >= 0.40) & ~conflict & (said >= 4)
    strong = merits & (confidence >= 0.80) & (sufficiency >= 0.50) & ~conflict & ~review & (said >= 4)
    if ultra:
        loose = known & (confidence >= relaxed[0]) & ((said >= relaxed[2]) | F.lit(allow_empty))
    else:
        loose = merits & (confidence >= relaxed[0]) & (sufficiency >= relaxed[1]) & (F.lit(allow_conflict) | ~conflict) & (said >= relaxed[2])
    names = [("unknown_or_discarded", ~known), ("strong_label", strong), ("lora_usable_label", usable), ("relaxed_lora_usable_label", loose)]
    return F.struct(bucket(names, "weak_label").alias("bucket"), bucket([("strong", strong), ("standard_lora", usable), ("relaxed_lora", loose)], "weak_or_unknown").alias("tier"))


def label_health(df: DataFrame, by: list[str], label: str, conflict: str, other: str) -> DataFrame:
    """by, unknown_ratio, max_class_ratio, conflict_rate, disagreement_rate of labels against another source; nulls are unknown labels and no conflict."""
    plain = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    each = df.groupBy(*by, plain(label).alias("_l")).agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.col(conflict), F.lit(0))).alias("_c"), F.count(F.when(plain(label) != plain(other), 1)).alias("_d"))
    n = F.sum("_n")
    rate = lambda c: F.round(c / n, 6)
    return each.groupBy(*by).agg(rate(F.sum(F.when(F.col("_l") == "unknown", F.col("_n")).otherwise(0))).alias("unknown_ratio"), rate(F.max("_n")).alias("max_class_ratio"), rate(F.sum("_c")).alias("conflict_rate"), rate(F.sum("_d")).alias("disagreement_rate"))


def outcome_with_snippet(text: Column, patterns: list[tuple[str, str]], before: int = 80, after: int = 120, default: str = "unknown") -> Column:
    """struct<label, snippet>: the label of the first pattern that matches, and what stands around its first match; the default and an empty snippet without any."""
    found = []
    for label, pattern in patterns:
        at = F.regexp_instr(text, F.lit(f"({pattern})"))
        size = F.length(F.regexp_extract(text, f"({pattern})", 1))
        begin = F.greatest(at - before, F.lit(1))
        found.append(F.when(text.rlike(pattern), F.struct(F.lit(label).alias("label"), F.substr(text, begin, at - begin + size + after).alias("snippet"))))
    return F.coalesce(*found, F.struct(F.lit(default).alias("label"), F.lit("").alias("snippet")))


def party_scores(text: Column, sentences: Column, explicit: list[tuple[str, list[str], float]], rules: list[tuple[str, list[str], list[str], float]], hint: Column, hint_weight: float) -> Column:
    """Array of struct<score, place, label>, the best first, of the parties that anything speaks for; ties go to the earlier party.

    explicit: party, phrases, weight of each that the text has; rules: party, terms of the role, terms of a cause, weight of each sentence with both;
    hint: a party, or unknown or null.
    """
    labels = list(dict.fromkeys([r[0] for r in explicit] + [r[0] for r in rules]))

    def both(roles: list[str], causes: list[str]):
        return lambda s: T.any_of(s, roles) & T.any_of(s, causes)

    def scored(all_: Column) -> Column:
        parts = []
        for i, label in enumerate(labels):
            score = sum((T.hits(text, phrases) * w for name, phrases, w in explicit if name == label), F.lit(0.0))
            for name, roles, causes, w in rules:
                if name == label:
                    score = score + F.size(F.filter(all_, both(roles, causes))) * w
            score = score + F.when(hint == label, hint_weight).otherwise(0.0)
            parts.append(F.struct(F.round(score, 6).alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")))
        return F.reverse(F.array_sort(F.filter(F.array(*parts), lambda p: p["score"] > 0)))

    return T.once(sentences, scored)


def responsible(scores: Column, hint: Column) -> Column:
    """struct<label, margin, confidence> from what a decision says: .55 + .1 of the score + .05 of the margin, at most .95; without scores the hint at .35, or unknown at .2."""
    top, next_ = F.get(scores, F.lit(0)), F.coalesce(F.get(scores, F.lit(1))["score"], F.lit(0.0))
    margin = top["score"] - next_
    named = F.when(F.coalesce(hint != "unknown", F.lit(False)), F.struct(hint.alias("label"), F.lit(0.0).alias("margin"), F.lit(0.35).alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("margin"), F.lit(0.2).alias("confidence")))
    found = F.struct(top["label"].alias("label"), F.round(margin, 4).alias("margin"), F.round(F.least(F.lit(0.95), 0.55 + 0.1 * top["score"] + 0.05 * margin), 4).alias("confidence"))
    return F.when(F.size(scores) > 0, found).otherwise(named)


def diagnosis(scores: Column, procedures: Column, evidence: Column, incomplete: Column, noncompliant: Column) -> Column:
    """struct<primary, secondary, kind, procedure, documents, confidence, uncertain> from what a record says before the decision.

    A second party counts with at least .8 and seven tenths of the first one's score; the confidence is .35 + .08 of all scores + .05 a
    procedure + .04 a piece of evidence, at most .95, and under .62 uncertain.
    """
    first, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    primary = F.coalesce(first["label"], F.lit("unknown"))
    secondary = F.coalesce(F.when(second["score"] >= F.greatest(F.lit(0.8), first["score"] * 0.7), second["label"]), F.lit("unknown"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"])
    confidence = F.least(F.lit(0.95), F.round(0.35 + 0.08 * total + 0.05 * procedures + 0.04 * evidence, 4))
    kind = F.when((primary == "both") | (secondary != "unknown"), "shared").when(primary != "unknown", "single_party").otherwise("uncertain")
    documents = F.when(incomplete, "incomplete").when(evidence >= 2, "complete").otherwise("uncertain")
    procedure = F.when(noncompliant, "noncompliant").when(procedures >= 1, "partially_compliant").otherwise("uncertain")
    return F.struct(primary.alias("primary"), secondary.alias("secondary"), kind.alias("kind"), procedure.alias("procedure"), documents.alias("documents"), confidence.alias("confidence"), ((primary == "unknown") | (confidence < 0.62)).cast("int").alias("uncertain"))


#: The record's texts with the longest form that is kept, and its indices in [0, 1].
REPLY_TEXTS = {"responsibility_type": 80, "issue": 300, "rule": 500, "application": 800, "conclusion": 400, "management_action": 500, "managerial_failure_type": 120}
REPLY_INDICES = ("outcome_confidence", "responsibility_confidence", "documentation_gap_index", "procedural_compliance_risk", "causality_ambiguity", "concurrency_risk", "critical_path_support", "negotiation_readiness_score")


def response_record(reply: Column, pre: Column, spans: Column, parties: dict[str, list[str]]) -> list[Column]:
    """A parsed reply (map of string to string) as the record's columns: labels, texts cut, indices held in [0, 1], the doubt, checks of its quotes.

    Missing keys: labels unknown, the type uncertain, texts empty, indices 0. It is in doubt where the reply says so or
    its outcome is unknown. Without quotes the rates are 0.
    """
    said = lambda name: F.try_element_at(reply, F.lit(name))
    label = outcome(said("outcome_label"))
    label = F.when(label.isin(*OUTCOMES), label).otherwise("unknown")
    texts = [F.left(F.coalesce(said(name), F.lit("uncertain" if name == "responsibility_type" else "")), F.lit(most)).alias(name) for name, most in REPLY_TEXTS.items()]
    doubt = F.coalesce(F.lower(said("uncertainty_flag")).isin("true", "1", "yes"), F.lit(False)) | (label == "unknown")
    checks = span_checks(pre, F.coalesce(spans, F.array().cast("array<string>")))
    rate = lambda field: F.coalesce(F.round(F.aggregate(checks, F.lit(0), lambda a, s: a + s[field]) / F.nullif(F.size(checks), F.lit(0)), 6), F.lit(0.0)).alias(f"{field}_rate")
    party = [folded(F.lower(F.trim(said(name))), parties, "unknown").alias(name) for name in ("primary_responsible_party", "secondary_responsible_party")]
    return [label.alias("outcome_label"), *party, *texts, *[clamp(said(name)).alias(name) for name in REPLY_INDICES], doubt.cast("int").alias("uncertainty_flag"), F.size(checks).alias("span_count"), rate("valid"), rate("duplicate")]


def extractability_score(label: Column, post: Column, anchor: Column, phrases: list[str]) -> Column:
    """How well a label can be read from a text: 0 for an unknown one, else 0.45, 0.3 more with an anchor and 0.25 with one of the phrases. Nulls count as empty."""
    anchored = F.when(F.coalesce(anchor, F.lit("")) != "", 0.3).otherwise(0.0)
    stated = F.when(F.coalesce(T.any_of(post, phrases), F.lit(False)), 0.25).otherwise(0.0)
    return F.when(label.isin(*OUTCOMES), F.round(F.least(F.lit(1.0), 0.45 + anchored + stated), 4)).otherwise(0.0)


# Words of a reply that state a label.
STATED = {"support": ["支持", "support"], "not_support": ["不予支持", "驳回", "not_support"], "partial": ["部分", "partial"]}


def label_consistency(label: Column, confidence: Column, review: Column, reply: Column, sure: float = 0.85) -> Column:
    """1 where a known label needs no review and is sure or stated in the reply, else 0; a null review flag asks for review."""
    said = F.lower(F.coalesce(reply, F.lit("")))
    stated = [(label == name) & T.any_of(said, words) for name, words in STATED.items()]
    good = label.isin(*OUTCOMES) & (review == 0) & ((F.coalesce(confidence, F.lit(0.0)) >= sure) | stated[0] | stated[1] | stated[2])
    return F.coalesce(good, F.lit(False)).cast("int")
