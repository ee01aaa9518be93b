"""Retrieval by shared tokens, votes and fusion of probabilities (2-K)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once
from .features import UNIT
from .labels import OUTCOMES


def tokens(text: Column) -> Column:
    """Distinct runs of two to four CJK characters, and lower-case words of at least two letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[一-鿿]{2,4}|[a-z0-9]{2,}"), F.lit(0)))


def jaccard_pairs(left: DataFrame, right: DataFrame, key: str, items: str) -> DataFrame:
    """query, match, similarity of all pairs that share an item, by an inverted index; a row does not match itself."""
    a = left.select(F.col(key).alias("query"), F.size(items).alias("na"), F.explode(items).alias("item"))
    b = right.select(F.col(key).alias("match"), F.size(items).alias("nb"), F.explode(items).alias("item"))
    shared = a.join(b, "item").filter("query <> match").groupBy("query", "match", "na", "nb").agg(F.count("*").alias("n"))
    return shared.select("query", "match", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("similarity"))


def nearest(pairs: DataFrame, k: int, by: tuple[str, ...] = ("query",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("similarity"), "match")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote(rows: DataFrame, case: str, label: str, weight: Column, order: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """The label with the most weight in each case; ties go to the earlier label of the order."""
    place = F.coalesce(*[F.when(F.col(label) == c, -i) for i, c in enumerate(order)], F.lit(-len(order)))
    sums = rows.groupBy(case, F.col(label).alias("label")).agg(F.round(F.sum(weight), 6).alias("weight"), F.first(place).alias("_p"))
    return sums.groupBy(case).agg(F.max_by("label", F.struct("weight", "_p")).alias("label"), F.max("weight").alias("weight"))


def majority(rows: DataFrame, case: str, label: str, confidence: Column, labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """case, label, confidence, agreement: the label of most votes, ties go to the higher mean confidence, then to the earlier label.

    confidence: the mean of the label's votes; agreement: its share of the votes with a known label. A case without any is unknown, with 0.
    """
    known = F.when(F.col(label).isin(*labels), F.col(label))
    place = F.coalesce(*[F.when(F.col("_l") == c, -i) for i, c in enumerate(labels)])
    each = rows.select(case, known.alias("_l"), F.coalesce(confidence.cast("double"), F.lit(0.0)).alias("_c")).groupBy(case, "_l").agg(F.count("*").alias("_n"), F.avg("_c").alias("_m"))
    voted = F.col("_l").isNotNull()
    best = each.groupBy(case).agg(F.max(F.when(voted, F.struct("_n", F.round("_m", 9).alias("_t"), place.alias("_p"), "_l", "_m"))).alias("b"), F.sum(F.when(voted, F.col("_n"))).alias("_all"))
    return best.select(case, F.coalesce("b._l", F.lit("unknown")).alias("label"), F.round(F.coalesce("b._m", F.lit(0.0)), 6).alias("confidence"), F.round(F.coalesce(F.col("b._n") / F.col("_all"), F.lit(0.0)), 6).alias("agreement"))


def label_shares(near: DataFrame, query: str, label: str, labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """query, a probability for each label, top_label, top_prob, margin: means of the nearest rows' similarities by label, as shares; equal ones where all are 0."""
    means = near.groupBy(query).agg(*[F.coalesce(F.avg(F.when(F.col(label) == c, F.col("similarity"))), F.lit(0.0)).alias(c) for c in labels])
    shares = normalised([F.col(c) for c in labels])
    made = means.select(query, *[F.round(p, 6).alias(f"{c}_prob") for c, p in zip(labels, shares, strict=True)], argmax(shares, labels).alias("top_label"), F.reverse(F.array_sort(F.array(*shares))).alias("_s"))
    return made.withColumns({"top_prob": F.round(F.get("_s", F.lit(0)), 6), "margin": F.round(F.get("_s", F.lit(0)) - F.get("_s", F.lit(1)), 6)}).drop("_s")


def consensus(votes: Column, labels: tuple[str, ...] = OUTCOMES) -> Column:
    """struct<label, agreement> of an array of models' labels: the known label that most models give, ties to the one that comes first among the models; agreement counts unknown ones too."""
    known = F.filter(votes, lambda v: v.isin(*labels))

    def most(k: Column) -> Column:
        tally = F.transform(F.array_distinct(k), lambda c: F.struct(F.size(F.filter(k, lambda v: v == c)).alias("n"), (-F.array_position(k, c)).alias("at"), c.alias("label")))
        top = F.array_max(tally)
        return F.struct(top["label"].alias("label"), F.coalesce(top["n"] / F.nullif(F.size(F.filter(votes, lambda v: v.isNotNull())), F.lit(0)), F.lit(0.0)).alias("agreement"))

    return once(known, most)


def selective_score(agreement: Column, parts: list[tuple[float, Column]], weight: float = 0.55) -> Column:
    """weight * agreement + the parts' weights times their values, nulls as 0."""
    return sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts), weight * agreement)


def switched(base: Column, agreed: Column, agreement: Column, top: Column, margin: Column, least: float = 0.5, least_margin: float = 0.08) -> Column:
    """Whether the models' consensus takes the place of the base label: enough of them agree, and what was retrieved says the same clearly."""
    return F.coalesce((agreed != base) & (agreement >= least) & (top == agreed) & (margin >= least_margin), F.lit(False))


def spread(label: Column, confidence: Column, labels: tuple[str, ...] = OUTCOMES) -> list[Column]:
    """A label and its confidence as probabilities; the others share the rest."""
    return [F.when(label == c, confidence).otherwise((1 - confidence) / (len(labels) - 1)) for c in labels]


def weighted(parts: list[tuple[float, list[Column]]]) -> list[Column]:
    total = sum(w for w, _ in parts)
    return [sum((w * p[i] for w, p in parts[1:]), parts[0][0] * parts[0][1][i]) / total for i in range(len(parts[0][1]))]


def argmax(probs: list[Column], labels: tuple[str, ...] = OUTCOMES) -> Column:
    """The most probable label, ties to the earlier one."""
    best = F.greatest(*[F.round(p, 9) for p in probs])
    return F.coalesce(*[F.when(F.round(p, 9) == best, c) for c, p in zip(labels, probs, strict=True)])


def normalised(probs: list[Column]) -> list[Column]:
    total = sum(probs[1:], probs[0])
    return [F.when(total == 0, F.lit(1.0 / len(probs))).otherwise(p / total) for p in probs]


def weight_sets(spark: SparkSession, models: int, n: int = 603) -> DataFrame:
    """candidate, weights: n fixed sets of whole weights from 0 to 100, one for each model."""
    return spark.range(n).select(F.col("id").alias("candidate"), F.array(*[(F.col("id") * (7 + 10 * j) + 31 * j) % 101 for j in range(models)]).alias("weights"))


def weighted_vote(df: DataFrame, fold: str, true: str, votes: list[str], candidates: DataFrame, labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """fold, candidate, score, accuracy: the weights that are best on the other folds (.55 accuracy + .45 macro-F1), and how they do on the fold itself.

    Rows are counted by what the models say before they meet the candidates, so that only distinct patterns of
    votes do. Ties go to the earlier label and to the smaller candidate.
    """
    patterns = df.groupBy(F.col(fold).alias("fold"), F.col(true).alias("_true"), *votes).agg(F.count("*").alias("_k"))
    points = [sum((F.when(F.col(v) == c, F.get("weights", F.lit(j))).otherwise(0) for j, v in enumerate(votes)), F.lit(0)) for c in labels]
    pred = F.coalesce(*[F.when(p == F.greatest(*points), c) for c, p in zip(labels, points, strict=True)])
    voted = patterns.crossJoin(F.broadcast(candidates)).select("fold", "candidate", "_true", pred.alias("_pred"), "_k")  # fixed candidates
    count = lambda when: F.sum(F.when(when, F.col("_k")).otherwise(0))
    cells = [x.alias(f"{k}{i}") for i, c in enumerate(labels) for k, x in (("tp", count((F.col("_true") == c) & (F.col("_pred") == c))), ("pp", count(F.col("_pred") == c)), ("sp", count(F.col("_true") == c)))]
    own = voted.groupBy("candidate", "fold").agg(*cells)
    names = [f"{k}{i}" for i in range(len(labels)) for k in ("tp", "pp", "sp")]
    rest = {n: F.sum(n).over(Window.partitionBy("candidate")) - F.col(n) for n in names}  # a row for each fold
    total = lambda kind, at: sum((at[f"{kind}{i}"] for i in range(len(labels))), F.lit(0))
    f1 = [F.when(rest[f"pp{i}"] + rest[f"sp{i}"] == 0, 0.0).otherwise(F.try_divide(2 * rest[f"tp{i}"], rest[f"pp{i}"] + rest[f"sp{i}"])) for i in range(len(labels))]
    score = 0.55 * F.try_divide(total("tp", rest), total("sp", rest)) + 0.45 * (sum(f1[1:], f1[0]) / len(labels))
    mine = {n: F.col(n) for n in names}
    scored = own.select("fold", "candidate", F.round(score, 9).alias("score"), F.round(F.try_divide(total("tp", mine), total("sp", mine)), 6).alias("accuracy"))
    best = scored.groupBy("fold").agg(F.max_by(F.struct("candidate", "score", "accuracy"), F.struct("score", -F.col("candidate"))).alias("b"))
    return best.select("fold", "b.candidate", F.round("b.score", 6).alias("score"), "b.accuracy")


def prior_weight(label: Column, conflict: Column, review: Column, labels: tuple[str, ...] = OUTCOMES) -> Column:
    """.32 for a known label without conflict or review, .18 for another known one, 0 for an unknown one."""
    return F.when(F.coalesce(label.isin(*labels), F.lit(False)), F.when((conflict == 0) & (review == 0), 0.32).otherwise(0.18)).otherwise(0.0)


def hybrid(base: list[Column], retrieved: list[Column], rule: Column, prior: Column, weight: Column, hint: Column, evidence: Column, incomplete: Column, owner: Column) -> list[Column]:
    """Probabilities of support, partial and not_support: base, retrieval, rule, prior and hint weighed, moved by the evidence, normalised.

    Incomplete records move weight from support to not_support, an owner's responsibility with evidence of .58 or more moves it back,
    and evidence under .38 mixes a fifth of a cautious distribution in. Labels that are unknown or null add nothing.
    """
    is_ = lambda label, c: F.coalesce((label == c).cast("double"), F.lit(0.0))
    p = [0.50 * b + 0.20 * r + 0.10 * is_(rule, c) + weight * is_(prior, c) + 0.08 * is_(hint, c) for b, r, c in zip(base, retrieved, OUTCOMES, strict=True)]
    support, partial, refuse = p
    shift = F.when(incomplete, F.least(F.lit(0.12), support * 0.35 + 0.04)).otherwise(0.0)
    support, refuse = F.greatest(F.lit(0.0), support - shift), refuse + shift
    back = F.when(owner & (evidence >= 0.58), F.least(F.lit(0.08), refuse * 0.30 + 0.03)).otherwise(0.0)
    support, refuse = support + back, F.greatest(F.lit(0.0), refuse - back)
    cautious = lambda x, share: F.greatest(F.when(evidence < 0.38, 0.80 * x + 0.20 * share).otherwise(x), F.lit(1e-8))
    return normalised([cautious(support, 0.15), cautious(partial, 0.45), cautious(refuse, 0.40)])


#: What a mechanism is measured by.
MECHANISMS = ("documentation_gap", "procedure_risk", "ambiguity", "concurrency", "critical_path", "negotiation")


def mechanism_shift(base: list[Column], m: dict[str, Column], weight: Column, prior: Column | None = None, prior_confidence: Column | None = None, prior_weight: float = 0.0, evidence_chain: bool = True) -> list[Column]:
    """Probabilities moved by what the mechanisms say: risk from support to not_support, backing the other way, doubt towards partial; then a prior label mixed in.

    m: MECHANISMS in [0, 1]. Without the evidence chain its three mechanisms are 0.
    """
    from_chain = lambda c: m[c] if evidence_chain else F.lit(0.0)
    gap, critical, talks = from_chain("documentation_gap"), from_chain("critical_path"), from_chain("negotiation")
    risk = 0.36 * gap + 0.26 * m["procedure_risk"] + 0.24 * m["ambiguity"] + 0.14 * m["concurrency"]
    backing = 0.36 * critical + 0.24 * (1 - gap) + 0.18 * (1 - m["procedure_risk"]) + 0.22 * talks
    doubt, zero = F.greatest(m["ambiguity"], m["concurrency"]), F.lit(0.0)
    state = lambda s, p, r: F.struct(s.alias("s"), p.alias("p"), r.alias("r"))
    down = F.when(risk > 0.42, F.least(F.lit(0.16), weight * (risk - 0.42))).otherwise(zero)
    up = F.when((backing > 0.62) & (gap < 0.55), F.least(F.lit(0.12), weight * (backing - 0.62))).otherwise(zero)
    aside = F.when(doubt > 0.50, F.least(F.lit(0.10), weight * 0.5 * doubt)).otherwise(zero)
    # Each step is computed once: written out, the steps would repeat one another many times over.
    lowered = once(state(*normalised(base)), lambda x: state(F.greatest(zero, x["s"] - down), x["p"], x["r"] + down))
    raised = once(lowered, lambda x: state(x["s"] + up, x["p"], F.greatest(zero, x["r"] - up)))
    moved = once(raised, lambda x: state(F.when(x["s"] >= x["r"], F.greatest(zero, x["s"] - aside)).otherwise(x["s"]), x["p"] + aside, F.when(x["s"] >= x["r"], x["r"]).otherwise(F.greatest(zero, x["r"] - aside))))
    if prior_weight:
        said = spread(prior, prior_confidence)
        moved = once(moved, lambda x: state(*[(1 - prior_weight) * x[f] + prior_weight * q for f, q in zip("spr", said, strict=True)]))
    whole = once(moved, lambda x: state(*normalised([x["s"], x["p"], x["r"]])))
    return [whole["s"], whole["p"], whole["r"]]


def mechanism_confidence(coverage: Column, evidence: Column, gap: Column, procedure_risk: Column) -> Column:
    return F.round(F.greatest(F.lit(0.42), F.least(F.lit(0.82), 0.48 + 0.18 * coverage + 0.14 * evidence - 0.10 * F.greatest(gap, procedure_risk))), 4)


def tuned(df: DataFrame, grid: list[float], score, true: str, valid: Column, labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """weight, macro_f1, chosen: how each weight of a grid does on the validation rows alone; the best is chosen, ties go to the smaller weight. score: from a weight column to a predicted label."""
    from .evaluate import scores

    rows = df.filter(valid).withColumn("weight", F.explode(F.array(*map(F.lit, grid))))
    made = scores(rows.select("weight", F.col(true).alias("y_true"), score(F.col("weight")).alias("y_pred")), ["weight"], labels).select("weight", "macro_f1")
    best = made.agg(F.max_by("weight", F.struct("macro_f1", -F.col("weight"))).alias("_best"))
    return made.crossJoin(F.broadcast(best)).select("weight", "macro_f1", (F.col("weight") == F.col("_best")).alias("chosen"))  # one row


def two_stage(probs: list[Column], gap: Column, procedure: Column, causality: Column) -> Column:
    """Refusal where its probability, raised by the three risks, is 0.05 above the others; else partial where that, raised by two, reaches support."""
    support, partial, refused = probs
    refuse = F.round(refused + 0.08 * gap + 0.05 * procedure + 0.05 * causality - F.greatest(support, partial) - 0.05, 9) >= 0
    part = F.round(partial + 0.08 * causality + 0.04 * procedure - support, 9) >= 0
    return F.when(refuse, "not_support").when(part, "partial").otherwise("support")


def boosted(probs: list[Column]) -> Column:
    """The label once support has 0.08 and partial 0.02 more."""
    return argmax([probs[0] + 0.08, probs[1] + 0.02, probs[2]])


def boundary(boost: Column, base: list[Column], retrieved: list[Column]) -> Column:
    """A boosted label, unless text and retrieval both refuse, or it refuses where the text's other two outweigh 0.55."""
    both = (argmax(base) == "not_support") & (argmax(retrieved) == "not_support")
    return F.when(both, "not_support").when((boost == "not_support") & (F.round(base[0] + base[1], 9) > 0.55), "partial").otherwise(boost)


def support_detector(base: list[Column], retrieved: list[Column], least: float = 0.28) -> Column:
    """struct<score, label>: support where 0.55 of the text's and 0.45 of the retrieval's probability reach `least`, else the likelier of the others."""
    support, partial, refused = weighted([(0.55, base), (0.45, retrieved)])
    other = F.when(F.round(partial, 9) >= F.round(refused, 9), "partial").otherwise("not_support")
    return F.struct(support.alias("score"), F.when(F.round(support, 9) >= least, "support").otherwise(other).alias("label"))


def support_tuned(probs: list[Column], score: Column) -> Column:
    """The label once a detector's score of 0.33 has raised support by 0.1, or one under 0.18 lowered it by 0.05."""
    near = F.round(score, 9)
    return argmax([probs[0] + F.when(near >= 0.33, 0.1).when(near < 0.18, -0.05).otherwise(0.0), probs[1], probs[2]])


def reasoning_trace(case: Column, label: Column, party: Column, retrieved: Column, chain: Column, procedure: Column, incomplete: Column, uncertain: Column, sufficiency: Column, leakage: Column, words: dict[str, str], entitlement: str, applied: list[str]) -> Column:
    """The record that says why a case has its label, as a nested struct.

    chain: units as of evidence_chain. procedure: compliant, noncompliant or uncertain. words: issue, basis, procedure, records,
    repair, keep: the sentences of the record. Null flags count as false, a null chain as empty.
    """
    units = F.coalesce(chain, F.array().cast(f"array<{UNIT}>"))
    of = lambda role: F.filter(units, lambda u: (u["role"] == role) & (u["text"] != ""))
    true = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    found = [F.when(F.size(of(role)) > 0, F.struct(F.lit(role).alias("role"), F.left(F.get(of(role), F.lit(0))["text"], F.lit(180)).alias("text"))) for role in applied]
    repairs = some(F.when(true(incomplete), words["records"]), F.when(procedure == "noncompliant", words["repair"]))
    return F.struct(
        case.alias("case_id"), retrieved.alias("retrieved_cases"), F.lit(words["issue"]).alias("issue_focus"),
        some(F.when(F.size(of(entitlement)) > 0, words["basis"]), F.when(procedure != "uncertain", F.concat(F.lit(words["procedure"]), procedure))).alias("rule_basis"),
        some(*found).alias("application_findings"), F.filter(units, lambda u: u["text"] != "").alias("evidence_citations"), (~true(leakage)).cast("int").alias("leakage_check"),
        party.alias("responsibility_primary"), label.alias("outcome_label"), F.when(F.size(repairs) > 0, repairs).otherwise(F.array(F.lit(words["keep"]))).alias("management_action"),
        (true(uncertain) | F.coalesce(sufficiency < 0.45, F.lit(True))).cast("int").alias("high_dispute_flag"),
    )
