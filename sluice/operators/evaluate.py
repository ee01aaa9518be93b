"""Metrics of label predictions (2-J)."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import OUTCOMES
from .order import quantiles


def confusion(df: DataFrame, by: list[str], labels: tuple[str, ...] = OUTCOMES, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A row for each group and pair of labels, pairs that do not occur with 0; other labels are dropped."""
    known = df.filter(F.col(true).isin(*labels) & F.col(pred).isin(*labels))
    cells = [F.count(F.when((F.col(true) == a) & (F.col(pred) == b), 1)).alias(f"{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    wide = known.groupBy(*by).agg(*cells)
    rows = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"{i}_{j}").alias("n")) for i, a in enumerate(labels) for j, b in enumerate(labels)])
    return wide.select(*by, F.inline(rows))


def per_class(cells: DataFrame, by: list[str], labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """precision, recall, f1 (0 where undefined), support of each class. cells: of confusion()."""
    sums = [x for i, c in enumerate(labels) for x in (F.sum(F.when((F.col("y_true") == c) & (F.col("y_pred") == c), F.col("n")).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(F.col("y_pred") == c, F.col("n")).otherwise(0)).alias(f"pp{i}"), F.sum(F.when(F.col("y_true") == c, F.col("n")).otherwise(0)).alias(f"sp{i}"))]
    wide = cells.groupBy(*by).agg(*sums)
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    rows = F.array(*[F.struct(F.lit(c).alias("label"), ratio(F.col(f"tp{i}"), F.col(f"pp{i}")).alias("precision"), ratio(F.col(f"tp{i}"), F.col(f"sp{i}")).alias("recall"), ratio(2 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col(f"sp{i}")).alias("f1"), F.col(f"sp{i}").alias("support"), F.col(f"tp{i}").alias("hits")) for i, c in enumerate(labels)])
    return wide.select(*by, F.inline(rows))


def scores(df: DataFrame, by: list[str], labels: tuple[str, ...] = OUTCOMES, **names: str) -> DataFrame:
    """n, accuracy, macro_f1, weighted_f1 of each group, 6 digits."""
    classes = per_class(confusion(df, by, labels, **names), by, labels)
    n = F.sum("support")
    return classes.groupBy(*by).agg(n.alias("n"), F.round(F.sum("hits") / n, 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / n, 6).alias("weighted_f1"))


def tempered(probs: list[Column], t: Column) -> list[Column]:
    """Probabilities sharpened or flattened by a temperature."""
    powers = [F.exp(F.log(F.greatest(p, F.lit(1e-12))) / t) for p in probs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def probability_of(label: Column, probs: list[Column], labels: tuple[str, ...] = OUTCOMES) -> Column:
    return F.coalesce(*[F.when(label == c, p) for c, p in zip(labels, probs, strict=True)])


def negative_log(label: Column, probs: list[Column]) -> Column:
    return -F.log(F.greatest(probability_of(label, probs), F.lit(1e-12)))


def brier(label: Column, probs: list[Column], labels: tuple[str, ...] = OUTCOMES) -> Column:
    parts = [F.pow(p - (label == c).cast("int"), F.lit(2)) for c, p in zip(labels, probs, strict=True)]
    return sum(parts[1:], parts[0])


def calibration_error(df: DataFrame, by: list[str], confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """ece: gaps between confidence and accuracy of right-closed bins, weighted by their rows."""
    placed = df.select(*by, confidence.alias("_c"), correct.cast("int").alias("_k"), F.greatest(F.ceil(confidence * bins), F.lit(1)).alias("_bin"))
    binned = placed.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.abs(F.avg("_c") - F.avg("_k")).alias("_gap"))
    return binned.groupBy(*by).agg(F.round(F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n"), 6).alias("ece"))


def crossfit_threshold(df: DataFrame, fold: str, folds: list[int], score: Column, correct: Column, steps: int = 20, least: float = 0.3) -> DataFrame:
    """fold, quantile, kept, coverage, accuracy: each fold above the threshold chosen on the other folds.

    Thresholds are quantiles of the other folds' scores; the most accurate one that keeps at least `least` of their rows
    is taken, ties go to more coverage, then to the lower quantile. Quantiles are exact and run over all tasks.
    """
    rows = df.select(F.col(fold).alias("_f"), score.alias("_s"), correct.cast("int").alias("_ok"))
    others = rows.withColumn("_outer", F.explode(F.filter(F.array(*map(F.lit, folds)), lambda k: k != F.col("_f"))))
    cuts = quantiles(others, "_s", [k / steps for k in range(1, steps)], ["_outer"]).select("_outer", (F.col("q") + 1).alias("quantile"), F.col("value").alias("_t"))
    sizes = others.groupBy("_outer").agg(F.count("*").alias("_n"))
    cuts = cuts.join(sizes, "_outer")  # a row for each fold and quantile
    above = others.join(F.broadcast(cuts), "_outer").filter("_s >= _t")
    each = above.groupBy("_outer", "quantile", "_t", "_n").agg(F.avg("_ok").alias("_acc"), (F.count("*") / F.col("_n")).alias("_cov")).filter(F.col("_cov") >= least)
    best = each.groupBy("_outer").agg(F.max_by(F.struct("quantile", "_t"), F.struct(F.round("_acc", 9), "_cov", -F.col("quantile"))).alias("b"))
    own = rows.join(F.broadcast(best), F.col("_f") == F.col("_outer"))  # a row for each fold
    kept = F.col("_s") >= F.col("b._t")
    made = own.groupBy("_f").agg(F.first("b.quantile").alias("quantile"), F.count(F.when(kept, 1)).alias("kept"), F.round(F.count(F.when(kept, 1)) / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.when(kept, F.col("_ok"))), 6).alias("accuracy"))
    return made.withColumnRenamed("_f", fold)


def bootstrap_macro_f1(df: DataFrame, by: list[str], rounds: int = 300, seed: int = 2026, labels: tuple[str, ...] = OUTCOMES, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """by, macro_f1, low, high: the 95 % percentile interval over resamples with replacement.

    A cell of the confusion matrix with n rows is drawn Poisson(n) times in each round, which is what n rows with
    Poisson weights add up to; so the work after the counts does not grow with the rows. A cell's draws
    depend on the seed and the cell alone.
    """
    cells = confusion(df, by, labels, true, pred)
    key = F.crc32(F.to_json(F.struct(*by, "y_true", "y_pred")).cast("binary"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields] + ["draws array<long>"])

    def draw(parts):
        for part in parts:
            part["draws"] = [np.random.default_rng([seed, k]).poisson(n, rounds).tolist() for k, n in zip(part["_key"], part["n"], strict=True)]
            yield part.drop(columns="_key")

    drawn = cells.withColumn("_key", key).mapInPandas(draw, schema)
    long = drawn.select(*by, "y_true", "y_pred", F.posexplode("draws").alias("_round", "n"))
    f1 = per_class(long, [*by, "_round"], labels).groupBy(*by, "_round").agg(F.avg("f1").alias("f1"))
    interval = f1.groupBy(*by).agg(F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # as many as there are rounds
    whole = per_class(cells, by, labels).groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    joined = whole.join(interval, by) if by else whole.crossJoin(interval)
    return joined.select(*by, "macro_f1", F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"))


def ablation(df: DataFrame, settings: dict[str, dict[str, Column]], score, rates: dict[str, str], labels: tuple[str, ...] = OUTCOMES, second: tuple[str, str, tuple[str, ...]] | None = None) -> DataFrame:
    """setting, accuracy, macro_f1, weighted_f1 [, those of a second task], and means of columns, for each setting, in one plan.

    settings: what columns a setting replaces; score: from a table with `setting` to one with y_true and y_pred; rates: name
    -> column; second: true column, predicted column, labels. Rows with other true labels count in no score, as in scores().
    """
    rows = df.withColumn("setting", F.explode(F.array(*map(F.lit, settings))))
    changed = {c for columns in settings.values() for c in columns}
    made = {}
    for c in changed:
        value = F.col(c)
        for name, columns in settings.items():
            if c in columns:
                value = F.when(F.col("setting") == name, columns[c]).otherwise(value)
        made[c] = value
    rows = score(rows.withColumns(made))
    out = scores(rows, ["setting"], labels).drop("n")
    if second:
        true, pred, kinds = second
        other = scores(rows, ["setting"], kinds, true=true, pred=pred)
        out = out.join(other.select("setting", F.col("accuracy").alias("second_accuracy"), F.col("macro_f1").alias("second_macro_f1")), "setting", "left").fillna(0.0, ["second_accuracy", "second_macro_f1"])
    return out.join(rows.groupBy("setting").agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for n, c in rates.items()]), "setting")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two raters' labels (rows with a null are left out)."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("x")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("same"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    po, pe = F.col("agree") / F.col("n"), F.col("same") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def preview(items: Column, n: int) -> Column:
    """The first n of a list in one string, empty ones left out."""
    return F.array_join(F.filter(F.slice(items, 1, n), lambda x: x != ""), " | ")


def run_delta(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, old, new, delta, status of each metric of two runs' summaries; a group that one run lacks has nulls there."""
    long = lambda df, name: df.unpivot(keys, metrics, "metric", name)
    both = long(old, "old_value").join(long(new, "new_value"), [*keys, "metric"], "full")
    gap = F.round(F.col("new_value") - F.col("old_value"), 6)
    status = F.when(gap.isNull(), "missing").when(gap < 0, "worse").when(gap > 0, "better").otherwise("same")
    return both.select(*keys, "metric", "old_value", "new_value", gap.alias("delta"), status.alias("status"))


def inflation(scores_: DataFrame, keys: list[str], mode: str, base: str, metric: str = "macro_f1", limit: float = 0.005) -> DataFrame:
    """scores_ with base_<metric>, delta (6 digits) and risk: whether another text mode scores more than `limit` above the base one. Without a base row they are null, null and 0."""
    own = scores_.filter(F.col(mode) == base).select(*keys, F.col(metric).alias(f"base_{metric}"))
    joined = scores_.join(own, keys, "left") if keys else scores_.crossJoin(own)
    delta = F.round(F.col(metric) - F.col(f"base_{metric}"), 6)
    return joined.withColumn("delta", delta).withColumn("risk", F.coalesce((F.col(mode) != base) & (F.col("delta") > limit), F.lit(False)).cast("int"))


def error_rules(c: dict[str, Column]) -> dict[str, list[tuple[str, Column]]]:
    """Six sets of ordered rules that name an error; the last rule of a set always holds. c: true, pred, confidence and the evidence columns by name.

    `diagnosis` is for errors only and looks at evidence first, `copilot` too but at the label first; `selective` and `dispute`
    name correct rows as such; `partial` and `support` tell one boundary from the rest.
    """
    true, pred, right = c["true"], c["pred"], c["true"] == c["pred"]
    has = lambda label: (true == label) | (pred == label)
    always = F.lit(True)
    return {
        "diagnosis": [
            ("responsibility_evidence_inconsistency", c["consistent"] == 0), ("insufficient_evidence", (c["valid_spans"] < 0.70) | (c["coverage"] < 0.45) | (c["sufficiency"] < 0.38)), ("concurrent_delay_conflict", c["both"]),
            ("procedural_noncompliance_confusion", c["noncompliant"]), ("partial_support_boundary_confusion", has("partial")), ("ambiguous_causality", always),
        ],
        "copilot": [
            ("partial_support_boundary_confusion", has("partial")), ("insufficient_evidence", c["valid_spans"] < 0.5), ("ambiguous_causality", c["causality"] >= 0.5), ("procedural_noncompliance_confusion", c["procedure_risk"] >= 0.5),
            ("model_label_mismatch", always),
        ],
        "selective": [
            ("correct", right), ("support_under_recognition", true == "support"), ("not_support_partial_boundary", (true == "not_support") & (pred == "partial")), ("partial_boundary_confusion", true == "partial"), ("other_label_confusion", always),
        ],
        "dispute": [
            ("correct", right), ("low_confidence_boundary", c["confidence"] < 0.55), ("candidate_label_conflict", c["conflict"] == 1), ("partial_support_boundary_confusion", has("partial")), ("management_mechanism_high_dispute", c["dispute"] == 1),
            ("outcome_class_confusion", always),
        ],
        "partial": [("partial_boundary_confusion", has("partial")), ("other_class_confusion", always)],
        "support": [("support_boundary_error", has("support")), ("other_error", always)],
    }


def error_categories(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds; a null condition does not."""
    return F.coalesce(*[F.when(cond, name) for name, cond in rules])


def root_causes(df: DataFrame, dataset: str, gold: str, pred: str, hint: str, conflict: str, labels: tuple[str, ...], groups: dict[str, list[str]]) -> DataFrame:
    """cause, metric, dataset, value: what speaks for bad labels (by dataset), for a task cut too fine, and for a weak model (all datasets together).

    Labels are compared as they are, nulls as unknown; groups: coarser labels and their members. Scores are macro-F1 over rows with known
    labels; the majority is that of the gold labels, ties to the earlier one.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    rows = df.select(F.col(dataset).alias("dataset"), plain(gold).alias("gold"), plain(pred).alias("pred"), plain(hint).alias("hint"), F.coalesce(F.col(conflict), F.lit(0)).alias("conflict"))
    sizes = rows.groupBy("dataset", "gold").count().groupBy("dataset").agg(F.max("count").alias("top"))
    share = lambda cond: F.avg(cond.cast("double"))
    by = rows.groupBy("dataset").agg(share(F.col("gold") == "unknown").alias("unknown_ratio"), share(F.col("conflict") == 1).alias("conflict_rate"), share(F.col("gold") != F.col("hint")).alias("hint_disagreement"), F.count("*").alias("n")).join(sizes, "dataset")
    label_rows = by.select("dataset", F.inline(F.array(*[F.struct(F.lit("label_problem").alias("cause"), F.lit(m).alias("metric"), v.alias("value")) for m, v in (("unknown_ratio", F.col("unknown_ratio")), ("max_class_ratio", F.col("top") / F.col("n")), ("conflict_rate", F.col("conflict_rate")), ("hint_disagreement", F.col("hint_disagreement")))])))
    coarse = lambda c: F.coalesce(*[F.when(F.col(c).isin(*members), name) for name, members in groups.items()], F.lit("unknown"))
    place = F.coalesce(*[F.when(F.col("gold") == c, -i) for i, c in enumerate(labels)])
    majority = rows.filter(F.col("gold").isin(*labels)).groupBy("gold").agg(F.count("*").alias("n"), F.first(place).alias("p")).agg(F.max_by("gold", F.struct("n", "p")).alias("majority"))
    rows = rows.crossJoin(F.broadcast(majority))  # one row
    tests = [
        ("task_problem", "macro_f1_all_labels", F.col("gold"), F.col("pred"), labels), ("task_problem", "macro_f1_folded", coarse("gold"), coarse("pred"), tuple(groups)), ("model_problem", "diagnosis_macro_f1", F.col("gold"), F.col("pred"), labels),
        ("model_problem", "hint_macro_f1", F.col("gold"), F.col("hint"), labels), ("model_problem", "majority_macro_f1", F.col("gold"), F.col("majority"), labels),
    ]
    out = label_rows.select("cause", "metric", "dataset", F.round("value", 6).alias("value"))
    for cause, metric, true, says, known in tests:
        made = scores(rows.select(true.alias("y_true"), says.alias("y_pred")), [], known)
        out = out.unionByName(made.select(F.lit(cause).alias("cause"), F.lit(metric).alias("metric"), F.lit("all").alias("dataset"), F.coalesce("macro_f1", F.lit(0.0)).alias("value")))
    return out


def claim_tiers(runs: DataFrame, recomputed: DataFrame, covered: DataFrame, current: str, headline: Column, required: list[str]) -> DataFrame:
    """run_name, audit_status, metric_recomputed, artifact_traceable, leakage_sentinel_passed, tier, headline_claimable of each run.

    runs: run_name, audit_status; recomputed: run_name, metric_match, traceability_status and what `headline` needs, which is looked at for the
    current run only; covered: dataset_name of the leakage sentinel. A run without recomputed metrics is neither recomputed nor traceable.
    """
    counted = recomputed.filter((F.col("run_name") != current) | headline)
    checks = counted.groupBy("run_name").agg(F.min((F.coalesce("metric_match", F.lit(0)) == 1).cast("int")).alias("metric_recomputed"), F.min((F.coalesce("traceability_status", F.lit("")) == "complete").cast("int")).alias("artifact_traceable"))
    seen = covered.filter(F.col("dataset_name").isin(*required)).agg((F.count_distinct("dataset_name") == len(set(required))).cast("int").alias("_seen"))
    rows = runs.select("run_name", "audit_status").join(checks, "run_name", "left").fillna(0, ["metric_recomputed", "artifact_traceable"]).crossJoin(F.broadcast(seen))  # one row
    now = F.col("run_name") == current
    rows = rows.withColumn("leakage_sentinel_passed", F.when(now, F.col("_seen")).otherwise(0)).withColumn("tier", F.when(now, "claimable with caution").otherwise("historical reference only"))
    claimable = now & (F.col("audit_status") == "complete") & (F.col("metric_recomputed") == 1) & (F.col("artifact_traceable") == 1) & (F.col("leakage_sentinel_passed") == 1)
    return rows.withColumn("headline_claimable", F.coalesce(claimable, F.lit(False)).cast("int")).drop("_seen")


def crossfit_temperature(df: DataFrame, fold: str, folds: list[int], true: str, probs: list[Column], grid: list[float], labels: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """fold, temperature, nll_before, nll_after: the temperature with the least loss on the other folds, applied unchanged to the fold; ties go to the smaller one.

    A row gives its loss at every temperature at once, and these are summed by fold: the other folds' sum is the total less the fold's own.
    """
    losses = F.array(*[negative_log(F.col(true), tempered(probs, F.lit(t))) for t in grid])
    rows = df.filter(F.col(true).isin(*labels)).select(F.col(fold).alias("_f"), losses.alias("_l"), negative_log(F.col(true), probs).alias("_b"))
    own = rows.groupBy("_f").agg(F.array(*[F.sum(F.get("_l", F.lit(i))) for i in range(len(grid))]).alias("_s"), F.count("*").alias("_n"), F.sum("_b").alias("_before"))
    total = own.agg(F.array(*[F.sum(F.get("_s", F.lit(i))) for i in range(len(grid))]).alias("_t"))
    both = own.filter(F.col("_f").isin(*folds)).crossJoin(F.broadcast(total))  # one row
    rest = F.transform(F.zip_with("_t", "_s", lambda t, s: F.round(t - s, 9)), lambda x, i: F.struct(x.alias("loss"), i.alias("i")))
    best = F.array_min(rest)["i"]
    return both.select(F.col("_f").alias(fold), F.get(F.array(*map(F.lit, grid)), best).alias("temperature"), F.round(F.col("_before") / F.col("_n"), 6).alias("nll_before"), F.round(F.get("_s", best) / F.col("_n"), 6).alias("nll_after"))


METRICS = ("accuracy", "macro_f1", "weighted_f1")


def recomputed(predictions: DataFrame, reported: DataFrame, keys: list[str], tolerance: float = 1e-9, labels: tuple[str, ...] = OUTCOMES, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """keys, n, each metric recomputed and reported, metric_match, traceability_status.

    A group matches where no metric that is reported is `tolerance` or more away. Groups with predictions are complete (without
    a report they match nothing else and so agree); groups that are reported alone are unverifiable, with n 0 and no match.
    """
    own = scores(predictions, keys, labels).select(*keys, "n", *[F.col(m).alias(f"{m}_recomputed") for m in metrics])
    told = reported.select(*keys, *[F.col(m).cast("double").alias(f"summary_{m}") for m in metrics])
    both = own.join(told, keys, "full")
    near = [F.coalesce(F.abs(F.col(f"summary_{m}") - F.col(f"{m}_recomputed")) < tolerance, F.lit(True)) for m in metrics]
    match = F.col("n").isNotNull() & F.forall(F.array(*near), lambda x: x)
    return both.withColumns({"metric_match": match.cast("int"), "traceability_status": F.when(F.col("n").isNull(), "unverifiable").otherwise("complete"), "n": F.coalesce("n", F.lit(0))})


def run_risks(runs: DataFrame, run: str, current: str, settings: dict[str, tuple[str, list[str]]], metric: str) -> DataFrame:
    """A row for each older run and setting, against the run named `current`: both values, score_inflation_risk, expected_direction, impact and its band.

    settings: category -> (column, values that raise a score). A value that raises it makes the risk `yes`, any other difference
    `unclear`, none `no`. The band is that of the measured difference of the metric: large from 0.05, medium from 0.01, else small;
    unknown where either is null. Without a row of the current run there are no rows.
    """
    old, new = runs.filter(F.col(run) != current), runs.filter(F.col(run) == current)
    text = lambda row, column: F.col(f"{row}.{column}").cast("string")
    impact = F.round(F.col(f"o.{metric}") - F.col(f"n.{metric}"), 6)
    rows = []
    for category, (column, raising) in settings.items():
        raises = F.coalesce(text("o", column).isin(raising), F.lit(False)) & ~F.coalesce(text("n", column).isin(raising), F.lit(False))
        same = text("o", column).eqNullSafe(text("n", column))
        risk = F.when(raises, "yes").when(same, "no").otherwise("unclear")
        rows.append(F.struct(F.lit(category).alias("category"), text("o", column).alias("old_value"), text("n", column).alias("new_value"), risk.alias("score_inflation_risk"), F.when(raises, "raise").when(same, "none").otherwise("mixed").alias("expected_direction")))
    band = F.when(impact.isNull(), "unknown").when(F.abs(impact) >= 0.05, "large").when(F.abs(impact) >= 0.01, "medium").otherwise("small")
    # The current run is one row.
    pairs = old.alias("o").crossJoin(F.broadcast(new.limit(1).alias("n")))
    return pairs.select(F.col(f"o.{run}").alias("old_run"), F.lit(current).alias("new_run"), impact.alias("impact"), band.alias("impact_band"), F.explode(F.array(*rows)).alias("r")).select("old_run", "new_run", "r.*", "impact", "impact_band")
