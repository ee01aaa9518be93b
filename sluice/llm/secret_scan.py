"""Secrets in texts: fixed patterns, and strings of high entropy (operator 7). DataFrame functions only.

Beside three patterns, every run of at least 20 characters of the Base64 and hexadecimal alphabets is
a candidate. Its character class (hexadecimal, alphanumeric, Base64) sets a window and a threshold.
The window slides over the candidate; counts of its characters are kept, one goes up and one goes
down at each step, and with them the sum of c * log2(c), from which the window's Shannon entropy
follows. A candidate whose highest window reaches the threshold is a span of kind `entropy`, unless an
allow-list pattern matches it or half of it is placeholder words. Where spans of `assign` or `access` cover
part of a candidate, what is left of it is tested by itself; of a candidate with a `hex` span inside, the
whole is tested and what is outside the span is reported.

Defined cases: null and empty texts have no spans; a null doc_id stays null; repeated rows are
scanned each; an empty table gives no rows; further columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table
from .spans import FOUND, count_of, let, listed, located, of_kind

# The patterns, with the characters each must at least have (assign: in its second group).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Class, pattern of its candidates, window, threshold in bits; the first that matches holds.
CLASSES = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 20, 3.0), ("alphanumeric", r"^[0-9A-Za-z]+$", 20, 3.6), ("base64", r".", 20, 3.7))
#: Candidates that are no secrets: words, names and paths in letters alone, numbers, rulers, UUIDs.
ALLOWED = (r"^[A-Za-z_=/+-]+$", r"^[0-9_=/+-]+$", r"^(.)\1+$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
#: What makes a candidate a placeholder, if it is half of it or more.
PLACEHOLDER = r"(?i)example|placeholder|your[_-]?|x{4,}|0{4,}|12345678?9?0?"
LEAST = 20
#: Bits of a count, and counts in a long.
BITS, PER_WORD = 6, 10


def assign_ok(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST


def peak_entropy(candidate: Column, window: Column | int) -> Column:
    """The highest Shannon entropy of any full window, in bits; 0 for candidates shorter than the window (at most 63).

    The alphabet's counts stand in a few longs, BITS bits each, so that a step changes two of them at a constant price.
    """
    window = F.lit(window)  # a constant: it is evaluated at every step
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    shift = lambda value, slot: F.call_function("shiftleft", value, (slot % PER_WORD * BITS).cast("int"))
    words = -(-len(ALPHABET) // PER_WORD)
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"))

    def count(counts, slot):
        return F.call_function("shiftright", F.get(counts, F.floor(slot / PER_WORD).cast("int")), (slot % PER_WORD * BITS).cast("int")).bitwiseAND(F.lit(2**BITS - 1))

    def step(slots, s, i):
        new, old = F.get(slots, i), F.get(slots, F.when(i >= window, i - window))
        one = F.lit(1).cast("long")

        def moved(n, j):
            less = F.when(F.floor(old / PER_WORD) == j, shift(one, old)).otherwise(F.lit(0).cast("long"))
            return n - less + F.when(F.floor(new / PER_WORD) == j, shift(one, new)).otherwise(F.lit(0).cast("long"))

        def total(n_old, n_new):
            gone = F.when(old.isNotNull(), weight(n_old) - weight(n_old - 1)).otherwise(0.0)
            held = n_new - F.when(old == new, 1).otherwise(0)
            return s["sum"] - gone + weight(held + 1) - weight(held)

        sums = total(F.coalesce(count(s["counts"], old), F.lit(0).cast("long")), count(s["counts"], new))
        bits = lambda t: F.when(i + 1 >= window, F.log2(window) - t / window).otherwise(F.lit(0.0))
        return let(sums, lambda t: F.struct(F.transform(s["counts"], moved).alias("counts"), t.alias("sum"), F.greatest(s["peak"], bits(t)).alias("peak")))

    slots_of = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(slots_of, lambda slots: F.aggregate(F.sequence(F.lit(0), F.size(slots) - 1), state, lambda s, i: step(slots, s, i), lambda s: s["peak"]))


def suspicious(candidate: Column) -> Column:
    """Whether a candidate is not allowed and its entropy reaches its class's threshold; classes are told apart once, outside the window's steps."""
    allowed = F.length(F.regexp_replace(candidate, PLACEHOLDER, "")) * 2 <= F.length(candidate)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    found = F.when(allowed, F.lit(False))
    for _, pattern, window, bits in CLASSES:
        found = found.when(candidate.rlike(pattern), peak_entropy(candidate, window) >= bits)
    return found.otherwise(F.lit(False))


def outside(piece: Column, spans: Column) -> Column:
    """What the spans leave of a piece: structs of start, end, hit."""
    met = F.array_sort(F.transform(F.filter(spans, lambda s: (s["start"] < piece["end"]) & (piece["start"] < s["end"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    cut = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substr(piece["hit"], a - piece["start"] + 1, b - a).alias("hit"))
    begin = F.struct(piece["start"].alias("at"), F.array().cast(FOUND).alias("found"))

    def step(state, x):
        more = F.when(x["start"] > state["at"], F.array(cut(state["at"], x["start"])).cast(FOUND)).otherwise(F.array().cast(FOUND))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["found"], more).alias("found"))

    def finish(state):
        return F.when(state["at"] < piece["end"], F.concat(state["found"], F.array(cut(state["at"], piece["end"])).cast(FOUND))).otherwise(state["found"])

    return F.aggregate(met, begin, step, finish)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, base (spans of the patterns), spans (with those of high entropy): structs of order, kind, start, end, hit."""
    rows = picked(docs, id_column, text_column).toDF("doc_id", "text").withColumn("_t", F.coalesce("text", F.lit("")))
    text = F.col("_t")
    assign = F.filter(located(text, ASSIGN, text.rlike(r"[:=]")), lambda x: assign_ok(x["hit"]))
    access = F.filter(located(text, ACCESS, text.contains("AKIA")), lambda x: F.length(x["hit"]) >= ACCESS_LEAST)
    rows = rows.withColumn("base", F.concat(of_kind(assign, 0, "assign"), of_kind(access, 1, "access"), of_kind(located(text, HEX, text.rlike(HEX)), 2, "hex")))
    rows = rows.withColumn("_c", located(text, CANDIDATE, text.rlike(CANDIDATE)))
    whole, inner = F.filter("base", lambda s: s["kind"] != "hex"), F.filter("base", lambda s: s["kind"] == "hex")
    rows = rows.withColumn("_p", F.flatten(F.transform("_c", lambda x: outside(x, whole))))
    left = F.filter("_p", lambda x: (F.length(x["hit"]) >= LEAST) & (F.size(outside(x, inner)) > 0) & suspicious(x["hit"]))
    more = F.flatten(F.transform(left, lambda x: outside(x, inner)))
    return rows.withColumn("spans", F.concat("base", of_kind(more, 3, "entropy"))).drop("_t", "_c", "_p")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        gap = F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        kept = F.when(x["end"] <= s["at"], s["out"]).otherwise(F.concat(s["out"], gap, F.when(x["start"] >= s["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))))
        return F.struct(kept.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0))))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by pattern, a digest of the patterns' spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base"), "start", "order"), 256).alias("base_sha256"), listed(F.col("spans"), "start", "order").alias("spans"))
