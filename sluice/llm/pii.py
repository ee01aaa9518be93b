"""Personal data in texts, and words that disclose it (operator 8). DataFrame functions only.

Patterns find e-mail addresses, IP addresses, payment cards (Luhn) and telephone numbers. Each value
found is a protected entity. What else in a text reveals an entity is estimated from the corpus: of N
distinct documents, df(e) hold the entity e, df(t) the term t, and co(t, e) both. A term is a word of any
length outside the values found. The share of the entity's information content that a term discloses is

    PMI(t, e) / IC(e) = 1 - log(df(t) / co(t, e)) / log(N / df(e)),

1 if the term is met beside the entity alone. Terms whose share reaches `remove` are removed, those
that reach `generalise` are generalised, where at least `support` distinct documents hold both; wherever
they stand, in all documents, with the entity or without it. Documents of the same set of terms count once,
so copies of a text support nothing; nor does an entity met in one distinct document alone reveal anything of
its words, since every rare word there would be met beside it alone. Words are runs of letters, digits and underscores: of writing without
spaces between words a whole run is one term.

Defined cases: null and empty texts have no spans; a null doc_id stays null; repeated rows are
scanned each; an empty table gives no rows; further columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .secret_scan import redacted
from .spans import count_of, let, listed, located, of_kind, overlaps

# The patterns of the kinds, in their order. A match of `email` or `ip` begins where a
# run of its first characters does, or where the last match ended: \\G keeps the search linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: The bits of monotonically_increasing_id() that count within a task.
LOW = (1 << 33) - 1
WORD = r"[\p{L}\p{N}_]++"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def patterns(text: Column) -> Column:
    """The spans of the four kinds: structs of order, kind, start, end, hit."""
    size = lambda x: F.length(digits_of(x["hit"]))
    short = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255)
    email = located(text, EMAIL, text.contains("@"))
    ip = F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(F.split(x["hit"], r"\."), short))
    card = F.filter(located(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: F.when(size(x).between(13, 19), luhn(digits_of(x["hit"]))).otherwise(False))
    phone = F.filter(located(text, PHONE, text.contains("+")), lambda x: size(x).between(9, 15))
    return F.concat(*[of_kind(found, k, KINDS[k]) for k, found in enumerate((email, ip, card, phone))])


def entity(span: Column) -> Column:
    """A value in its plain form: lower case, or digits alone, after its kind."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), digits_of(span["hit"])).otherwise(F.lower(span["hit"])))


def terms_of(text: Column, base: Column) -> Column:
    """The distinct words of a text outside the spans found, in lower case, in order, with blanks between them."""
    blank = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("kind")))
    words = F.regexp_extract_all(redacted(text, blank), F.lit(WORD), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, F.lower))), " ")


def split_terms(rows: DataFrame) -> DataFrame:
    """key, term."""
    return rows.select("key", F.explode(F.split("terms", " ")).alias("term")).filter("term <> ''")


def alike(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """name, the columns `more`, first: the smallest name of those met under the same keys, by 128 bits of hashes of these."""
    marks = [F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"mark{seed}") for seed in (0, 1)]
    met = written(rows.groupBy(name, *more).agg(F.count("*").alias("times"), *marks), f"pii-{name}-marks")
    same = [*more, "times", "mark0", "mark1"]
    return met.join(met.groupBy(*same).agg(F.min(name).alias("first")), same).select(name, *more, "first")


def classes_of(base: DataFrame) -> DataFrame:
    """key, terms: one row of `base` for each key, the one with the smallest `row`, picked where it stands: no terms are shuffled.

    base: key, terms, row (of monotonically_increasing_id(), stored). What all tasks get is a bit for each row.
    """
    first = base.groupBy("key").agg(F.min("row").alias("row"))
    bits = first.groupBy(F.shiftright("row", 33).alias("task"), F.bitmap_bucket_number(F.col("row").bitwiseAND(F.lit(LOW))).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("row").bitwiseAND(F.lit(LOW)))).alias("bits"))
    bits = written(bits, "pii-first", "zstd")
    own = F.col("row").bitwiseAND(F.lit(LOW))
    rows = base.select("key", "terms", "row", F.shiftright("row", 33).alias("task"), F.bitmap_bucket_number(own).alias("bucket"))
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), ["task", "bucket"])
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select("key", "terms")


def co_occurrences(near: DataFrame, held: DataFrame, most_entities: int = 1000) -> DataFrame:
    """entity, term, df_e, df_t, co. A document of more entities than `most_entities` is dealt by entity into parts, and each part meets its terms."""
    parts = held.groupBy("key").agg(F.ceil(F.count("*") / most_entities).cast("int").alias("parts"))
    dealt = held.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("entity"), "parts").cast("int")).drop("parts")
    spread = near.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = spread.join(dealt, ["key", "part"]).filter(F.col("df_t") <= F.col("most"))
    return pairs.groupBy("entity", "term", "df_e", "df_t").agg(F.count("*").alias("co"))


def disclosing(base: DataFrame, classes: DataFrame, generalise: float, remove: float, support: int) -> DataFrame:
    """term, action, for the terms that disclose at least `generalise` of an entity. classes: key, terms, a row for each distinct document.

    Entities of the same documents share all their co-occurrences, and so do terms of the same documents and df(t): one of each
    stands for all, so lists of addresses that stand together in some documents are paired with terms once.
    """
    met = written(base.filter(F.size("base") > 0).select("key", F.explode(F.transform("base", entity)).alias("entity")).distinct(), "pii-entities")
    df_e = met.groupBy("entity").agg(F.count("*").alias("df_e")).filter(F.col("df_e") >= support)
    total = float(max(classes.count(), 2))
    # As co(t, e) <= df(e), a share of `generalise` needs df(t) <= df(e) * (N / df(e)) ^ (1 - generalise): no other term is paired.
    most = F.col("df_e") * F.pow(F.lit(total) / F.col("df_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    one = alike(met.join(df_e, "entity"), "entity", "df_e").filter("entity = first").select("entity", "df_e", most.alias("most"))
    held = written(met.join(one, "entity"), "pii-held")
    top = held.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    df_t = split_terms(classes).groupBy("term").agg(F.count("*").alias("df_t")).filter(F.col("df_t").between(support, top))
    near = written(split_terms(classes.join(held.select("key"), "key", "left_semi")).join(df_t, "term"), "pii-near")
    terms = written(alike(near, "term", "df_t"), "pii-alike")
    co = co_occurrences(near.join(terms.filter("term = first").select("term"), "term", "left_semi"), held).filter(F.col("co") >= support)
    share = 1 - F.log(F.col("df_t") / F.col("co")) / F.log(F.lit(total) / F.col("df_e"))
    shared = co.withColumn("share", F.when(F.col("df_e") < total, share).otherwise(F.lit(0.0))).filter(F.col("share") >= generalise)
    actions = shared.groupBy(F.col("term").alias("first")).agg(F.max(F.when(F.col("share") >= remove, "removed").otherwise("generalised")).alias("action"))
    return terms.join(actions, "first").select("term", "action")


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, support: int = 2, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, base (spans of the patterns), spans (with terms as kinds generalised, removed).

    `keep` may name the text, of which redacted() makes the sanitised one.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep], F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", patterns(F.col("text"))).withColumn("terms", terms_of(F.col("text"), F.col("base")))
    base = written(rows.withColumns({"key": F.unhex(F.substring(F.sha2("terms", 256), 1, 32)), "row": F.monotonically_increasing_id()}), "pii-base", "zstd")
    classes = classes_of(base)
    terms = written(disclosing(base, classes, generalise, remove, support), "pii-terms")
    each = split_terms(classes).join(terms, "term")
    marks = written(each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("marks")), "pii-marks")
    out = base.drop("terms", "row").join(marks, "key", "left")

    def named(hit):
        return F.element_at("marks", F.lower(hit))

    found = located(F.col("text"), WORD, F.col("marks").isNotNull(), lambda hit: hit.isNotNull() & named(hit).isNotNull())
    free = let(found, lambda hits: F.filter(hits, lambda x: ~overlaps(F.col("base"), x)))
    span = lambda x: F.struct(F.when(named(x["hit"]) == "generalised", 4).otherwise(5).alias("order"), named(x["hit"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["hit"]).alias("hit"))
    spans = F.when(F.col("marks").isNull(), F.col("base")).otherwise(F.concat("base", F.transform(free, span)))
    return out.select("doc_id", *[F.col(f"kept_{c}").alias(c) for c in keep], "base", spans.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by pattern, a digest of the patterns' spans, and all spans."""
    found = sanitise(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base"), "order", "start"), 256).alias("base_sha256"), listed(F.col("spans"), "order", "start").alias("spans"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """Personal data as its kind in brackets, generalised terms as [GENERALISED], removed ones as [REMOVED]."""
    return redacted(text, spans)
