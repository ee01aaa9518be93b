"""Splits and samples that a hash of the key decides (2-H): the same rows on any cluster."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, pieces
from .sets import _kept


#: Hexadecimal digits of the hash by which rows of a label are counted: 4096 cells.
DIGITS = 3


def order_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"), 256)


def ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """r: the place of a row among its label's in hash order; n: how many there are. Rows without a label are left out.

    Rows are counted by the hash's first digits, then placed within these, so no task holds all rows of a label.
    """
    placed = df.withColumn("_spot", order_key(F.col(key), seed)).withColumn("_cell", F.substring("_spot", 1, DIGITS))
    cells = placed.groupBy(label, "_cell").agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(label).orderBy("_cell"))
    before = cells.select(label, "_cell", (upto - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(label)).alias("n"))
    own = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_spot", key))
    return placed.withColumn("r", own).join(before, [label, "_cell"]).withColumn("r", F.col("r") + F.col("_before")).drop("_spot", "_cell", "_before")


def stratified(df: DataFrame, label: str, key: str, seed: int, held: Column) -> DataFrame:
    """`held` of n rows of each label go to dev, the others to train."""
    return ranked(df, label, key, seed).withColumn("split", F.when(F.col("r") <= held, "dev").otherwise("train")).drop("r", "n")


def folds(df: DataFrame, label: str, key: str, seed: int, k: int) -> DataFrame:
    return ranked(df, label, key, seed).withColumn("fold", ((F.col("r") - 1) % k).cast("int")).drop("r", "n")


def balanced(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows of each label as the rarest has."""
    rows = ranked(df, label, key, seed)
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    return rows.crossJoin(least).filter("r <= least").drop("r", "n", "least")  # one row


def mixed(df: DataFrame, key: str, seed: int, parts: list[tuple[str, Column, int]], total: int) -> DataFrame:
    """Rows without replacement, tagged with the strategy that took them: of each in turn, up to so many that meet its condition, then any up to `total`.

    Each strategy takes the first rows in hash order of what is left. The sample is the size of the report, not of the table.
    """
    left, out = df, None
    for name, condition, n in [*parts, ("random_fill", F.lit(True), total)]:
        rows = left.filter(condition)
        if out is not None:  # earlier samples are small: their keys go to all tasks
            rows = rows.join(F.broadcast(out.select(key)), key, "left_anti")
        # Kept, so that the next strategies read this sample and do not draw it again.
        rows = _kept(rows.orderBy(order_key(F.col(key), seed), key).limit(n).withColumn("sample_strategy", F.lit(name)))
        out = rows if out is None else out.unionByName(rows)
    rank = F.array_position(F.array(*[F.lit(p[0]) for p in parts], F.lit("random_fill")), F.col("sample_strategy"))
    return out.orderBy(rank, order_key(F.col(key), seed), key).limit(total)


def rotating_blocks(sources: DataFrame, position: str, categories: list[str], size: int) -> DataFrame:
    """block_no (from 1) and category: each source, numbered from 1, takes `size` categories, beginning where the blocks before it leave the list."""
    start = (F.col(position) - 1) * size
    step = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_step")
    rows = sources.select("*", step)
    return rows.withColumn("block_no", start + F.col("_step") + 1).withColumn("category", F.get(F.array(*map(F.lit, categories)), ((start % len(categories) + F.col("_step")) % len(categories)).cast("int"))).drop("_step")


def training_pairs(blocks: DataFrame, key: str, source: str, category: str, role: str, seed: int, rate: float = 0.3, held: float = 0.2) -> DataFrame:
    """key, category (of the question), match (the content's key), kind, label, split: questions about a block's category with the block, and about `rate` of all pairs with another block.

    A positive draws a negative by the hash of its key, and with it the kind: `near` is the next block of the same category
    in hash order, `hard` the next block of the same source if its role differs, `random` the next block of the split if its
    category differs. A negative whose partner is missing, the block itself, or does not differ as it should is not made. Splits go by source and
    partners are of the same split, so no content is in both. Positions are counted by range, so no task holds a category.
    """
    share = lambda column, s: F.conv(F.substring(order_key(column, s), 1, 8), 16, 10).cast("long") / float(1 << 32)
    rows = blocks.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(category).alias("category"), F.col(role).alias("role")).filter("key is not null and source is not null and category is not null").dropDuplicates(["key"])
    rows = rows.withColumn("split", F.when(share(F.col("source"), seed) < held, "validation").otherwise("train"))
    drawn, which = share(F.col("key"), seed + 1), share(F.col("key"), seed + 2)
    rows = rows.withColumn("kind", F.when(drawn < rate / (1 - rate), F.when(which < 1 / 3, "near").when(which < 2 / 3, "hard").otherwise("random")))
    positive = rows.select("key", "category", F.col("key").alias("match"), F.lit("positive").alias("kind"), F.lit(1).alias("label"), "split")
    near = F.col("category") == F.col("category_2")
    differs = {"near": (F.concat_ws("|", "split", "category"), near), "hard": (F.col("source"), ~F.col("role").eqNullSafe(F.col("role_2"))), "random": (F.col("split"), ~near)}
    out = positive
    for i, (kind, (group, fits)) in enumerate(differs.items()):
        placed = ranked(rows.withColumn("_g", group), "_g", "key", seed + 3 + i)
        other = placed.select("_g", F.col("r").alias("_next"), F.col("key").alias("match"), F.col("category").alias("category_2"), F.col("role").alias("role_2"))
        met = placed.filter(F.col("kind") == kind).withColumn("_next", F.col("r") % F.col("n") + 1).join(other, ["_g", "_next"]).filter((F.col("key") != F.col("match")) & fits)
        out = out.unionByName(met.select("key", "category", "match", "kind", F.lit(0).alias("label"), "split"))
    return out


def minority_views(df: DataFrame, key: str, text: str, minority: Column, compacted: Column, evidence: Column, terms: list[str], longest: int = 3000, mark: str = "evidence: ", ends: str = ".!?\n") -> DataFrame:
    """New rows of a minority class: its shortened text with its evidence, and its sentences that hold a term.

    df's columns with the key `<key>__aug<i>` and the view as text, then source_key and is_augmented. Blank views make no row;
    a null text or evidence is empty.
    """
    plain = lambda c: F.coalesce(c, F.lit(""))
    told = F.filter(pieces(plain(F.col(text)), ends), lambda s: any_of(s, terms))
    views = F.array(F.concat(plain(compacted), F.lit("\n" + mark), plain(evidence)), F.left(F.array_join(told, "\n"), F.lit(longest)))
    made = df.filter(minority).select("*", F.posexplode(views).alias("view_", "made_")).filter(F.trim("made_") != "")
    new = made.withColumns({"source_key": F.col(key), key: F.concat(F.col(key).cast("string"), F.lit("__aug"), (F.col("view_") + 1).cast("string")), text: F.col("made_"), "is_augmented": F.lit(1)})
    return new.drop("view_", "made_")
