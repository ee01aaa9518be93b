"""Places of regular-expression matches, with Spark's own functions only.

Offsets count code points from 0, the end is exclusive. Patterns must be free of nested greedy
repeats, since Java's matcher recurses for those.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import offsets

FOUND = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often `use` has it, even within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, guard: Column, wanted=lambda hit: hit.isNotNull()) -> Column:
    """All leftmost non-overlapping matches that are `wanted`; texts for which the cheap `guard` is false are not searched."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(piece, at):
        begin = at + F.length(piece["gap"])
        return F.struct(begin.alias("start"), (begin + F.length(piece["hit"])).alias("end"), piece["hit"].alias("hit"))

    size = lambda piece: F.length(piece["gap"]) + F.coalesce(F.length(piece["hit"]), F.lit(0))
    found = let(pieces, lambda ps: F.zip_with(ps, offsets(F.transform(ps, size)), placed))
    kept = F.filter(found, lambda x: x["hit"].isNotNull() & wanted(x["hit"])).cast(FOUND)
    return F.when(guard, kept).otherwise(F.array().cast(FOUND))


def of_kind(found: Column, order: int, kind: str) -> Column:
    """Structs (order, kind, start, end, hit), to be put together with those of other kinds."""
    return F.transform(found, lambda x: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, *first: str) -> Column:
    """kind:start:end, ordered by the given fields, joined by commas."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[f].alias(f"_{f}") for f in (*first, "end")], F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("text"))))
    return F.array_join(F.transform(keyed, lambda s: s["text"]), ",")


def overlaps(spans: Column, one: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < one["end"]) & (one["start"] < s["end"]))
