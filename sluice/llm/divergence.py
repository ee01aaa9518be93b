"""How sources of one language differ in their words: all pairs of sources, and the terms a source favours (operator 12).

Tasks count terms by source within Arrow batches before the shuffle. The counts of a language's kept
terms are a matrix of groups by terms. Its columns are dealt into blocks of a bounded number of counts and
its rows into ranges of at most RANGE groups; a task gets two ranges of one block. It builds a quadtree
over each range (k = 2, so k squared children: a bit for each, and the rank of a bit finds the child) and goes
down both together: where both quadrants are all zero, their smoothed frequencies are constants and
the quadrants' columns are priced by count times the distance of the constants; where only leaves
are left, these are compared cell by cell. Sums of blocks add up by pair.

Smoothed frequency of a term: 1 + floor(scale * (count + smooth) / (all + smooth * terms)), in whole numbers.

Defined cases: null text, lang and source are empty strings; an empty text, or one without terms, still makes
its group occur; without kept terms all distances are 0; a group alone in its language has no pairs;
repeated rows count each; ties go by the item's UTF-8 order; an empty table gives no rows; further columns are not read.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table, written

TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Rows and columns of a leaf; groups in a range; counts of a block that a task should get about; leaves compared at once.
LEAF_ROWS, LEAF_COLS, RANGE, ENTRIES, AT_ONCE = 8, 32, 512, 1 << 18, 1024
#: Terms that a task counts before it hands them on, and bytes of a text that it splits at once.
HELD, SLICE = 1 << 19, 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"


def slices(text: bytes):
    """A text in parts of about SLICE bytes that end between terms."""
    at = 0
    while len(text) - at > SLICE:
        gap = re.compile(rb"[^a-z\x80-\xff]").search(text, at + SLICE)
        if not gap:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS: occurrences of each term in each group and the documents it is in; a null term stands for the group itself."""

    def count(batches):
        n, within, held = {}, {}, 0

        def rows():
            for (lang, source), own in n.items():
                term = pa.array(list(own), pa.binary()).cast(pa.string())  # whole characters, since terms end at ASCII
                columns = [pa.repeat(pa.scalar(lang), len(own)), pa.repeat(pa.scalar(source), len(own)), term]
                sums = [np.fromiter(x, np.int64, len(own)) for x in (own.values(), map(within[lang, source].__getitem__, own))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                group, terms = (lang or "", source or ""), set()
                if group not in n:
                    n[group], within[group] = Counter({None: 0}), Counter()
                own, size = n[group], len(n[group])
                for part in slices((text.as_py() or b"").lower()):  # of bytes, so A to Z alone
                    found = TERM.findall(part)
                    own.update(found)
                    terms.update(found)
                within[group].update(terms)
                within[group][None] += 1
                held += len(own) - size
                if held >= HELD:
                    yield from rows()
                    n, within, held = {}, {}, 0
        if n:
            yield from rows()

    found = picked(docs, "lang", "source", "text").mapInArrow(count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, total: Column, terms: Column, scale: int, smooth: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)) without rounding; null where there are no terms."""
    over = (F.lit(scale).cast("decimal(19,0)") * (count + smooth)).alias("over")
    return F.when(terms > 0, 1 + F.call_function("div", over, (total + smooth * terms).cast("decimal(20,0)")))


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a gap between any two."""
    out = np.zeros(len(x), np.int64)
    for b in range(int(x.max(initial=0)).bit_length()):
        out |= (x >> b & 1) << 2 * b
    return out


class Quadtree:
    """Nonzero counts of some groups: at each depth four bits a nonzero node, in the order of the nodes."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, base: np.ndarray, height: int):
        self.base, self.height, self.tiles = base, height, -(-len(base) // LEAF_ROWS)
        code = spread(row // LEAF_ROWS) * 2 + spread(col // LEAF_COLS)
        order = np.argsort(code, kind="stable")
        self.row, self.col, self.value = row[order] % LEAF_ROWS, col[order] % LEAF_COLS, value[order]
        nodes, self.first = np.unique(code[order], return_index=True)
        self.first, self.tile_row = np.append(self.first, len(code)), np.zeros(len(nodes), np.int64)
        for b in range(height):
            self.tile_row |= (nodes >> 2 * b + 1 & 1) << b
        self.bits, self.rank = [], []
        for _ in range(height):
            above, at = np.unique(nodes >> 2, return_inverse=True)
            bits = np.zeros(4 * len(above), bool)
            bits[4 * at + (nodes & 3)] = True
            self.bits.insert(0, bits)
            self.rank.insert(0, np.cumsum(bits) - 1)
            nodes = above
        self.root = 0 if len(code) else -1

    def child(self, depth: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The nodes of a quadrant at the next depth, -1 where it is all zero."""
        if self.root < 0:
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[depth][at], self.rank[depth][at], -1)

    def cells(self, leaf: np.ndarray, tile: np.ndarray) -> np.ndarray:
        """Leaves as arrays of LEAF_ROWS by LEAF_COLS: the groups' constants where there is no count. tile: which rows."""
        constant = np.zeros(self.tiles * LEAF_ROWS, np.int64)
        constant[: len(self.base)] = self.base
        out = np.repeat(constant.reshape(-1, LEAF_ROWS)[tile][:, :, None], LEAF_COLS, axis=2)
        real = np.flatnonzero(leaf >= 0)
        size = self.first[leaf[real] + 1] - self.first[leaf[real]]
        at = np.repeat(self.first[leaf[real]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[np.repeat(real, size), self.row[at], self.col[at]] = self.value[at]
        return out


def distances(left: Quadtree, right: Quadtree, columns: int, same: bool) -> np.ndarray:
    """Sums of absolute differences over all columns for each row of `left` with each of `right`; same: pairs of tiles above the diagonal only."""
    h, priced = left.height, None
    cells = np.zeros((left.tiles * LEAF_ROWS, right.tiles * LEAF_ROWS), np.int64)
    a, b, ra, rb, c = (np.array([x]) for x in (left.root, right.root, 0, 0, 0))
    for depth in range(h + 1):
        span, tall = LEAF_COLS << h - depth, 1 << h - depth
        zero = np.zeros((-(-left.tiles // tall), -(-right.tiles // tall)), np.int64)
        empty = (a < 0) & (b < 0)
        np.add.at(zero, (ra[empty], rb[empty]), np.clip(columns - c[empty] * span, 0, span))
        priced = zero if priced is None else np.repeat(np.repeat(priced, 2, 0), 2, 1)[: zero.shape[0], : zero.shape[1]] + zero
        a, b, ra, rb, c = (x[~empty] for x in (a, b, ra, rb, c))
        if depth == h:
            break
        nexts = []
        for qa, qb, qc in np.ndindex(2, 2, 2):
            na, nb, nc = 2 * ra + qa, 2 * rb + qb, 2 * c + qc
            there = (na * (tall // 2) < left.tiles) & (nb * (tall // 2) < right.tiles) & (nc * (span // 2) < columns) & ((na <= nb) if same else True)
            nexts.append([x[there] for x in (left.child(depth, a, 2 * qa + qc), right.child(depth, b, 2 * qb + qc), na, nb, nc)])
        a, b, ra, rb, c = (np.concatenate(x) for x in zip(*nexts, strict=True))
    for k in range(0, len(a), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        gaps = np.abs(left.cells(a[part], ra[part])[:, :, None, :] - right.cells(b[part], rb[part])[:, None, :, :])
        # Columns past the last one hold constants only and are left out.
        gaps *= (np.arange(LEAF_COLS) < (columns - c[part] * LEAF_COLS)[:, None])[:, None, None, :]
        rows, cols = ra[part, None] * LEAF_ROWS + np.arange(LEAF_ROWS), rb[part, None] * LEAF_ROWS + np.arange(LEAF_ROWS)
        np.add.at(cells, (rows[:, :, None], cols[:, None, :]), gaps.sum(axis=3))
    zeros = np.repeat(np.repeat(priced, LEAF_ROWS, 0), LEAF_ROWS, 1)[: len(left.base), : len(right.base)]
    return cells[: len(left.base), : len(right.base)] + zeros * np.abs(left.base[:, None] - right.base[None, :])


def compared(low: int, high: int, groups: pd.DataFrame, entries: pd.DataFrame, columns: int, in_range: int = RANGE) -> pd.DataFrame:
    """a, b, value for the pairs of a block between the groups of two ranges. groups: gid, base; entries: gid, col, p."""
    of = [groups[groups["gid"] // in_range == r].sort_values("gid") for r in (low, high)]
    # Columns of like pattern side by side, so that more quadrants are all zero.
    col, p, gid = (entries[x].to_numpy(np.int64) for x in ("col", "p", "gid"))
    used, first = np.full(columns, 0), np.full(columns, 2**62)
    np.add.at(used, col, 1)
    np.minimum.at(first, col, gid)
    place = np.empty(columns, np.int64)
    place[np.lexsort((first, -used))] = np.arange(columns)
    tiles = max(-(-columns // LEAF_COLS), *(-(-len(g) // LEAF_ROWS) for g in of))
    height, trees = int(tiles - 1).bit_length(), []
    for r, g in zip((low, high), of, strict=True):
        own = gid // in_range == r
        trees.append(Quadtree(np.searchsorted(g["gid"].to_numpy(), gid[own]), place[col[own]], p[own], g["base"].to_numpy(np.int64), height))
    sums = distances(*trees, columns, low == high)
    ga, gb = (g["gid"].to_numpy() for g in of)
    i, j = np.nonzero(ga[:, None] < gb[None, :])
    return pd.DataFrame({"a": ga[i], "b": gb[j], "value": sums[i, j]})


def audit(docs: DataFrame, least: int = 30, top: int = 50, scale: int = 1_000_000_000, smooth: int = 5, in_range: int = RANGE, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank. least: documents of the language that a kept term is in."""
    counts = written(term_counts(docs), "divergence-counts")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).filter(F.col("docs") >= least)
    terms = written(terms.drop("docs"), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"), F.sum("sources").alias("entries"))
    kept = written(counts.filter("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "divergence-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.withColumn("gid", number.cast("long")).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    base = frequency(F.lit(0), F.col("group_total"), F.col("terms"), scale, smooth)
    # How many ranges of groups and blocks of terms; a block of two ranges has about ENTRIES counts.
    groups = groups.withColumn("base", F.coalesce(base, F.lit(0))).withColumn("ranges", F.ceil(F.col("sources") / in_range))
    groups = written(groups.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(2 * F.col("entries") / (F.col("ranges") * entries)))), "divergence-groups")
    p, q = (frequency(F.col(n), F.col(of), F.col("terms"), scale, smooth) for n, of in (("n", "group_total"), ("total", "lang_total")))
    known = kept.drop("sources").join(groups, ["lang", "source"]).withColumns({"p": p, "q": q})
    return favoured(known, top).unionByName(_pairs(known, terms, groups, in_range))


def favoured(known: DataFrame, top: int) -> DataFrame:
    more = known.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(known: DataFrame, terms: DataFrame, groups: DataFrame, in_range: int) -> DataFrame:
    shape = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("ranges").alias("ranges"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    columns = terms.select("lang", "term").join(shape, "lang").withColumn("block", block).withColumn("col", place.cast("long")).select("lang", "term", "block", "col")
    widths = columns.groupBy("lang", "block").agg(F.count("*").alias("columns"))
    # Each range meets each other one, and itself, in every block.
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("other")
    own = F.floor(F.col("gid") / in_range)
    keys = [F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high")]
    cells = known.select("lang", "term", "gid", "p", "ranges").join(columns, ["lang", "term"]).select("*", met).select("lang", "block", *keys, "gid", "col", "p")
    there = groups.select("lang", "gid", "base", "ranges").join(widths, "lang").select("*", met).select("lang", "block", "columns", *keys, "gid", "base")
    there = there.toDF(*there.columns)  # columns of its own, since both sides come of `groups`

    def compare(key, entries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        out = compared(low, high, there, entries, int(there["columns"].iloc[0]), in_range)
        return out.assign(lang=lang)[["lang", "a", "b", "value"]]

    by = ["lang", "block", "low", "high"]
    found = cells.groupBy(*by).cogroup(there.groupBy(*by)).applyInPandas(compare, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "gid", "source")
    # Languages without kept terms have no columns: their pairs are all at 0.
    bare = groups.filter("terms = 0").select("lang", F.col("gid").alias("a"))
    found = found.unionByName(bare.join(bare.select("lang", F.col("a").alias("b")), "lang").filter("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value")))
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    rows = both.join(names.withColumnsRenamed({"gid": "a"}), ["lang", "a"]).join(names.withColumnsRenamed({"gid": "b", "source": "item"}), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of each language against each other, and the 50 terms that each favours most."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(s.n), 0) AS ng FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (ng + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (nl + 5 * v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f
QUALIFY part = 'pair' OR rank <= 50
"""
