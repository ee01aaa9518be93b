"""Size-aware heavy-light join of texts by the Jaccard similarity of their shingle sets (operator 9).

1. Texts with equal sets form a class, of which the smallest doc_id stands for all.
2. A linked pair overlaps in at least need(n) of either's n shingles, so it lacks at most n - need(n).
   Small sets list all their subsets of the sizes in question; two that link list one in common.
   Large sets are found by scanning inverted lists of their first n - need(n) + 1 shingles, rare ones
   first; of linked pairs one such shingle is in both. The boundary between small and large is where
   the two costs, summed over the sizes that occur, are least.
3. Each list is ordered by size; neighbours at a few distances are compared in full, and components are
   formed. Then come lists whose members are still in different components. Parities (one bit for each of
   1024 classes of shingles) bound from below what only one of two sets has. Blocks of members are held
   against each other by parities alone, as arrays within a task: first just the pairs that would join
   the components of a block, the nearest ones, so no more than it has members; once these are tested
   and components joined, every pair of different components that parities still allow. So no link
   between different components is left out, copies of one text are never paired, and the pairs that leave
   a task grow with the members of a list, but for pairs right below the threshold and for pairs of sets so
   large (some thousand shingles) that parities say nothing. Before sets are fetched, tallies (how many
   shingles fall into each of n/8 to n/4 classes) bound large sets in the same way, so that sets as a whole
   go to pairs that are mostly linked.

The array work of the last step grows with the square of the members of a list while they are apart (a
million pairs take a hundredth of a second); all else grows with the rows.

What each task needs of the corpus has a fixed size: counters of shingles (for "rare ones first"; where
a corpus has far more shingles than counters, those of rare ones differ by chance, and lists
grow no worse than in any other order) and filters of ids, sized by their number up to 16 MB, which never
drop a key that is in them. A list that is long by those counters is chained in parts, and the parts'
heads in turn.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a
null doc_id links with nothing and is in no component (null); rows of one doc_id link if any of them
does, and each is returned with its own size; an empty table gives no rows; further columns are not read.
"""

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, row_slices, table, utf8_of, written
from .components import components
from .shingles import shingle_sets
from .vectors import chunks, key_filter, mixed, passes, slot, summed

COUNTER_BITS, PARITY, SHORT = 23, 1024, 256
#: Neighbours at these distances in a list's order are compared first.
DISTANCES = (1, 2, 5, 23, 101)
#: Lists of so many members are compared in full at distances 1 and 2.
COVERED = 3
#: Members of a list that one task chains.
CHAIN = 1500
#: Sizes beyond which no set counts as small.
SMALL = 60
#: Ids up to which a filter of them goes to all tasks; of more, texts are joined with them.
FILTERED = 2_000_000
#: Members of lists that a task holds against each other.
AT_ONCE = 20_000
#: Sets of more shingles have tallies.
LARGE = 1000


def need(n, num: int, den: int):
    """The least overlap of a set of n with any partner."""
    return -(-num * n // den)


def sets_of(batch: pa.RecordBatch, width: int):
    """doc_id (null: None) and shingle set of each row."""
    docs = batch.column(0).to_pylist()
    raw, ends = utf8_of(batch.column(1))
    for i, j in row_slices(ends):
        yield from zip(docs[i:j], shingle_sets(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], width), strict=True)


def parity(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls on each of PARITY bits, as longs.

    Two sets' parities differ in at most as many bits as there are shingles in one of them alone.
    """
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def tally(s: np.ndarray) -> bytes:
    """How many of the set's shingles fall into each class, modulo 256; the classes are a power of two above an eighth of the set."""
    classes = 1 << (len(s) // 8).bit_length()
    return np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has; the finer tally is added up to the classes of the other."""
    x, y = (np.frombuffer(t, np.uint8) for t in (x, y))
    classes = min(len(x), len(y))
    differ = x.reshape(-1, classes).sum(0, dtype=np.uint8) - y.reshape(-1, classes).sum(0, dtype=np.uint8)
    return int(np.minimum(differ, -differ).sum(dtype=np.int64))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, two 64-bit sums, the parity and, of a large set, the tally) and, with `chunk`, of shingle counters."""
    names = ["doc_id", "n", "s1", "s2", "bits", "tally", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]

    def rows(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for b in batches:
            out = []
            for doc, s in sets_of(b, width):
                np.add.at(total, slot(s, COUNTER_BITS), 1)
                out.append((doc, len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), parity(s), tally(s) if len(s) > LARGE else None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        got = [(None, None, None, None, None, None, k, v) for k, v in chunks(total)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)

    return docs.mapInArrow(rows, "doc_id long, n long, s1 long, s2 long, bits array<long>, tally binary, chunk int, counts binary")


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """Sets below it count as small. sizes: how many sets there are of each size up to SMALL."""
    light = lambda n: sum(math.comb(n, d) for d in range(n - need(n, num, den) + 1))
    heavy = lambda n: (n - need(n, num, den) + 1) * list_length
    cost = lambda x: sum(k * (light(n) if n < x else heavy(n)) for n, k in sizes.items())
    return min(range(1, SMALL + 1), key=lambda x: (cost(x), x))


def keys_of(s: np.ndarray, counts: np.ndarray, usual: int, x: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is listed, and into how many parts each list is chained."""
    n = len(s)
    least = need(n, num, den)
    out, parts = [], []
    if n < x:  # small: subsets of every size that an overlap can have
        marks = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
        whole = marks.sum(dtype=np.uint64)
        for d in range(n - least + 1):
            gone = np.array(list(combinations(range(n), d)), np.int64).reshape(-1, d) if d else np.zeros((1, 0), np.int64)
            out.append(mixed(whole - marks[gone].sum(1, dtype=np.uint64) + np.uint64((n - d) * 0x9E3779B97F4A7C15 % 2**64)))
            parts.append(np.ones(len(gone), np.int64))
    if n >= x or den * n >= num * x:  # large, or a small set that a large one may link with
        common = counts[slot(s, COUNTER_BITS)]
        first = np.argsort(common, kind="stable")[: n - least + 1]
        out.append(s[first])
        parts.append(1 + np.maximum(common[first] - usual, 0) // CHAIN)
    return np.concatenate(out), np.concatenate(parts)


def postings(docs: DataFrame, standing: Callable[[pa.Array], np.ndarray], counts: np.ndarray, width: int, x: int, num: int, den: int) -> DataFrame:
    """key, part, split, doc, n for the sets of one text of each class."""
    names = ["key", "part", "split", "doc", "n"]
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def rows(batches):
        counts = shared.value
        usual = int(counts.mean())
        for b in batches:
            out = []
            b = b.filter(pa.array(standing(b.column(0))))
            for doc, s in sets_of(b, width):
                if len(s):
                    keys, parts = keys_of(s, counts, usual, x, num, den)
                    at = (mixed(np.array([doc], np.int64).view(np.uint64))[0] % parts.astype(np.uint64)).astype(np.int32)
                    out.append((keys.view(np.int64), at, parts > 1, np.full(len(keys), doc), np.full(len(keys), len(s))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return docs.mapInArrow(rows, "key long, part int, split boolean, doc long, n long")


def one_of_each(docs: DataFrame, classes: DataFrame, members: DataFrame) -> tuple[DataFrame, Callable[[pa.Array], np.ndarray]]:
    """Documents, and which of their ids may stand for their class: every one that does, and now and then a copy."""
    copies = written(members.filter("class_id <> doc_id").select("doc_id").distinct(), "jaccard-copies")
    count = copies.count()
    if count > FILTERED:
        return docs.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text"), lambda ids: np.ones(len(ids), bool)
    gone = key_filter(copies, count)
    kept = key_filter(classes.select("class_id"), count, gone)  # few of the classes pass the first filter

    def standing(ids: pa.Array) -> np.ndarray:
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return ids.is_valid().to_numpy(zero_copy_only=False) & (~passes(gone, x) | passes(kept, x))

    return docs, standing


def sets_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc, s: the sets of the documents whose ids are in the column `wanted`, distinct and written."""
    count = wanted.count()
    known = key_filter(wanted, count) if count <= FILTERED else None
    docs = docs if known is not None else docs.join(wanted.toDF("doc_id"), "doc_id", "left_semi").select("doc_id", "text")

    def rows(batches):
        for b in batches:
            if known is not None:
                ids = b.column(0)
                b = b.filter(pa.array(ids.is_valid().to_numpy(zero_copy_only=False) & passes(known, ids.fill_null(0).to_numpy(zero_copy_only=False))))
            got = [(d, s) for d, s in sets_of(b, width) if len(s)]
            if got:
                cuts = np.cumsum([0, *(len(s) for _, s in got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([s for _, s in got]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), lists], ["doc", "s"])

    return docs.mapInArrow(rows, "doc long, s array<long>")


def named(sketches: DataFrame, ids: DataFrame) -> DataFrame:
    """The sketches of these ids (a column doc_id). The ids are written, so that Spark knows their size and sends few of them to all tasks."""
    return sketches.join(written(ids.distinct(), "jaccard-named"), "doc_id", "left_semi")


def near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) without those that cannot be linked: parities bound what one set alone has from below."""
    sketches = named(sketches, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    for x in "ab":
        pairs = pairs.join(sketches.toDF(x, f"n{x}", f"p{x}"), x)
    differ = sum((F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return pairs.filter(differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b").distinct()


def likely(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) without those of two large sets that their tallies keep from being linked. sketches: doc_id, n, tally."""
    sketches = named(sketches, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    for x in "ab":
        pairs = pairs.join(sketches.toDF(x, f"n{x}", f"t{x}"), x)

    def rows(batches):
        for b in batches:
            each = zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True)
            may = [not x or not y or apart_at_least(x, y) * (den + num) <= (m + n) * (den - num) for m, n, x, y in each]
            yield b.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(rows, "a long, b long").distinct()


def joining(ids: np.ndarray, sizes: np.ndarray, label: np.ndarray, bits: np.ndarray, side: np.ndarray, num: int, den: int, all_pairs: bool) -> np.ndarray:
    """Pairs (rows of an array of ids) of one block of a list whose components differ and whose parities allow a link.

    label: components; side: of a block's two parts of the list, 0 alone where it is one part against itself.
    Unless `all_pairs`, only pairs that join the block's components, nearest first, as if each were a
    link: at most one less than there are members.
    """
    short = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, SHORT // 64), axis=1)  # parities of fewer classes
    _, label = np.unique(label, return_inverse=True)
    left, right = (np.flatnonzero(side == s) for s in (0, 1))
    alone = not len(right)
    right, found = (left if alone else right), [np.zeros((0, 3), np.int64)]
    for k in range(0, len(left), 64):
        i = left[k : k + 64]
        far = np.bitwise_count(short[i][:, None] ^ short[right][None]).sum(2, dtype=np.int64)
        may = (far * (den + num) <= (sizes[i][:, None] + sizes[right]) * (den - num)) & (label[i][:, None] != label[right])
        x, y = np.nonzero(may)
        x, y = i[x], right[y]
        if alone:
            x, y = x[x < y], y[x < y]
        far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        ok = far * (den + num) <= (sizes[x] + sizes[y]) * (den - num)
        found.append(np.column_stack((far[ok], x[ok], y[ok])))
    pairs = np.concatenate(found)
    if not all_pairs:
        pairs, kept = pairs[np.argsort(pairs[:, 0], kind="stable")], []
        while len(pairs := pairs[label[pairs[:, 1]] != label[pairs[:, 2]]]):
            for row in pairs[np.unique(np.concatenate([np.unique(pairs[:, k], return_index=True)[1] for k in (1, 2)]))]:
                a, b = label[row[1]], label[row[2]]
                if a != b:
                    label[label == a] = b
                    kept.append(row)
        pairs = np.array(kept, np.int64).reshape(-1, 3)
    return np.sort(ids[pairs[:, 1:]], axis=1)


def pairs_within(lists: DataFrame, num: int, den: int, all_pairs: bool, groups: int) -> DataFrame:
    """key, a, b: what joining() finds in every block. lists: key, a, na, c, bits, members.

    A list is cut into parts of about CHAIN members; a block is one of them with itself or with another.
    A task takes many blocks at once (`groups` in all), as most are small.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / CHAIN)).cast("int")
    rows = lists.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "a", "na", "c", "bits", (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))

    def find(group: pa.Table) -> pa.Table:
        key, i, j, ids, sizes, label, side = (group.column(c).to_numpy() for c in ("key", "i", "j", "a", "na", "c", "side"))
        bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        order = np.lexsort((j, i, key))
        at = np.flatnonzero(np.any([np.append(True, np.diff(x[order]) != 0) for x in (key, i, j)], axis=0))
        keys, found = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for rows in np.split(order, at[1:]):
            found.append(joining(ids[rows], sizes[rows], label[rows], bits[rows], side[rows], num, den, all_pairs))
            keys.append(np.full(len(found[-1]), key[rows[0]]))
        pairs = np.concatenate(found)
        return pa.table({"key": np.concatenate(keys), "a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("group").applyInArrow(find, "key long, a long, b long")


def apart(lists: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """key, a, na, c (component), members of the lists whose members are in different components. lists: key, a, na."""
    rows = written(lists.join(nodes.toDF("a", "component"), "a", "left").select("key", "a", "na", F.coalesce("component", "a").alias("c")), name)
    found = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).filter("low < high")
    return rows.join(found.select("key", "members"), "key")


def similar(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least num / den of their union in common. pairs: a written table."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-wanted")
    sets = written(sets_table(docs, ids, width), "jaccard-sets")
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(den * F.col("i") >= num * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def sized(num: int, den: int):
    """Sizes that a link may have; ordered chains have the smaller one first, but pairs need not."""
    return den * F.least("na", "nb") >= num * F.greatest("na", "nb")


def join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of equal sets), component_id (smallest doc_id that links reach)."""
    docs = picked(docs, id_column, text_column).toDF("doc_id", "text")
    prof = written(profiles(docs, width), "jaccard-profiles")
    counts = summed(prof.filter("chunk is not null"), 1 << COUNTER_BITS)
    rows = prof.filter("chunk is null").select("doc_id", "n", "s1", "s2")
    classes = written(rows.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "jaccard-classes")
    known = rows.filter("doc_id is not null")
    member = written(known.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "jaccard-members")

    sizes = {r["n"]: r["k"] for r in classes.filter(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("k")).collect()}
    total = float(counts.sum())
    x = boundary(sizes, max(1.0, float((counts.astype(float) ** 2).sum()) / max(total, 1.0) - total / len(counts)), num, den)

    listed = postings(*one_of_each(docs, classes, member), counts, width, x, num, den)
    chain = Window.partitionBy("key", "part").orderBy("n", "doc")
    ahead = F.array(*[F.struct(F.lead("doc", k).over(chain).alias("b"), F.lead("n", k).over(chain).alias("nb")) for k in DISTANCES])
    listed = listed.withColumn("ahead", F.filter(ahead, lambda x: x["b"].isNotNull())).withColumn("first", F.lag("doc").over(chain).isNull())
    listed = listed.withColumn("members", F.count("*").over(Window.partitionBy("key", "part")))
    lists = written(listed.filter("members > 1 or split").withColumnsRenamed({"doc": "a", "n": "na"}), "jaccard-lists")
    heads = lists.filter("split and first").select("key", "a", "na")
    top = Window.partitionBy("key").orderBy("na", "a")
    heads = heads.withColumn("b", F.lead("a").over(top)).withColumn("nb", F.lead("na").over(top))
    pairs = lists.select("a", "na", F.inline("ahead")).union(heads.select("a", "na", "b", "nb")).filter("b is not null and a <> b").filter(sized(num, den))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    sketches = prof.filter("chunk is null and doc_id is not null").select("doc_id", "n", "s1", "s2", "bits")
    tallies = prof.filter("chunk is null and doc_id is not null").select("doc_id", "n", "tally")
    tested = written(near(pairs, sketches.select("doc_id", "n", "bits"), num, den), "jaccard-near")
    checked = written(likely(tested, tallies, num, den), "jaccard-likely")
    nodes = components(written(similar(checked, docs, width, num, den), "jaccard-links"))

    # Lists of members in different components: first pairs that would join these, then all that are still apart.
    placed = lists.filter((F.col("members") > COVERED) | F.col("split")).select("key", "a", "na")
    for all_pairs in (False, True):
        placed = apart(placed, nodes, "jaccard-apart")
        known = named(sketches, placed.select(F.col("a").alias("doc_id"))).dropDuplicates(["doc_id", "n", "s1", "s2"])
        joined = pairs_within(placed.join(known.select(F.col("doc_id").alias("a"), "bits"), "a"), num, den, all_pairs, 1 + placed.count() // AT_ONCE)
        joined = written(joined, "jaccard-joining")
        late = written(joined.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-late")
        if joined.isEmpty():
            break
        if not late.isEmpty():
            checked = written(likely(late, tallies, num, den), "jaccard-likely")
            links = written(similar(checked, docs, width, num, den), "jaccard-late-links")
            nodes = components(nodes.toDF("a", "b").union(links))
        tested = tested.union(late)
        placed = placed.select("key", "a", "na").join(joined.select("key").distinct(), "key", "left_semi")  # in other lists no two can be linked

    out = member.join(nodes.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "class_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    nameless = rows.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, nine tenths: one row for each document with its set's size and its component."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
k AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
t AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM k),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep
      AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) UNION
      SELECT r.a, x.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON r.b = x.a) SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE least(k.rep, coalesce(r.m, k.rep)) END AS component_id
FROM s LEFT JOIN k ON len(s.s) > 0 AND k.k = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN r ON r.a = k.rep
"""
