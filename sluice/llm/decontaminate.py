"""Benchmark passages in documents, found by latent semantic retrieval (operator 5).

1. Documents are split into words once, cut into passages of `passage` words, and kept as slots. Inverse passage frequencies of hashed terms
   and a randomised SVD of the TF-IDF matrix are computed over all passages: every task multiplies its
   own rows, Z = A'(A G) for a Gaussian G, and sums of fixed size are added up on Spark. From Z and G
   alone (Nystrom's form of the method) come the right singular vectors and the singular values.
2. An item is a query, a longer one than the largest scale several: its pieces of that size, half of it
   apart. Windows of a document at the query's scale are sums of their words' latent vectors; those
   whose cosine with a query reaches its bar are candidates. The bar is `cosine`, or less where the item
   itself would fall short of it: what it keeps in 19 of 20 trials with all but `likely` of its words
   replaced by random ones, as is the case with items that stand in very many documents.
   Windows are looked at only where an exact bound allows a match: whoever shares `likely` of an
   item's words in a stretch has a certain number of its rarer ones there (see anchors()).
3. A candidate is checked word by word: the longest common subsequence of the whole item and the window
   with its surroundings must cover `sure` of the item, or `likely` of it where also the item's answer
   (its last sentence, or a given column) stands there in order.

Items of fewer than `shortest` words are looked for as they stand, word for word, without retrieval.
Up to ITEM_BLOCK items are searched in one pass; a larger benchmark takes a pass for each block, so
what a task holds does not grow with it.

Defined cases: a null or empty text or item, or one without words, matches nothing; repeated rows match
each, equal items count each; a null id stays null; equal cosines go to the earlier window; an empty
table gives no rows; further columns are not read.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, ranges, row_slices, small_batches, table, utf8_of, written
from .shingles import word_hashes

SLOT_BITS, RANK, OVER, DOOR_BITS = 14, 40, 8, 18
SCALES = (12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128)
STEP, ITEM_BLOCK, TRIALS = 4, 1 << 16, 40
#: Punctuation counts as white space.
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer boolean, start long, end long"


class Text:
    """Words of many texts: hashes, slots, the row of each, and where each row's words begin."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.words, self.row, self.first, self.stop = word_hashes(CLEAN[raw], ends)
        self.bounds = np.searchsorted(self.row, np.arange(len(ends)))
        self.slots = (self.words >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)

    def passages(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each passage, and the passage of each word."""
        at = np.arange(len(self.words)) - self.bounds[self.row]
        first = at % size == 0
        return np.flatnonzero(first), np.cumsum(first) - 1

    def only(self, rows: np.ndarray) -> tuple["Text", np.ndarray]:
        """The texts of these rows (a mask) alone, under their numbers, and the new place of each word."""
        keep = rows[self.row]
        out = object.__new__(Text)
        out.words, out.row, out.slots = self.words[keep], self.row[keep], self.slots[keep]
        out.bounds = np.concatenate(([0], np.cumsum(np.where(rows, np.diff(self.bounds), 0))))
        return out, np.cumsum(keep) - 1

    def sums(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' vectors at every STEP words, and where each text's begin."""
        first, _ = self.passages(STEP)
        each = np.add.reduceat(terms[self.slots], first, axis=0)
        return np.concatenate((np.zeros((1, terms.shape[1])), np.cumsum(each, axis=0, dtype=np.float64))), np.concatenate(([0], np.cumsum(-(-np.diff(self.bounds) // STEP))))


def texts_of(batches):
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        for i, j in row_slices(utf8_of(texts)[1], 1 << 19):
            yield b, i, j, Text(*utf8_of(pc.utf8_lower(texts.slice(i, j - i))))


class Slots(Text):
    """The slots of many texts alone, as a pass over the texts has left them; what needs words is not to be asked of it."""

    def __init__(self, slots: bytes, bounds: bytes):
        self.slots, self.bounds = np.frombuffer(slots, "<u2"), np.frombuffer(bounds, "<i8")
        self.words, self.row = self.slots, np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


PARTS, KEPT = "at int, x binary", "at int, x binary, slots binary, bounds binary"


def parts(out: np.ndarray, rows: int = 1024):
    """An array in blocks of rows, on its way to summed(); blocks of zeros are left out."""
    for k in range(0, len(out), rows):
        if out[k : k + rows].any():
            yield k, out[k : k + rows].astype("<f4").tobytes()


def summed(found: DataFrame, shape: tuple[int, int], fan: int = 64) -> np.ndarray:
    """The sum of all tasks' blocks: first of tasks of one number modulo `fan`, then of these sums. A task reads blocks one after the other and holds one sum for each `at` it meets."""

    def add(batches):
        sums = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = np.frombuffer(x.as_buffer(), "<f8" if b.schema.names[-1] == "second" else "<f4")
                sums[at] = sums[at] + block if at in sums else block.astype(np.float64)
        for at, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["at", "x"])

    first = found.select("at", "x", F.pmod(F.spark_partition_id(), F.lit(fan)).alias("part")).repartition("at", "part").mapInArrow(add, PARTS)
    out = np.zeros(shape)
    with small_batches(found.sparkSession):
        for r in first.withColumn("second", F.lit(True)).repartition("at").mapInArrow(add, PARTS).collect():  # of the array's size
            block = np.frombuffer(r["x"], "<f8").reshape(-1, shape[1])
            out[r["at"] : r["at"] + len(block)] = block
    return out


class Texts:
    """Documents that are split into words in the first pass over them only; later passes read the slots that it has left."""

    def __init__(self, docs: DataFrame):
        self.docs, self.split = docs, None


def total(texts: Texts, shape: tuple[int, int], add: Callable[[np.ndarray, Text], None]) -> np.ndarray:
    """The sum over all tasks of an array that add() fills from each text."""

    def kept(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["at", "x", "slots", "bounds"])

    def first_pass(batches):
        out = np.zeros(shape)
        for *_, t in texts_of(batches):
            if len(t.words):
                add(out, t)
                yield kept([None], [None], [t.slots.astype("<u2").tobytes()], [t.bounds.astype("<i8").tobytes()])
        for at, x in parts(out):
            yield kept([at], [x], [None], [None])

    def later_pass(batches):
        out = np.zeros(shape)
        for b in batches:
            for slots, bounds in zip(b.column(0), b.column(1), strict=True):
                add(out, Slots(slots.as_buffer(), bounds.as_buffer()))
        for at, x in parts(out):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([x], pa.binary())], ["at", "x"])

    if texts.split is None:
        found = texts.split = written(texts.docs.mapInArrow(first_pass, KEPT), "decontaminate-slots", "zstd")
        return summed(found.filter("at is not null"), shape)
    found = texts.split.filter("slots is not null").select("slots", "bounds").mapInArrow(later_pass, PARTS)
    return summed(written(found, "decontaminate-products", rows=16), shape)


def latent_terms(docs: DataFrame, passage: int = 32, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A row for each slot: idf * V / S, by which texts are folded into the latent space; and the passages that have it. docs: a column `text`.

    Dividing by the singular values keeps words that all texts share from making all texts alike.
    """
    size = 1 << SLOT_BITS

    def terms_of(t: Text) -> tuple[np.ndarray, np.ndarray]:
        """A row of slots for each passage, and which of them count: each slot once."""
        first, of = t.passages(passage)
        grid = np.full((len(first), passage), size, np.uint16)
        grid[of, np.arange(len(of)) - first[of]] = t.slots
        grid.sort(axis=1)
        once = grid < size
        once[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        return grid, once

    def count(out: np.ndarray, t: Text) -> None:
        grid, once = terms_of(t)
        out[:, 0] += np.bincount(grid[once], minlength=size)
        out[0, 1] += len(grid)

    texts = Texts(docs)
    counts = total(texts, (size, 2), count)
    idf = np.log((counts[0, 1] + 1) / (counts[:, 0] + 1)).astype(np.float32)
    wide = rank + OVER
    gauss = np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32)
    start = np.concatenate((idf[:, None] * gauss, np.zeros((1, wide), np.float32)))  # the last row: no term
    squares = np.append(idf, np.float32(0)) ** 2

    def gram(out: np.ndarray, t: Text) -> None:  # A' (A G)
        grid, once = terms_of(t)
        slots = np.where(once, grid, size)
        y = np.empty((len(grid), wide), np.float32)
        for k in range(0, len(grid), 64):  # a few passages at a time stay in the cache
            y[k : k + 64] = start[slots[k : k + 64]].sum(1)
        y /= (np.sqrt(squares[slots].sum(1)) + np.float32(1e-9))[:, None] ** 2  # for A's rows twice
        passage_of, terms = np.nonzero(once)[0], grid[once].astype(np.int64)
        for c, column in enumerate(np.ascontiguousarray(y.T)):
            out[:, c] += np.bincount(terms, column[passage_of], size)

    # From Z = A'A G alone: A'A is near Z (G'Z)^-1 Z', whose eigenvectors are A's right singular vectors.
    z = idf[:, None] * total(texts, (size, wide), gram)
    core = gauss.T.astype(np.float64) @ z
    values, turn = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(float(values.max(initial=0.0)) * 1e-10, 1e-12)
    vectors, singular, _ = np.linalg.svd(z @ turn[:, keep] / np.sqrt(values[keep]), full_matrices=False)
    return (idf[:, None] * vectors[:, :rank] / np.maximum(singular[:rank], 1e-6)).astype(np.float32), counts[:, 0]


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Bit-parallel longest common subsequence. masks: where each word stands in an item of n words."""
    whole = (1 << n) - 1
    free = whole
    for w in words:
        if hit := free & masks.get(w, 0):
            free = ((free + hit) | (free - hit)) & whole
    return n - bin(free).count("1")


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def words_of(text: str) -> Text:
    data = text.lower().encode()
    return Text(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def anchors(words: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The rarer words of a query, and how many times words of them stand wherever `least` of the query does.

    What misses at most (1 - least) * n of n words holds k of any (1 - least) * n + k of them.
    """
    k = 1 + len(words) // 12
    most = min(len(words), int((1 - least) * len(words) + 1e-6) + k)
    return words[np.lexsort((np.arange(len(words)), counts))[:most]], k


def bar_of(slots: np.ndarray, unit: np.ndarray, scale: int, terms: np.ndarray, often: np.ndarray, least: float, rng: np.random.Generator) -> float:
    """The cosine that a query keeps in 19 of 20 trials with all but `least` of its words replaced, half by usual words and half by any."""
    n = len(slots)
    rows = np.concatenate((np.broadcast_to(slots, (TRIALS, n)), np.zeros((TRIALS, max(scale - n, 0)), slots.dtype)), axis=1)
    other = np.where(np.arange(TRIALS)[:, None] % 2, rng.choice(often, rows.shape), rng.integers(0, len(terms), rows.shape))
    gone = np.ones(rows.shape, bool)
    gone[:, :n] = np.argsort(np.argsort(rng.random((TRIALS, n)), axis=1), axis=1) >= int(np.ceil(least * n))
    gone[:, : STEP // 2] = True  # a window begins up to so many words beside the item
    v = terms[np.where(gone, other, rows)].sum(1)
    return float(np.quantile(v @ unit / (np.linalg.norm(v, axis=1) + 1e-12), 0.05))


class Items:
    """A block of benchmark items: their words, and as queries their unit vectors, bars and anchors."""

    def __init__(self, rows: list[tuple[int, str, str | None]], latent: tuple[np.ndarray, np.ndarray], shortest: int, cosine: float = 0.4, least: float = 0.6):
        terms, counts = latent
        rng = np.random.default_rng(3)
        often = rng.choice(len(counts), 1 << 16, p=counts / counts.sum()) if counts.sum() else np.zeros(1, np.int64)
        self.ids, self.words, self.answers, self._masks = [], [], [], {}
        queries, keys, owners, needs = [], [], [], []
        self.short: list[tuple[np.uint64, int, int]] = []
        for item_id, text, answer in rows:
            t, i = words_of(text or ""), len(self.ids)
            n = len(t.words)
            if not n:
                continue
            self.ids.append(item_id)
            self.words.append(t.words)
            self.answers.append(words_of(answer if answer is not None else last_sentence(text)).words)
            if n < shortest:
                at = int(np.argmin(counts[t.slots]))
                self.short.append((t.words[at], i, at))
                continue
            scale = next((s for s in SCALES if s >= n), SCALES[-1])
            for start in [0] if n <= scale else [*range(0, n - scale, scale // 2), n - scale]:
                slots, own = t.slots[start : start + scale], t.words[start : start + scale]
                v = terms[slots].sum(0)
                unit = v / max(float(np.linalg.norm(v)), 1e-12)
                rare, k = anchors(own, counts[slots], least)
                keys.append(np.unique(rare))
                owners.append(np.full(len(keys[-1]), len(queries)))
                needs.append(k)
                queries.append((i, start, scale, unit, min(cosine, bar_of(slots, unit, scale, terms, often, least, rng) - 0.02), n + n // 2))
        self.item, self.start, self.scale, self.stretch = (np.array([q[k] for q in queries], np.int64) for k in (0, 1, 2, 5))
        self.unit = np.array([q[3] for q in queries], np.float32).reshape(len(queries), terms.shape[1])
        self.bar, self.needs = np.array([q[4] for q in queries]), np.array(needs, np.int64)
        flat, owner = (np.concatenate(x) if x else np.zeros(0, y) for x, y in ((keys, np.uint64), (owners, np.int64)))
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.owners, self.first = owner[order], np.append(first, len(flat))
        self.short.sort(key=lambda x: int(x[0]))
        self.short_keys = np.array([x[0] for x in self.short], np.uint64)
        self.door = np.zeros(1 << DOOR_BITS, bool)  # a cheap test before the search in `keys`
        self.door[np.concatenate((self.keys, self.short_keys)) >> np.uint64(64 - DOOR_BITS)] = True

    def masks(self, i: int) -> tuple[dict[int, int], int, dict[int, int], int]:
        """Masks and sizes of an item and of its answer, made when first asked for."""
        if i not in self._masks:
            self._masks[i] = (masks_of(self.words[i].tolist()), len(self.words[i]), masks_of(self.answers[i].tolist()), len(self.answers[i]))
        return self._masks[i]


def last_sentence(text: str) -> str:
    """What follows the last full stop, question or exclamation mark that has words behind it."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ". ").split(". ") if p.strip(" .")]
    return parts[-1] if parts else ""


def live_hits(t: Text, items: Items, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of anchors that stand near enough others of their query; at: places that may hold an anchor."""
    k = np.minimum(np.searchsorted(items.keys, t.words[at]), len(items.keys) - 1)
    met = items.keys[k] == t.words[at]
    at, k = at[met], k[met]
    many = items.first[k + 1] - items.first[k]
    query, place = items.owners[ranges(items.first[k], many)], np.repeat(at, many)
    order = np.argsort(query, kind="stable")
    query, place = query[order], place[order]
    last = np.arange(len(query)) + items.needs[query] - 1
    full = last < len(query)
    last = np.minimum(last, len(query) - 1)
    full &= (query[last] == query) & (t.row[place[last]] == t.row[place]) & (place[last] - place < items.stretch[query])
    live = np.zeros(len(query) + 1, np.int64)
    np.add.at(live, np.flatnonzero(full), 1)
    np.add.at(live, last[full] + 1, -1)
    keep = np.cumsum(live)[:-1] > 0
    return query[keep], place[keep]


def candidates(t: Text, terms: np.ndarray, items: Items):
    """(row, item, cosine, first word, word after the last): runs of neighbouring windows as one, with their best cosine."""
    at = np.flatnonzero(items.door[t.words >> np.uint64(64 - DOOR_BITS)])
    if not len(at) or not len(items.keys):
        return
    query, place = live_hits(t, items, at)
    if not len(query):
        return
    rows = np.zeros(len(t.bounds) - 1, bool)
    rows[t.row[place]] = True
    part, moved = t.only(rows)
    row, place, shift = t.row[place], moved[place], t.bounds - part.bounds
    sums, bounds = part.sums(terms)
    # Every window, STEP words apart, that holds the anchor; a text that has fewer words is one window.
    span = items.scale[query] // STEP
    spot = bounds[row] + (place - part.bounds[row]) // STEP
    low, high = np.maximum(spot - span + 1, bounds[row]), np.minimum(spot, np.maximum(bounds[row + 1] - span, bounds[row]))
    low = np.minimum(low, high)
    begin, query, row = ranges(low, high - low + 1), np.repeat(query, high - low + 1), np.repeat(row, high - low + 1)
    _, one = np.unique(query * (bounds[-1] + 1) + begin, return_index=True)
    for k in range(0, len(one), 1 << 16):
        begin_, query_, row_ = begin[one[k : k + (1 << 16)]], query[one[k : k + (1 << 16)]], row[one[k : k + (1 << 16)]]
        v = (sums[np.minimum(begin_ + items.scale[query_] // STEP, bounds[row_ + 1])] - sums[begin_]).astype(np.float32)
        close = np.einsum("ij,ij->i", v, items.unit[query_]) / (np.sqrt(np.einsum("ij,ij->i", v, v)) + np.float32(1e-12))
        good = np.flatnonzero(close >= items.bar[query_])
        if not len(good):
            continue
        begin_, query_, row_, close = begin_[good], query_[good], row_[good], close[good]
        edge = np.flatnonzero(np.concatenate(([True], (query_[1:] != query_[:-1]) | (row_[1:] != row_[:-1]) | ((begin_[1:] - begin_[:-1]) * STEP > items.scale[query_[1:]]))))
        last = np.append(edge[1:], len(good)) - 1
        row_, item, n = row_[edge], items.item[query_[edge]], items.stretch[query_[edge]] * 2 // 3
        first, stop = (part.bounds[row_] + (begin_[x] - bounds[row_]) * STEP + shift[row_] - items.start[query_[edge]] for x in (edge, last))
        lo, hi = np.maximum(t.bounds[row_], first - (n + 1) // 2), np.minimum(t.bounds[row_ + 1], stop + np.maximum(n, items.scale[query_[edge]]) + (n + 1) // 2)
        yield from zip(*(x.tolist() for x in (row_, item, np.maximum.reduceat(close, edge), lo, hi)), strict=True)


def short_hits(t: Text, items: Items):
    """(row, item, first word, word after the last) of short items that stand in a text as they are."""
    at = np.flatnonzero(np.isin(t.words, items.short_keys)) if len(items.short_keys) else ()
    for p in at:
        for k in range(int(np.searchsorted(items.short_keys, t.words[p], "left")), int(np.searchsorted(items.short_keys, t.words[p], "right"))):
            _, i, place = items.short[k]
            lo, own, row = int(p) - place, items.words[i], int(t.row[p])
            if lo >= t.bounds[row] and lo + len(own) <= t.bounds[row + 1] and (t.words[lo : lo + len(own)] == own).all():
                yield row, i, lo, lo + len(own)


def best_span(masks: dict[int, int], n: int, words: list[int]) -> tuple[int, int, int]:
    """The longest common subsequence within any stretch of 1.5 n words, a sixteenth of n apart: length, first, end."""
    size, step = max(n + n // 2, 1), max(1, n // 16)
    best = (0, 0, 0)
    for k in range(0, max(1, len(words) - size + step), step):
        part = words[k : k + size]
        best = max(best, (lcs_length(masks, n, part), -k, k + len(part)))
    return best[0], -best[1], best[2]


def check(t: Text, items: Items, item: int, lo: int, hi: int, sure: float, likely: float):
    """(share of the item, answer found, first word, end) or None."""
    words = t.words[lo:hi].tolist()
    masks, n, answer_masks, m = items.masks(item)
    # A subsequence of likely * n words leaves out at most (1 - likely) * n of the item's distinct words.
    if len(masks.keys() & set(words)) < len(masks) - (1 - likely) * n:
        return None
    if lcs_length(masks, n, words) < min(sure, likely) * n:  # no stretch has more than the whole
        return None
    length, begin, end = best_span(masks, n, words)
    answer = m > 0 and lcs_length(answer_masks, m, words[begin:end]) >= 0.9 * m
    if length >= sure * n or (length >= likely * n and answer):
        return length / n, answer, lo + begin, lo + end
    return None


def matches(t: Text, terms: np.ndarray, items: Items, sure: float, likely: float) -> dict[tuple[int, int], tuple]:
    """By row and item the best match: share of the item, cosine, answer, first word, end."""
    best: dict[tuple[int, int], tuple] = {}
    for r, item, c, lo, hi in candidates(t, terms, items) if len(t.words) else ():
        got = check(t, items, item, lo, hi, sure, likely)
        if got and (got[0], c) > best.get((r, item), (0.0, 0.0))[:2]:
            best[r, item] = (got[0], c, got[1], got[2] - int(t.bounds[r]), got[3] - int(t.bounds[r]))
    for r, item, lo, hi in short_hits(t, items):
        best.setdefault((r, item), (1.0, 1.0, True, lo - int(t.bounds[r]), hi - int(t.bounds[r])))
    return best


def blocks(benchmark: DataFrame, docs: DataFrame, cosine: float, likely: float, shortest: int, item_column: str = "item_id", item_text: str = "text", answer_column: str | None = None):
    """Blocks of at most about ITEM_BLOCK items, each broadcast with the latent terms."""
    answer = F.col(f"`{answer_column}`") if answer_column else F.lit(None)
    items = benchmark.select(F.col(f"`{item_column}`").alias("i"), F.col(f"`{item_text}`").alias("t"), answer.cast("string").alias("a")).filter("t is not null")
    many = -(-items.count() // ITEM_BLOCK)
    latent = latent_terms(docs) if many else None
    for k in range(many):
        rows = [(r["i"], r["t"], r["a"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k).sort("i", "t").collect()]
        yield docs.sparkSession.sparkContext.broadcast((Items(rows, latent, shortest, cosine, likely), latent[0]))


def without_items(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, sure: float = 0.8, likely: float = 0.6, shortest: int = 8) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item; rows without an id are judged like any other."""
    for block in blocks(benchmark, picked(docs, "text"), cosine, min(sure, likely), shortest):

        def clean(batches, block=block):
            known, terms = block.value
            for b, i, j, t in texts_of(batches):
                held = {r for r, _ in matches(t, terms, known, sure, likely)}
                yield b.slice(i, j - i).filter(pa.array([r not in held for r in range(j - i)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def find(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, sure: float = 0.8, likely: float = 0.6, shortest: int = 8,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", answer_column: str | None = None,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item), answer, start and end (words of the document): a row for each item in a document."""
    docs = picked(docs, id_column, text_column).toDF("doc_id", "text")
    found = docs.sparkSession.createDataFrame([], FOUND)
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    for block in blocks(benchmark, docs.select("text"), cosine, min(sure, likely), shortest, item_column, item_text, answer_column):

        def run(batches, block=block):
            known, terms = block.value
            for b, i, _, t in texts_of(batches):
                ids = b.column(0)
                rows = [(ids[i + r].as_py(), known.ids[item], c, share, answer, lo, hi) for (r, item), (share, c, answer, lo, hi) in sorted(matches(t, terms, known, sure, likely).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

        found = found.union(written(docs.mapInArrow(run, FOUND), "decontaminate-found"))
    return found


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document; clean documents have no row."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
