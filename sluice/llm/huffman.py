"""Token ids in a compact binary format: canonical length-limited Huffman codes (operator 3).

Lengths come from the counts of all ids in the corpus (package-merge, no code over `limit` bits), so
they are optimal under the limit. A file holds whole documents: its ids in blocks of `block` ids,
and in each block a checkpoint (bit offset) every `step` ids. Checkpoints let a reader decode all
runs of a file side by side: one table look-up gives id and code length for every run at once.

A folder holds two tables that Spark's Parquet writer makes (no task can count on a local folder).
`header`, one row: the code length of every id (one byte each, zlib), from which the canonical codes
follow, and limit, block and step. `files`, one row for each file: part, file, n_ids, doc_ids, known
(whether the doc_id is one), doc_tokens, block_bits (start of each block), checkpoints (from the block's
start), payload (bits, most significant first). Files follow in the order of doc_id. The path alone is
enough to read a folder, or one block of a file.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows of equal
doc_id follow by their ids; an empty table gives no rows; further columns are not read.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, picked, small_batches, table, utf8_of, written
from .tokens import encoder, vocabulary_path

TOKENS = "doc_id long, n_tokens long, ids binary"
FILES = "part int, file int, n_ids long, doc_ids binary, known binary, doc_tokens binary, block_bits binary, checkpoints binary, payload binary"
HEADER = "lengths binary, size int, limit int, block int, step int"
READ = "part int, file int, doc_id long, start_in_file long, n_tokens long, ids binary"


@dataclass(frozen=True)
class Code:
    """What a folder's header says."""

    lengths: np.ndarray
    limit: int = 16
    block: int = 1 << 16
    step: int = 64


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the symbols with a count; 0 for the others."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights, packages, leaves = counts[used].astype(float), np.zeros(0), []
    for _ in range(limit):
        pool = np.concatenate((weights, packages))
        order = np.argsort(pool, kind="stable")
        leaves.append(order < len(weights))
        merged = pool[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes that rise with length and then with the symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - last
        codes[s], last = code, int(lengths[s])
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next `bits` bits: the symbol and the length of its code."""
    bits = max(1, int(lengths.max(initial=0)))
    symbols, sizes = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    have = np.flatnonzero(lengths)
    have = have[np.lexsort((have, lengths[have]))]
    span = 1 << (bits - lengths[have])
    filled = int(span.sum())
    symbols[:filled], sizes[:filled] = np.repeat(have, span), np.repeat(lengths[have], span)
    return symbols, sizes, bits


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int, step: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload, start of each block in bits, checkpoints in bits from their block's start."""
    size = lengths[ids]
    upto = np.concatenate(([0], np.cumsum(size)))
    at = upto[:-1]
    words = np.zeros(int(upto[-1] // 32) + 2, np.uint64)
    if len(ids):
        word = at >> 5
        frame = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(frame >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(frame & np.uint64(0xFFFFFFFF), first)
    payload = words.astype(">u4").tobytes()[: int(upto[-1] + 7) // 8]
    starts, points = at[::block], at[::step]
    return payload, starts, points - np.repeat(starts, -(-block // step))[: len(points)]


def decode_ids(payload: bytes, n: int, starts: np.ndarray, points: np.ndarray, table_: tuple, block: int, step: int) -> np.ndarray:
    """The ids; every run from a checkpoint to the next is read in step with all others."""
    symbols, sizes, bits = table_
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = points + np.repeat(starts, -(-block // step))[: len(points)]
    out = np.zeros((len(points), step), np.uint32)
    for k in range(step):
        live = len(points) if k < n - (len(points) - 1) * step else len(points) - 1
        if live <= 0:
            break
        here = at[:live]
        value = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[:live, k] = symbols[value]
        here += sizes[value]
    return out.ravel()[:n]


def decode_block(file: dict, k: int, code: Code, table_: tuple | None = None) -> np.ndarray:
    """The ids of a file's block k alone, from the bytes that hold it; file: a row of the table `files`."""
    starts, points = np.frombuffer(file["block_bits"], "<i8"), np.frombuffer(file["checkpoints"], "<u4").astype(np.int64)
    each = -(-code.block // code.step)
    first, last = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else 8 * len(file["payload"])
    part = file["payload"][first // 8 : -(-last // 8)]
    n = min(code.block, file["n_ids"] - k * code.block)
    return decode_ids(part, n, np.array([first % 8]), points[k * each : (k + 1) * each], table_ or decode_table(code.lengths), code.block, code.step)


def id_type(size: int) -> str:
    """How the ids of a vocabulary are stored: little-endian, in two bytes if they fit."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, vocabulary: str, kind: str, end_id: int, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (of id_type(size), with the end id)."""
    kept = np.dtype(id_type(size))

    def rows(batches):
        enc = encoder(vocabulary, kind)
        for b in batches:
            doc_ids = b.column(0)
            for first, last, ids, counts in enc.slices(*utf8_of(b.column(1))):
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, np.uint32(end_id)).astype(kept)  # after each document's ids
                cuts = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                binary = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer((cuts * kept.itemsize).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, last - first), pa.array(counts + 1), binary.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return picked(docs, id_column, text_column).mapInArrow(rows, TOKENS)


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: one row for each id and task before the shuffle, the vocabulary's size at the driver."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, id_type(size)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def write_files(ids: DataFrame, code: Code, path: str, file_ids: int = 1 << 20) -> None:
    """Header and encoded files, in ascending order of doc_id, in a new folder."""
    lengths, codes, block, step = code.lengths, canonical(code.lengths), code.block, code.step

    def rows(batches):
        part, file, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal file, held, n
            flat = np.concatenate([np.frombuffer(x[2], id_type(len(lengths))) for x in held])
            payload, starts, points = encode_ids(flat, lengths, codes, block, step)
            row = [part, file, len(flat), np.array([x[0] or 0 for x in held], "<i8").tobytes(), np.array([x[0] is not None for x in held]).tobytes(), np.array([x[1] for x in held], "<i8").tobytes(), starts.astype("<i8").tobytes(), points.astype("<u4").tobytes(), payload]
            file, held, n = file + 1, [], 0
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in FILES.split(", ")])

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(x)
                n += x[1]
                if n >= file_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    head = [(bytearray(zlib.compress(lengths.astype(np.uint8).tobytes())), len(lengths), code.limit, block, step)]
    ids.sparkSession.createDataFrame(head, HEADER).coalesce(1).write.parquet(f"{path}/header")
    with small_batches(ids.sparkSession):
        ordered.mapInArrow(rows, FILES).write.option("compression", "none").parquet(f"{path}/files")


def read_code(spark: SparkSession, path: str) -> Code:
    head = spark.read.schema(HEADER).parquet(f"{path}/header").first()
    return Code(np.frombuffer(zlib.decompress(head["lengths"]), np.uint8).astype(np.int64), head["limit"], head["block"], head["step"])


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path}/files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder's files: part, file, doc_id, start_in_file (ids before it), n_tokens, ids."""
    code = read_code(spark, path)
    look_up, block, step = decode_table(code.lengths), code.block, code.step

    def rows(batches):
        for b in batches:
            for f in b.to_pylist():
                ids = decode_ids(f["payload"], f["n_ids"], np.frombuffer(f["block_bits"], "<i8"), np.frombuffer(f["checkpoints"], "<u4").astype(np.int64), look_up, block, step)
                counts = np.frombuffer(f["doc_tokens"], "<i8")
                cuts = np.concatenate(([0], np.cumsum(counts)))
                binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                doc_ids = pa.array(np.frombuffer(f["doc_ids"], "<i8"), mask=~np.frombuffer(f["known"], bool))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([f["part"]] * n, pa.int32()), pa.array([f["file"]] * n, pa.int32()), doc_ids, pa.array(cuts[:-1]), pa.array(counts), binary], [c.split()[0] for c in READ.split(", ")])

    return files_of(spark, path).mapInArrow(rows, READ)


def read_block(spark: SparkSession, path: str, part: int, file: int, k: int) -> np.ndarray:
    """The ids of one block of one file."""
    row = files_of(spark, path).filter((F.col("part") == part) & (F.col("file") == file)).drop("doc_ids", "known", "doc_tokens").first()
    return decode_block(row.asDict(), k, read_code(spark, path))


def with_start(docs: DataFrame, files: DataFrame) -> DataFrame:
    """start (the ids of all documents before) in place of part, file and start_in_file.

    Sums run over one row for each file of a part, and then over one for each part.
    """
    heads = files.select("part", "file", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(base, "part")
    heads = heads.select("part", "file", (F.col("base") + F.col("before")).alias("file_start"))
    return docs.join(heads, ["part", "file"]).withColumn("start", F.col("file_start") + F.col("start_in_file")).drop("part", "file", "file_start", "start_in_file")


def encoded(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 2, size: int = 49_408, limit: int = 16, block: int = 1 << 16, step: int = 64, path: str | None = None) -> str:
    """Tokenise, count and encode documents into a new folder (one in the shared folder unless named): its path."""
    path = path or new_path(docs.sparkSession, "huffman-files")
    ids = written(tokens(docs, vocabulary, kind, end_id, size), "token-ids", "zstd")
    write_files(ids, Code(code_lengths(id_counts(ids, size), limit), limit, block, step), path)
    return path


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids, start of every document, from its file."""
    spark, path = docs.sparkSession, encoded(docs, vocabulary, **options)
    return with_start(read_files(spark, path), files_of(spark, path))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word-level ids with end id 2, through Huffman files and back: one row for each document."""
    path = encoded(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    docs = read_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # ids need not travel to their start
    return with_start(docs, files_of(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
