import heapq

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tokenizers import Tokenizer

from sluice.llm import huffman as H
from sluice.llm.tokens import vocabulary_path


def plain_huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=80))
def test_lengths_are_optimal_and_prefix_free(counts):
    counts = np.array(counts)
    if np.count_nonzero(counts) < 2:
        return
    lengths = H.code_lengths(counts, 60)
    assert (lengths * counts).sum() == plain_huffman_cost(counts.tolist())
    short = H.code_lengths(counts, 7)
    assert short.max() <= 7 and sum(2.0 ** -x for x in short[short > 0]) <= 1


@given(st.lists(st.integers(0, 40), max_size=700), st.integers(1, 5))
def test_blocks_round_trip(ids, k):
    ids = np.array(ids, np.uint32)
    lengths = H.code_lengths(np.bincount(ids, minlength=41), 12)
    payload, starts, points = H.encode_ids(ids, lengths, H.canonical(lengths), 32 * k, 8)
    back = H.decode_ids(payload, len(ids), starts, points, H.decode_table(lengths), 32 * k, 8)
    assert back.tolist() == ids.tolist() and len(payload) == -(-int(lengths[ids].sum()) // 8)


def test_round_trip_through_files(spark):
    path = vocabulary_path("word_bpe_49k.json")
    rows = [(7, "x", "Hello there, world"), (3, "x", None), (5, "x", ""), (1, "x", "ÉTÉ été " * 400), (None, "x", "first"), (9, "x", "An <|endoftext|>, a<|startoftext|>"), (3, "x", "twice the id")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens string, text string")
    got = sorted(H.round_trip(df, path).collect(), key=lambda r: r.start)
    enc = Tokenizer.from_file(path)
    assert [r.doc_id for r in got] == [None, 1, 3, 3, 5, 7, 9]
    at, texts = 0, {(r[0], r[2]) for r in rows}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        ids = np.frombuffer(r.ids, np.uint32).tolist()
        assert any(d == r.doc_id and [*enc.encode(t or "", add_special_tokens=False).ids, 2] == ids for d, t in texts)
    assert H.round_trip(df.limit(0), path).count() == 0


def test_a_folder_is_read_by_its_path_alone(spark, tmp_path):
    path, vocabulary = f"{tmp_path}/out", vocabulary_path("word_bpe_49k.json")
    texts = [(i, " ".join(f"word{k * i % 97} and more" for k in range(40 * i))) for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert H.encoded(df, vocabulary, limit=15, block=128, step=16, path=path) == path
    code = H.read_code(spark, path)
    assert (code.limit, code.block, code.step) == (15, 128, 16) and code.lengths.max() <= 15
    want = np.concatenate([np.frombuffer(r.ids, np.uint32) for r in sorted(H.read_files(spark, path).collect(), key=lambda r: (r.part, r.file, r.start_in_file))])
    enc, got = Tokenizer.from_file(vocabulary), []
    assert want.tolist() == [x for _, t in texts for x in [*enc.encode(t, add_special_tokens=False).ids, 2]]
    for r in sorted(H.files_of(spark, path).collect(), key=lambda r: (r.part, r.file)):
        for k in reversed(range(-(-r.n_ids // 128))):
            one = H.read_block(spark, path, r.part, r.file, k) if k % 5 == 0 else H.decode_block(r.asDict(), k, code)
            assert len(one) == min(128, r.n_ids - 128 * k)
            got.append((r.part, r.file, k, one))
    assert np.concatenate([x for *_, x in sorted(got, key=lambda x: x[:3])]).tolist() == want.tolist()
