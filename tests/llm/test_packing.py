from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm.packing import assign, open_sequences, pack
from sluice.llm.tokens import PieceEncoder, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 40), max_size=60))
def test_assign_fills_sequences_without_gaps(lengths):
    pieces = assign(lengths, 16)
    capacity = open_sequences(sum(lengths), 16)
    assert all(c == 16 or c & (c - 1) == 0 for c in capacity)
    at, of = defaultdict(int), defaultdict(list)
    for i, start, n, to, offset in pieces:
        assert offset == at[to] and n > 0
        at[to] += n
        of[i].append((start, n))
    assert [at[k] for k in range(len(capacity))] == capacity
    for i, n in enumerate(lengths):
        assert [s for s, _ in sorted(of[i])] == list(np.cumsum([0, *[x for _, x in sorted(of[i])]])[:-1]) and sum(x for _, x in of[i]) == n


def in_order(lengths, most):
    """Costs of sequences that are filled one after the other."""
    costs, room = [0.0], most
    for n in lengths:
        while n:
            put = min(n, room)
            costs[-1] += put + put * put / 1024
            n, room = n - put, room - put
            if not room:
                costs, room = [*costs, 0.0], most
    return np.array(costs[:-1])


@pytest.mark.parametrize(("mean", "spread"), [(5.5, 0.8), (5.5, 1.2), (4.0, 0.5), (6.5, 1.0)])
def test_sequences_cost_alike(spark, mean, spread):
    words = np.maximum(1, np.random.default_rng(8).lognormal(mean, spread, 2000).astype(int))
    df = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(words.tolist())], "doc_id long, text string").coalesce(1)
    rows = pack(df, PATH).select("doc_id", "length", "doc_tokens", "sequence_id").collect()
    costs, held = defaultdict(float), defaultdict(int)
    for r in rows:
        costs[r.sequence_id] += r.length + r.length**2 / 1024
        held[r.sequence_id] += r.length
    full = np.array([c for k, c in costs.items() if held[k] > 700])  # without a small last buffer's short ones
    plain = in_order([t for _, t in sorted({(r.doc_id, r.doc_tokens) for r in rows})], 1024)
    assert full.std() / full.mean() < 0.5 * plain.std() / plain.mean() and full.max() / full.mean() < plain.max() / plain.mean()
    padded = sum(1024 - n for n in held.values() if n & (n - 1))
    assert padded <= 0.015 * sum(held.values())


def test_dearest_goes_to_cheapest():
    costs = defaultdict(float)
    for _, _, n, to, _ in assign([8] * 8, 16):
        costs[to] += n + n * n
    assert len(set(costs.values())) == 1


def test_pack_round_trip(spark):
    texts = {7: "a <|endoftext|> b<|endoftext|>", 8: "<|endoftext|>", 1: "one two three " * 50, 2: None, 3: "", 4: "x" * 3000 + " y", 5: "héllo wörld.\n\nagain  ", 6: "one two three " * 50}
    rows = [(k, "clash", t) for k, t in texts.items()] + [(None, "clash", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, length string, text string")
    got = pack(df, PATH, max_tokens=64).collect()
    enc = Tokenizer.from_file(PATH)
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for k, t in {**texts, None: "no id"}.items():
        want = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        parts = sorted(by[k], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, np.uint32) for r in parts])
        assert list(ids) == list(want) and {r.doc_tokens for r in parts} == {len(want)}
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
    for rs in seq.values():
        rs.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rs)
        assert [r.offset for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]] and (total == 64 or total & (total - 1) == 0)
    assert pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_tokenizers_ids(name, kind):
    import pyarrow as pa

    from sluice.llm.common import utf8_of

    enc, alone = PieceEncoder(vocabulary_path(name), kind), Tokenizer.from_file(vocabulary_path(name))
    letters = st.text(alphabet=st.sampled_from("ab1 .\n\t'\xa0　\x85\x1ceÉ́Σ̈’!sS"), max_size=30)
    special = st.lists(st.one_of(letters, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"])), max_size=5).map("".join)

    @given(st.lists(st.one_of(letters, special), max_size=6))
    def same(texts):
        ids, n = enc.encode(*utf8_of(pa.array(texts, pa.string())))
        want = [alone.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]

    same()
