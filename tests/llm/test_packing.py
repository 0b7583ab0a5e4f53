import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import packing
from quarrylight.llm.queries import byte_bpe

TOKENIZER = Tokenizer.from_file(byte_bpe())
ENCODER = packing.Encoder(byte_bpe())
UNITS = [*"abX \n\t'.,!1é日\xa0 \x1c<|>s²\x85\u3000ǅ٣", "<|endoftext|>", "'ll", "the", " of", "  ", "\r\n", "e\u0301", "🙂", "x" * 200]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(UNITS), max_size=40).map("".join) | st.text(max_size=30))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_all_characters():
    """Both libraries must put every character into the same class."""
    characters = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}x {c}1{c}! {c}{c}  a{c} 7{c}?{c} " for c in map(chr, characters)]
    for text, want in zip(texts, TOKENIZER.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("text", [" " * 300_000, "a" + "\n" * 300_000 + "b", "x" * 300_000, " a" * 100_000, "日" * 100_000])
def test_ids_of_long_runs(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_files(tmp_path):
    """A vocabulary whose merges are in another order than its ids is left to tokenizers."""
    import json

    with open(byte_bpe(), encoding="utf-8") as f:
        told = json.load(f)
    told["model"]["merges"] = told["model"]["merges"][::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    other = packing.Encoder(str(path))
    assert other.merging is None and ENCODER.merging is not None
    text = "the plain words, and 12 more"
    assert np.frombuffer(other.encode(text), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def pieces_of(text, capacity=2048):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or min(capacity, len(ids))
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def check_places(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_given_documents(small_docs):
    rows = packing.pack(small_docs, byte_bpe()).collect()
    want = sorted((r.doc_id, *p) for r in small_docs.collect() for p in pieces_of(r.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_places(rows)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


@lru_cache(maxsize=None)
def optimum(sizes, capacity):
    """The fewest bins, by trying all sets that hold the largest item."""
    if not sizes:
        return 0
    largest, rest = sizes[-1], sizes[:-1]
    best = 99

    def fill(at, room, left):
        nonlocal best
        if at < 0:
            best = min(best, 1 + optimum(left, capacity))
            return
        if rest[at] <= room:
            out = list(left)
            out.remove(rest[at])
            fill(at - 1, room - rest[at], tuple(out))
        fill(at - 1, room, left)

    fill(len(rest) - 1, capacity - largest, rest)
    return best


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1).astype(np.int64)


@pytest.mark.parametrize("seed", range(200))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    if seed % 2:  # many items of few sizes
        sizes = [rng.choice(sizes[:3]) for _ in range(10)]
    counts = histogram(sizes, capacity)
    fixed = packing.reduce_dominated(counts, capacity)
    rest = tuple(s for s in range(capacity + 1) for _ in range(counts[s]))
    assert sorted([s for f, n in fixed for s in list(f) * n] + list(rest)) == sorted(sizes)
    assert all(sum(f) <= capacity for f, _ in fixed)
    assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(tuple(sorted(sizes)), capacity)


@pytest.mark.parametrize("seed", range(20))
def test_work_does_not_grow_with_the_counts(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, dtype=np.int64)
    sizes = rng.choice(np.arange(1, 2049), size=60, replace=False)
    counts[sizes] = rng.integers(1, 50, size=60)
    for times in (1, 1000, 10**9):
        patterns = packing.plan(counts * times)
        assert len(patterns) <= 4 * len(sizes)
        used = np.zeros(2049, dtype=np.int64)
        for own, n in patterns:
            np.add.at(used, list(own), n)
        assert (used == counts * times).all()
    one_size = np.zeros(2049, dtype=np.int64)
    for n in (10_000, 40_000):
        one_size[1000] = n
        assert packing.plan(one_size) == [((1000, 1000), n // 2)]


@pytest.mark.parametrize("seed", range(20))
def test_patterns_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = 50
    sizes = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
    rooms: list[int] = []
    for s in sizes:
        fitting = [r for r in rooms if r >= s]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - s)
    patterns = packing.best_fit(histogram(sizes, capacity), capacity)
    assert sorted(capacity - sum(p) for p, n in patterns for _ in range(n)) == sorted(rooms)


def test_odd_rows(odd, nothing):
    rows = packing.pack(odd, byte_bpe()).collect()
    check_places(rows)
    assert sum(r.doc_id == 1 for r in rows) == 2 and [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert all(n == 2048 for _, _, n in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))
    assert packing.pack(nothing, byte_bpe()).count() == 0
