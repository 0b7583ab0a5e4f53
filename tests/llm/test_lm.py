import math
from collections import Counter

import numpy as np
import pytest

from quarrylight.llm import lm


def brute(rows, order, k=lm.CONCENTRATION):
    tokens = {n: (t or "").encode().lower().split() + [0] for n, (_, t, _) in enumerate(rows)}
    counts = Counter()
    for n, w in tokens.items():
        if not rows[n][2]:
            for size in range(1, order + 1):
                counts.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (total + 0.1 * (distinct + 1))
        size = counts[gram[:-1]]
        return (counts[gram] + k * p(gram[1:])) / (size + k) if size else p(gram[1:])

    out = []
    for w in tokens.values():
        base = sum(math.log10(p((x,))) for x in w)
        out.append((len(w), sum(counts[(x,)] > 0 for x in w), total, base, sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_the_definition(spark, small_docs, order):
    rows = [(r.doc_id, r.text, r.doc_id % 4 == 0) for r in small_docs.limit(60).collect()] + [(901, None, False), (902, "", True), (903, "unseen wörds only", True), (903, "the THE the", False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens): (r.base_score, r.score) for r in lm.score(frame, order=order, block_bytes=9_000, bucket_bytes=20_000).collect()}
    want = {(r[0], *b[:3]): b[3:] for r, b in zip(rows, brute(rows, order), strict=True)}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-9)


@pytest.mark.parametrize("direct", [1, 4])
def test_relays_give_the_same(spark, small_docs, direct):
    """Many buckets and groups of blocks: the same scores as without relays."""
    from pyspark.sql import functions as F

    rows = small_docs.limit(60).repartition(3).withColumn("held_out", F.col("doc_id") % 4 == 0)
    rows = rows.select("doc_id", "text", "held_out").checkpoint()
    plain = sorted(map(tuple, lm.score(rows, block_bytes=3_000, bucket_bytes=500, direct=1 << 30).collect()))
    relayed = sorted(map(tuple, lm.score(rows, block_bytes=3_000, bucket_bytes=500, direct=direct).collect()))
    assert len(plain) == 60 and relayed == plain


def test_rows_grow_in_proportion():
    """What a block sends: with relays a row for each range, and no more ranges than the root of the buckets."""
    hashes = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 500_000, dtype=np.uint64))
    counts, sizes = np.ones(len(hashes), dtype=np.int64), {}
    for buckets, width in ((64, 1), (3750, 1), (12_500, 112), (12_500_000, 3536)):
        rows = lm.dealt(1, 1, lm.known_as(hashes, 1, buckets), counts, lm.bucket_of(hashes, buckets) // np.uint64(width))
        assert len(rows) == -(-buckets // width)
        sizes[buckets] = sum(len(r[3]) + len(r[4]) + 20 for r in rows) / len(hashes)
    assert max(sizes.values()) < 8.5, sizes


def test_probabilities_add_up():
    documents = [np.array([1, 2, 1, 3, lm.END], dtype=np.uint64), np.array([1, 2, lm.END], dtype=np.uint64)]
    grams = lm.Grams(documents, 2)
    counts = [np.bincount(a[a >= 0], minlength=len(h)) for a, h in zip(grams.at, grams.hashes, strict=True)]
    a = lm.Automaton(grams, counts, 8, 4, 4.0)
    for history in range(a.words):
        state = a.following[a.arcs[history]]
        if grams.hashes[0][history] == lm.END:  # nothing follows it
            assert state == 0
            continue
        assert state > 0
        chances = []
        for word in range(a.words):
            arc = a.arcs.get(state * a.words + word)
            chances.append(10 ** (a.weights[arc] if arc is not None else a.backoff[state] + a.weights[a.arcs[word]]))
        unseen = (0.1 / (8 + 0.1 * 5)) * 10 ** a.backoff[state]
        assert abs(sum(chances) + unseen - 1) < 1e-9


def test_stretches_carry_the_state(monkeypatch):
    rng = np.random.default_rng(3)
    documents = [np.r_[rng.integers(1, 9, n), lm.END].astype(np.uint64) for n in (0, 1, 40, 7)]
    grams = lm.Grams(documents, 3)
    seen = [np.bincount(a[:30][a[:30] >= 0], minlength=len(h)) for h, a in zip(grams.hashes, grams.at, strict=True)]
    a = lm.Automaton(grams, seen, 30, 9, 4.0)
    bounds = [(b, b + len(d)) for b, d in zip(grams.begin.tolist(), documents, strict=True)]
    whole = [a.traverse(*b) for b in bounds]
    monkeypatch.setattr(lm, "STRETCH", 3)
    assert [a.traverse(*b) for b in bounds] == whole


def test_small_counts():
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm.unsmall(lm.small(counts), 6).tolist() == counts.tolist()


def test_rising_numbers():
    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for some in (numbers, numbers[:1], np.array([0, 0, 7, (1 << 64) - 1], dtype=np.uint64)):
        assert lm.unrising(lm.rising(some)).tolist() == some.tolist()
    for buckets in (1, 5, 64, 100, 3750, 1 << 16, 1 << 20, 1 << 30):
        for n in (0, 1):
            known = lm.known_as(numbers, n, buckets)
            assert len(np.unique(known)) == len(numbers) and (np.diff(known.astype(object)) > 0).all()
            bits = lm.cut_bits(n, buckets)
            assert (lm.bucket_of(known << np.uint64(bits), buckets) == lm.bucket_of(numbers, buckets)).all()
            assert bits == 0 or (2**64 / buckets) / 2**bits >= 2**lm.BESIDE


def test_better_than_the_base_on_held_out_texts(spark, small_docs):
    from pyspark.sql import functions as F

    rows = lm.score(small_docs.withColumn("held_out", F.col("doc_id") % 10 == 0)).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(odd, nothing):
    from pyspark.sql import functions as F

    rows = lm.score(odd.withColumn("held_out", F.lit(False)), block_bytes=1000, bucket_bytes=100_000).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1} and {r.n_tokens for r in rows if r.doc_id == 6} == {180_001}
    assert lm.score(nothing.withColumn("held_out", F.lit(False))).count() == 0
    assert {r.n_known for r in lm.score(odd.withColumn("held_out", F.lit(True))).collect()} == {0}
