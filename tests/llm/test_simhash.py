import numpy as np
import pytest
import xxhash

from quarrylight.llm import simhash


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed=42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, limit):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_given_documents(spark, small_docs):
    rows = small_docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    want = classes([r.doc_id for r in rows], prints, 2)
    got = {r.doc_id: (r.w0 & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(small_docs).collect()}
    assert got == {r.doc_id: (p, want[r.doc_id]) for r, p in zip(rows, prints, strict=True)}


@pytest.mark.parametrize("block_bits", [16, 32, 64])
def test_all_near_words_meet_at_an_anchor(block_bits):
    masks, begin = simhash.error_table(block_bits, 2)
    rng = np.random.default_rng(5)

    def anchors(x):
        s = int(simhash.syndrome_of(np.array([x], dtype=np.uint64), block_bits)[0])
        return {x ^ int(m) for m in masks[begin[s] : begin[s + 1]]}

    for _ in range(300):
        x = int(rng.integers(0, 1 << min(block_bits, 63)))
        bits = rng.choice(block_bits, size=int(rng.integers(0, 3)), replace=False)
        y = x ^ sum(1 << int(b) for b in bits)
        assert anchors(x) & anchors(y)


def test_links_by_distance(spark):
    rng = np.random.default_rng(2)
    prints = []
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        prints.append(x)
        for d in (1, 2, 3):
            prints.append(x ^ sum(1 << int(b) for b in rng.choice(64, size=d, replace=False)))
    signed = [(n, p - (1 << 64) if p >> 63 else p) for n, p in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "node long, w0 long")
    labels = {r.node: r.label for r in simhash.components(simhash.anchor_edges(nodes, 1, 64, 2, 2)).collect()}
    want = classes(list(range(len(prints))), prints, 2)
    assert {n: labels.get(n, n) for n in want} == want


def test_long_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 999) for i in range(200)] + [(5000, 4000), (5000, 4500)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 999 for i in range(200)) and got[5000] == got[4500] == 4000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_fingerprints_find_similar_texts(spark):
    rng = np.random.default_rng(9)
    words = [f"w{n}" for n in range(5000)]
    rows = []
    for n in range(60):
        text = [words[k] for k in rng.integers(5000, size=400)]
        rows.append((2 * n, " ".join(text)))
        text[int(rng.integers(400))] = "other"
        text[int(rng.integers(400))] = "another"
        rows.append((2 * n + 1, " ".join(text)))  # at least 0.95 similar
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.WIDE).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_recall_of_near_copies(spark):
    """Held-out pairs whose shingles are 0.8 to 0.95 similar: made here, not used to choose any parameter."""
    rng = np.random.default_rng(77)
    words = [f"w{n}" for n in range(3000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, similar = [], []
    while len(similar) < 300:
        text = [words[k] for k in rng.integers(3000, size=int(rng.integers(60, 600)))]
        other = list(text)
        for at in rng.integers(len(text), size=int(rng.integers(1, max(2, len(text) // 40)))):
            other[at : at + 1] = [[], ["new"], ["two", "new"]][int(rng.integers(3))]
        a, b = shingles(text), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.95:
            n = 2 * len(similar)
            rows += [(n, " ".join(text)), (n + 1, " ".join(other))]
            similar.append(n)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.WIDE).collect()}
    assert all(c // 2 == n // 2 for n, c in got.items())  # different texts stay apart
    assert np.mean([got[n] == got[n + 1] for n in similar]) >= 0.9


def test_different_texts_with_one_id(spark):
    far, near = " ".join(f"aa{n}" for n in range(300)), " ".join(f"b{n}" for n in range(300))
    rows = [(1, far), (1, near), (2, far + " x"), (3, near + " x"), (0, "alone")]
    for settings in ({}, simhash.WIDE):
        out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n"), keep=("n",), **settings).collect()
        got = {(r.doc_id, r.n): r.component_id for r in out}
        assert len(got) == 5 and got[1, len(far)] == got[1, len(near)] == 1 and got[0, 5] == 0
        if settings:
            assert got[2, len(far) + 2] == got[3, len(near) + 2] == 1


def test_large_groups_are_whole():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, size=(5, 2)).astype(np.uint64)
    words = base[rng.integers(5, size=600)] ^ (np.uint64(1) << rng.integers(0, 12, size=(600, 2)).astype(np.uint64))
    for limit in (1, 2, 4):
        want = classes(list(range(600)), [int(a) << 64 | int(b) for a, b in words], limit)
        got = dict(simhash.local_stars(np.arange(600), words, limit, step=7))
        assert {n: got.get(n, n) for n in range(600)} == want


def test_odd_rows(odd, nothing):
    got = [(r.doc_id, r.component_id, r.w0) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 10 and {(c, w) for i, c, w in got if i in (2, 3, 4)} == {(2, 0)}
    assert [c for i, c, _ in got if i == 1] == [1, 1] and [c for i, c, _ in got if i is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(odd, **simhash.WIDE).count() == 10
