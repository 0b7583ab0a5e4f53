"""SimHash near-duplicates by anchor points of a covering code (operator 6).

A fingerprint is cut into blocks of 2^r bits. The anchors of a block are the words of the
Hamming code on bits 1 .. 2^r - 1 with bit 0 left free: a word is an anchor if the positions of
its set bits have XOR zero. This code has covering radius 1. If two blocks differ in t bits,
there is a block half-way between them, whose anchor is within 1 + ceil(t / 2) of both; so each
fingerprint goes to every anchor that near, and links are looked for at each anchor. For
64-bit blocks and t = 2 that is 33 anchors, and an anchor can get no more than the 2081
blocks within distance 2 of it.

Fingerprints of several words are cut into several blocks. Blocks of 32 bits of unrelated texts meet by chance (529 of
2^32 are near), so a word of the fingerprint that isn't posted travels with each block, and only rows that agree in most of
its bits go on: the whole fingerprints are fetched for one chance meeting in a hundred.

Equal fingerprints are one class from the start, and an anchor reports a star for each group
that it finds instead of all pairs, so rows stay in proportion to the number of documents.
Classes are joined by rounds of large-star and small-star on the edges, each cut with a
checkpoint.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; repeated rows are equal fingerprints; an empty table gives no rows; other
columns are ignored; the smallest doc_id names a class, and rows with a null doc_id stay alone. Different texts with one
doc_id are different members: each row has the class of its own text.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import cut, mix64

SEED = 42
#: Five-word shingles at a similarity of about 0.8 or more.
WIDE = {"width": 5, "words": 16, "posted": 8, "block_bits": 32, "block_limit": 2, "limit": 172}
#: Bits of the word beside a block in which two rows may differ. Links of 172 bits in 1024 differ in more than that once in
#: 5,000 times, unrelated rows in 99 of 100.
BESIDE_LIMIT = 22
_NODE_BITS = 53
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` words, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b]) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    padded[:n] = hashes
    rows = padded.reshape(-1, 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for k in range(8):  # one bit of each byte at a time, eight counters in a word
        lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and w0, w1, ...: 64-bit words as signed longs. Words after the first come from remixed hashes."""
    names = [f"w{k}" for k in range(words)]

    def run(batches):
        for batch in batches:
            out = np.zeros((words, batch.num_rows), dtype=np.uint64)
            for row, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), width)
                for k in range(words):
                    out[k, row] = majority(hashes if k == 0 else mix64(hashes + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", *keep, *names])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in keep), *(T.StructField(n, T.LongType()) for n in names)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).mapInArrow(run, schema)


def error_table(block_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All error words of weight up to `radius`, sorted by syndrome, and where each syndrome's begin."""
    masks, syndromes = [], []
    for weight in range(radius + 1):
        for places in combinations(range(block_bits), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p
            masks.append(sum(1 << p for p in places))
            syndromes.append(syndrome)
    order = np.argsort(syndromes, kind="stable")
    return np.array(masks, dtype=np.uint64)[order], np.searchsorted(np.array(syndromes)[order], np.arange(block_bits + 1))


def syndrome_of(blocks: np.ndarray, block_bits: int) -> np.ndarray:
    out = np.zeros(len(blocks), dtype=np.int64)
    for place in range(1, block_bits):
        out ^= ((blocks >> np.uint64(place)) & np.uint64(1)).astype(np.int64) * place
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between each row of a and each row of b."""
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(a.shape[1]))


def local_stars(nodes: np.ndarray, words: np.ndarray, limit: int, step: int = 256) -> list[tuple[int, int]]:
    """Edges (node, smallest node) of the connected groups of one anchor's rows, which are sorted by node.

    A search from each smallest node left: who is reached is never compared again, so a group of copies costs about
    one comparison a row.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(len(nodes))
    while len(left):
        first, left = left[0], left[1:]
        queue = [np.array([first])]
        while queue and len(left):
            part = queue.pop()
            if len(part) > step:
                queue.append(part[step:])
                part = part[:step]
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(left), 4096):
                near[at : at + 4096] = (distances(words[part], words[left[at : at + 4096]]) <= limit).any(axis=0)
            if near.any():
                queue.append(left[near])
                edges += [(int(n), int(nodes[first])) for n in nodes[left[near]]]
                left = left[~near]
    return edges


def _by_key(batches, words: int):
    """Rows (key, node, words..) of a partition, sorted, and the bounds of the keys with two rows or more."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return None
    key, node = table.column(0).to_numpy(), table.column(1).to_numpy()
    w = np.stack([table.column(2 + k).to_numpy().view(np.uint64) for k in range(words)], axis=1)
    order = np.lexsort((node, key))
    key, node, w = key[order], node[order], w[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key, node, w, new, np.diff(np.r_[new, len(node)])


def _stars(limit: int, words: int):
    """From rows (key, node, words..), each key in one partition, to the edges of the groups at each key."""

    def run(batches):
        if (rows := _by_key(batches, words)) is None:
            return
        _, node, w, new, size = rows
        two = new[size == 2]
        near = two[np.bitwise_count(w[two] ^ w[two + 1]).astype(np.int16).sum(axis=1) <= limit]
        found = set(zip(node[near + 1].tolist(), node[near].tolist(), strict=True))
        for at, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found.update(local_stars(node[at : at + n], w[at : at + n], limit))
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _near_rows(limit: int, block_bits: int, block_limit: int):
    """From rows (key, node with place, beside) to those rows (key, node) that have another one of their key within the limits.

    Two blocks meet at several anchors; only the smallest anchor that they have in common keeps them. A key with very
    many rows keeps all with near blocks, whatever stands beside them; the whole fingerprints decide in any case.
    """
    masks, begin = error_table(block_bits, 1 + -(-block_limit // 2))
    low = np.uint64((1 << block_bits) - 1)

    def run(batches):
        @lru_cache(maxsize=100_000)
        def anchors(block: int) -> frozenset[int]:
            s = int(syndrome_of(np.array([block], dtype=np.uint64), block_bits)[0])
            return frozenset((masks[begin[s] : begin[s + 1]] ^ np.uint64(block)).tolist())

        def first_here(x: int, y: int, anchor: int) -> bool:
            return min(anchors(x) & anchors(y)) == anchor

        if (rows := _by_key(batches, 1)) is None:
            return
        key, node, w, new, size = rows
        anchor, beside = key.view(np.uint64) & low, w[:, 0]
        block = anchor ^ masks[node >> _NODE_BITS]
        kept = np.zeros(len(node), dtype=bool)
        two = new[size == 2]
        close = (np.bitwise_count(block[two] ^ block[two + 1]) <= limit) & (np.bitwise_count(beside[two] ^ beside[two + 1]) <= BESIDE_LIMIT)
        for at in two[close].tolist():
            kept[at : at + 2] = first_here(int(block[at]), int(block[at + 1]), int(anchor[at]))
        for at, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = block[at : at + n]
            if n <= 256:
                near = np.triu((distances(own[:, None], own[:, None]) <= limit) & (distances(beside[at : at + n, None], beside[at : at + n, None]) <= BESIDE_LIMIT), 1)
                for x, y in zip(*np.nonzero(near), strict=True):
                    if not (kept[at + x] and kept[at + y]) and first_here(int(own[x]), int(own[y]), int(anchor[at])):
                        kept[[at + x, at + y]] = True
                continue
            # all lie close to the anchor, so there are few different blocks, however many rows
            own, place, many = np.unique(own, return_inverse=True, return_counts=True)
            near = np.zeros(len(own), dtype=bool)
            for x, y in zip(*np.nonzero(np.triu(distances(own[:, None], own[:, None]) <= limit)), strict=True):
                if (x != y or many[x] > 1) and first_here(int(own[x]), int(own[y]), int(anchor[at])):
                    near[[x, y]] = True
            kept[at : at + n] = near[place]
        yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept] & ((1 << _NODE_BITS) - 1))], names=["key", "node"])

    return run


def post(nodes: DataFrame, words: int, block_bits: int, block_limit: int, beside: str | None = None) -> DataFrame:
    """key, node, block: each node (0 to 2^53) at every anchor of each of its blocks.

    Of several blocks the key is the block's number above the anchor, the node has the number of its error word above it
    (anchor and error word give the block), and the column `beside` takes the block's place.
    """
    if block_bits > 32 and words * 64 > block_bits:
        raise ValueError("several blocks can have 32 bits each at most")
    masks, begin = error_table(block_bits, 1 + -(-block_limit // 2))
    blocks = [(w, s) for w in range(words) for s in range(0, 64, block_bits)]

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for number, (word, shift) in enumerate(blocks):
                own = (batch.column(1 + word).to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << block_bits) - 1)
                s = syndrome_of(own, block_bits)
                many = begin[s + 1] - begin[s]
                row = np.repeat(np.arange(len(own)), many)
                at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[s][row]
                key, named, block = own[row] ^ masks[at], node[row], own.view(np.int64)[row]
                if beside:
                    key, named, block = key | np.uint64(number << 32), named | (at << _NODE_BITS), batch.column(1 + words).to_numpy()[row]
                table = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(named), pa.array(block)], names=["key", "node", "block"])
                for a in range(0, len(row), 50_000):
                    yield table.slice(a, 50_000)

    return nodes.select("node", *(f"w{k}" for k in range(words)), *([beside] if beside else [])).mapInArrow(run, "key long, node long, block long")


def anchor_edges(nodes: DataFrame, words: int, block_bits: int, block_limit: int, limit: int, posted: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, between the nodes of linked fingerprints, found at common anchors of their first `posted` words.

    If a fingerprint is more than one block, the word after the posted ones stands beside each block, and the whole
    fingerprints are only fetched for the rows that have a near row at their anchor.
    """
    if words * 64 == block_bits:
        at_anchor = post(nodes, words, block_bits, block_limit).repartition("key")
        return at_anchor.mapInArrow(_stars(min(block_limit, limit), 1), "a long, b long").distinct()
    posted = posted or words - 1
    if not 0 < posted < words:
        raise ValueError("a word of the fingerprint stays beside the posted ones")
    at_anchor = post(nodes, posted, block_bits, block_limit, f"w{posted}").repartition("key")
    near = at_anchor.mapInArrow(_near_rows(block_limit, block_bits, block_limit), "key long, node long")
    names = [f"w{k}" for k in range(words)]
    whole = near.join(nodes.select("node", *names), "node").select("key", "node", *names).repartition("key")
    return whole.mapInArrow(_stars(limit, words), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that each node of the edges (a > b) reaches.

    Large-star joins every larger neighbour of a node to the node's smallest neighbour, small-star
    the smaller ones; both are run until the edges stay as they are, when each component is a star.
    """
    edges = cut(edges.select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 3, words: int = 1, block_bits: int = 64, block_limit: int = 2, limit: int = 2, posted: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, w0.., component_id and group_no for every row.

    group_no tells classes apart also where different texts have one doc_id; its numbers change from run to run.
    Fingerprints of `words` x 64 bits are linked if they differ in at most `limit` bits and some block of
    `block_bits` bits of the first `posted` words (all but one, if None) in at most `block_limit`. With one word and one block
    the smaller limit counts.

    For word shingles with similarity J each bit differs with probability acos(2J / (1 + J)) / pi for equally long
    texts: 0.151 at 0.8, or 155 of 1024 bits with a deviation of 11. WIDE allows 172; the measured recall is in the README.
    """
    names = [f"w{k}" for k in range(words)]
    prints = cut(fingerprints(docs, width, words, keep))
    # A node is a fingerprint. Its number is made once, before the checkpoint.
    nodes = cut(prints.filter("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    labels = cut(components(anchor_edges(nodes, words, block_bits, block_limit, limit, posted)))
    members = labels.union(labels.select("label", "label").distinct()).join(nodes.select("node", "first"), "node")
    ids = members.groupBy("label").agg(F.min("first").alias("component_id"))
    named = nodes.join(members.select("node", "label").join(ids, "label"), "node", "left").select(*names, F.coalesce("component_id", "first").alias("component_id"), F.coalesce("label", "node").alias("group_no"))
    own = (F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("component_id", "group_no"))
    return prints.join(named, names, "left").select("doc_id", *keep, *names, *own)
