"""Language-model scoring with a weighted backoff automaton (operator 5).

The model is an n-gram model with hierarchical Dirichlet smoothing: below the unigrams stands the
additive base, P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), and above it
P(w | h) = (c(h w) + k P(w | h')) / (c(h) + k), where h' is h without its first word. As an
automaton, each history seen in training is a state; a seen n-gram is an arc that carries
log10 P(w | h); the failure arc to the state of h' carries log10(k / (c(h) + k)). One traversal
from left to right carries the state, takes an arc or fails until one is there, and adds the weights.

No machine holds the model. Documents are packed into blocks of about four megabytes, which are kept compressed. A
block sends the sorted hashes of its distinct n-grams, with its training counts, to buckets by hash; a bucket adds
up the counts of all blocks and answers each block with the totals of what it asked for. Hashes travel as one binary
value for each block and bucket, as the compressed steps of a rising sequence, and the answer comes back in their order. From the answers each block builds
the automaton of its own n-grams, which is all that its documents can visit, with weights that come from the whole
corpus. What is gathered grows in proportion to the corpus, and so do the numbers of buckets and tasks; a frequent n-gram
costs one entry of a few bytes for each block, in its bucket, however often it occurs. Blocks times buckets grow as the square
of the corpus, so beyond DIRECT buckets groups of blocks ask together: a relay unites what the blocks of a group want to know
of a range of buckets, asks each bucket once, and splits the answers. A block and a relay each send some sqrt(buckets) rows.

Words are runs of bytes other than ASCII white space, A-Z lower-cased, and are known by 64-bit hashes; longer n-grams by at
least 48 bits of theirs beside the number of their bucket, which from 65,536 buckets (0.5 TB) on is all of the hash. Each document ends with one end token. Histories don't reach across documents.

Defined results: a null or empty text is the end token alone; repeated rows are scored each and counted
each in training; an empty table gives no rows; other columns are ignored; without training rows all
counts are zero and words have the probability of the base.
"""

from __future__ import annotations

import math
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import SPACED, cut, mix64, passing_shuffles, word_hashes

END = np.uint64(0x5BD1E995A5A5F00D)
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
TEXT_LEVEL = 5
STRETCH = 1 << 16  # tokens of a document looked up at a time
DIRECT = 4096
BESIDE = 48
ADD, CONCENTRATION = 0.1, 4.0
_KEYS = mix64(np.arange(101, 110, dtype=np.uint64)) | np.uint64(1)


def tokens_of(text: bytes) -> np.ndarray:
    words, _ = word_hashes(text, SPACED)
    return np.r_[words, END].astype(np.uint64)


class Grams:
    """The n-grams of a block's documents, for n = 1 .. order.

    tokens: all documents' tokens, one after the other; begin: where each document begins;
    hashes[n - 1]: the sorted distinct n-grams; at[n - 1]: for each token the number of the n-gram that
    ends there, or -1 where the document has fewer tokens so far.
    """

    def __init__(self, documents: list[np.ndarray], order: int):
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.tokens = np.concatenate(documents)
        place = np.arange(len(self.tokens)) - np.repeat(self.begin, sizes)
        self.hashes, self.at, self.first = [], [], []
        for n in range(1, order + 1):
            ends = np.flatnonzero(place >= n - 1)
            grams = self.tokens
            if n > 1:
                total = np.full(len(ends), n, dtype=np.uint64)
                for k in range(n):
                    total += self.tokens[ends - (n - 1) + k] * _KEYS[k]
                grams = mix64(total)
            by_hash = np.argsort(grams)  # equal ones in any order: one sort, and not a stable one
            ordered = grams[by_hash]
            new = np.ones(len(ordered), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            at = np.full(len(self.tokens), -1, dtype=np.int64)
            at[ends[by_hash]] = np.cumsum(new) - 1
            self.hashes.append(ordered[new])
            self.first.append(ends[by_hash[new]])  # a token at which each distinct n-gram ends
            self.at.append(at)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the hash


def small(counts: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for a count that follows as 8 bytes after all of them."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unsmall(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()


def pressed(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def unpressed(data) -> bytes:
    return _zstd()[1].decompress(data)


def rising(numbers: np.ndarray) -> bytes:
    """Sorted numbers as the steps between them, with the bytes of one place together, compressed."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return pressed(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unrising(data) -> np.ndarray:
    places = np.frombuffer(unpressed(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(places.T).view("<u8").ravel(), dtype=np.uint64)


def cut_bits(n: int, buckets: int) -> int:
    """How many low bits of an n-gram's hash don't travel: none of a word's (n = 0); of longer ones as many as leave BESIDE bits
    within a bucket. A bucket holds some two million n-grams, so one in 100 million at most shares its number, at every size
    up to that from which the whole hash travels."""
    return max(0, 64 - BESIDE - (buckets - 1).bit_length()) if n else 0


def known_as(hashes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The number by which a bucket knows an n-gram."""
    return hashes >> np.uint64(cut_bits(n, buckets))


def united(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of several lists, sorted, their total counts, and the place of each entry among them."""
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), minlength=len(distinct)).astype(np.int64), place


ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("size", pa.int64()), ("distinct", pa.int64())])


def columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]


def dealt(asker: int, n: int, numbers: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> list[tuple]:
    """A row for each range, ranges being that of each number, which rise."""
    begins = np.r_[0, np.flatnonzero(np.diff(ranges)) + 1, len(ranges)].tolist()
    return [(int(ranges[a]), asker, n, rising(numbers[a:b]), pressed(small(counts[a:b]))) for a, b in zip(begins[:-1], begins[1:], strict=True) if b > a]


def asked_of(table: pa.Table, n: int) -> list[tuple]:
    """bucket, asker, numbers and counts of the rows for n-grams of one length."""
    of_n = table.filter(pa.compute.equal(table.column("n"), n))
    rows = zip(of_n.column("bucket").to_pylist(), of_n.column("block").to_pylist(), map(unrising, of_n.column("hashes").to_pylist()), of_n.column("counts").to_pylist(), strict=True)
    return [(bucket, asker, numbers, unsmall(unpressed(counts), len(numbers))) for bucket, asker, numbers, counts in rows]


def replies_by_length(answers: pa.Table, order: int) -> list[np.ndarray]:
    """The totals of all that was asked, in its order, for n-grams of each length."""
    replies: list[list] = [[] for _ in range(order)]
    for n, bucket, data, size in zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "totals", "size")), strict=True):
        replies[n].append((bucket, data, size))
    return [np.concatenate([np.empty(0, dtype=np.int64), *(unsmall(unpressed(data), size) for _, data, size in sorted(own, key=lambda x: x[0]))]) for own in replies]


BLOCK = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("doc_id", T.ArrayType(T.LongType())),
        T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("texts", T.BinaryType()),
        T.StructField("size", T.LongType()),
    ]
)


def unpack(batch):
    """The tokens of the documents of each block in a batch."""
    for sizes, texts in zip(batch.column("sizes").to_pylist(), batch.column("texts"), strict=True):
        raw = unpressed(texts.as_py())
        ends = np.cumsum(sizes).tolist()
        yield [tokens_of(raw[e - n : e]) for e, n in zip(ends, sizes, strict=True)]


class Automaton:
    """The backoff automaton of a block's n-grams.

    State 0 is the empty history; the other states are the n-grams seen in training, shorter than the order, that don't end in
    the end token (nothing follows it). Each seen n-gram is an arc, with its next state and its weight, from the state of its
    history, so at a token a state of length d has an arc if the n-gram of length d + 1 that ends there was seen: `here[d]`
    says its number for each token of the block, or -1.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, k: float):
        order, words = len(counts), len(counts[0])
        self.words = words
        probability = [(counts[0] + ADD) / (total + ADD * (distinct + 1))]
        state_of: list[np.ndarray] = []  # of each n-gram: its own state if it was seen, else that of its seen end
        fail, backoff = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        keys, following, weights, self.here = [], [], [], []
        length, arcs = [np.zeros(1, dtype=np.int64)], 0
        states = 1
        for n in range(1, order + 1):
            c, last = counts[n - 1], grams.first[n - 1]
            seen = c > 0
            shorter = np.zeros(len(c), dtype=np.int64) if n == 1 else state_of[n - 2][grams.at[n - 2][last]]
            if n > 1:
                history, end = grams.at[n - 2][last - 1], grams.at[n - 2][last]
                size = counts[n - 2][history]
                lower = probability[n - 2][end]
                probability.append(np.where(size > 0, (c + k * lower) / (size + k), lower))
            if n < order:
                own = np.where(grams.tokens[last] == END, 0, shorter)
                goes_on = seen & (grams.tokens[last] != END)
                own[goes_on] = states + np.arange(int(goes_on.sum()))
                states += int(goes_on.sum())
                state_of.append(own)
                fail.append(shorter[goes_on])
                backoff.append(np.log10(k / (c[goes_on] + k)))
                length.append(np.full(int(goes_on.sum()), n))
            begin = np.zeros(len(c), dtype=np.int64) if n == 1 else state_of[n - 2][grams.at[n - 2][last - 1]]
            some = np.ones(len(c), dtype=bool) if n == 1 else seen  # the empty history has an arc for each word
            keys.append((begin * words + grams.at[0][last])[some])
            following.append((own if n < order else shorter)[some])
            weights.append(np.log10(probability[n - 1])[some])
            number = np.append(np.where(some, arcs + np.cumsum(some) - 1, -1), -1)  # the last one for tokens at which none ends
            self.here.append(number[grams.at[n - 1]])
            arcs += int(some.sum())
        self.keys, self.following, self.weights = np.concatenate(keys), np.concatenate(following), np.concatenate(weights)
        self.fail, self.backoff, self.length = np.concatenate(fail).tolist(), np.concatenate(backoff).tolist(), np.concatenate(length).tolist()

    @cached_property
    def arcs(self) -> dict[int, int]:
        """state * words + word: the number of the arc, for looking at single arcs."""
        return dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))

    def traverse(self, begin: int, end: int) -> float:
        """log10 probability of the document at these tokens: one pass that carries the state and adds the weights."""
        fail, backoff, length = self.fail, self.backoff, self.length
        state, total = 0, 0.0
        for at in range(begin, end, STRETCH):
            here = [arcs[at : min(at + STRETCH, end)] for arcs in self.here]
            following = [np.where(arcs >= 0, self.following[arcs], -1).tolist() for arcs in here]
            weights = [self.weights[arcs].tolist() for arcs in here]
            for i in range(len(here[0])):
                d = length[state]
                goes_to = following[d][i]
                while goes_to < 0:
                    total += backoff[state]
                    state = fail[state]
                    d = length[state]
                    goes_to = following[d][i]
                total += weights[d][i]
                state = goes_to
        return total


def score(docs: DataFrame, order: int = 3, concentration: float = CONCENTRATION, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, direct: int = DIRECT) -> DataFrame:
    """Score each row of docs (doc_id, text, held_out); rows with held_out false are the training rows. Up to `direct` buckets are
    asked by the blocks themselves, more by relays."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def block():
            raw = b"".join(r[2] for r in rows)
            values = ((part << 32) | number, [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], zstandard.compress(raw, TEXT_LEVEL), len(raw) + len(rows))
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=BLOCK.names)

        for batch in batches:
            for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append((doc_id, out, (text.as_py() or "").encode()))
                held += len(rows[-1][2])
                if held >= block_bytes:
                    yield block()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield block()

    spark = docs.sparkSession
    packed = cut(texts.mapInArrow(pack, BLOCK))
    held = packed.agg(F.sum("size").alias("size"), F.count("*").alias("blocks")).first()
    buckets = 1 + (held["size"] or 0) // bucket_bytes
    # A range is what a block sends in one row: a bucket, or as many as there are ranges.
    width = 1 if buckets <= direct else math.isqrt(buckets - 1) + 1
    ranges = -(-buckets // width)

    def ask(batches):
        for batch in batches:
            for block, held_out, documents in zip(batch.column("block").to_pylist(), batch.column("held_out"), unpack(batch), strict=True):
                grams = Grams(documents, order)
                training = np.repeat(~held_out.values.to_numpy(zero_copy_only=False), [len(d) for d in documents])
                rows = []
                for n, (hashes, at) in enumerate(zip(grams.hashes, grams.at, strict=True)):
                    counts = np.bincount(at[training & (at >= 0)], minlength=len(hashes))
                    rows += dealt(block, n, known_as(hashes, n, buckets), counts, bucket_of(hashes, buckets) // np.uint64(width))
                yield pa.RecordBatch.from_arrays(columns(rows, ASKED), schema=ASKED)

    def unite(table: pa.Table) -> pa.Table:
        """A relay's questions: those of a group of blocks on a range, each once, by bucket."""
        relay = table.column("relay")[0].as_py()
        rows = []
        for n in range(order):
            if own := asked_of(table, n):
                numbers, counts, _ = united([h for _, _, h, _ in own], [c for *_, c in own])
                rows += dealt(relay, n, numbers, counts, bucket_of(numbers << np.uint64(cut_bits(n, buckets)), buckets))
        return pa.Table.from_arrays(columns(rows, ASKED), schema=ASKED)

    def answer(table: pa.Table) -> pa.Table:
        rows = []
        for n in range(order):
            own = asked_of(table, n)
            if not own:
                continue
            _, totals, place = united([h for _, _, h, _ in own], [c for *_, c in own])
            if n == 0:
                rows.append((-1, n, 0, b"", int(totals.sum()), int((totals > 0).sum())))
            at = 0
            for bucket, asker, h, _ in own:
                rows.append((asker, n, bucket, pressed(small(totals[place[at : at + len(h)]])), len(h), 0))
                at += len(h)
        return pa.Table.from_arrays(columns(rows, ANSWERED), schema=ANSWERED)

    def split(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The answers to a relay, for each of its blocks."""
        replies, rows = replies_by_length(answers, order), []
        for n in range(order):
            own = asked_of(table, n)
            if not own:
                continue
            place, at = united([h for _, _, h, _ in own], [c for *_, c in own])[2], 0
            for part, block, h, _ in own:
                rows.append((block, n, part, pressed(small(replies[n][place[at : at + len(h)]])), len(h), 0))
                at += len(h)
        return pa.Table.from_arrays(columns(rows, ANSWERED), schema=ANSWERED)

    # As many tasks as the text needs, four buckets each, so that none grows with the corpus.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + buckets // 4)
    asked_as, answered_as = "bucket int, block long, n int, hashes binary, counts binary", "block long, n int, bucket int, totals binary, size long, distinct long"
    with passing_shuffles(spark):
        asked = packed.mapInArrow(ask, asked_as)
        if width > 1:
            groups = -(-held["blocks"] // width)  # of about `width` blocks each, so that a relay gets what a block sends
            relay = F.pmod(F.xxhash64("block"), F.lit(groups)) * ranges + F.col("bucket")
            by_block = cut(asked.withColumn("relay", relay))
            asked = by_block.repartition(tasks, "relay").groupBy("relay").applyInArrow(unite, asked_as)
        answered = cut(asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer, answered_as))
    sums = answered.filter("block = -1").agg(F.sum("size").alias("n"), F.sum("distinct").alias("v")).first()
    answers = answered.filter("block >= 0")
    if width > 1:
        with passing_shuffles(spark):
            answers = cut(by_block.repartition(tasks, "relay").groupBy("relay").cogroup(answers.withColumn("relay", F.col("block")).groupBy("relay")).applyInArrow(split, answered_as))
    total, vocabulary = sums["n"] or 0, sums["v"] or 0
    floor = math.log10(total + ADD * (vocabulary + 1))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        documents = next(unpack(table.combine_chunks().to_batches()[0]))
        sizes = [len(d) for d in documents]
        grams = Grams(documents, order)
        del documents
        counts = replies_by_length(answers, order)
        automaton = Automaton(grams, counts, total, vocabulary, concentration)
        of_token = counts[0][grams.at[0]]
        base = np.add.reduceat(np.log10(of_token + ADD), grams.begin) - np.array(sizes) * floor
        known = np.add.reduceat((of_token > 0).astype(np.int64), grams.begin)
        scores = [automaton.traverse(a, a + n) for a, n in zip(grams.begin.tolist(), sizes, strict=True)]
        return pa.table(
            {
                "doc_id": table.column("doc_id")[0].values,
                "held_out": table.column("held_out")[0].values,
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(known),
                "train_tokens": pa.array([total] * len(sizes), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(scores),
            }
        )

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
