"""Best-fit packing of documents into fixed-length sequences (operator 9).

Two passes over Spark data and one small computation between them:

1. Executors tokenize the documents and cut them into pieces; the pieces' sizes are counted.
   There are at most `capacity` different sizes, so this histogram is small at any scale.
2. The histogram is packed on the driver. A Martello-Toth reduction first fixes sets that
   provably dominate every alternative; best-fit decreasing packs what is left. Bins that
   look the same are kept as one pattern with a count, so the work depends on the number of
   sizes and not on the number of documents.
3. Each piece gets a rank among the pieces of its size; patterns own ranges of ranks, so a
   binary search gives the piece its sequence and offset.

Defined results: a null or empty text is the end token alone; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight.llm.common import cut

CAPACITY = 2048
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for
    itself, the other bytes for the characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


#: Fixed value: how byte-level vocabularies cut a text before they merge.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of a text, as little-endian 32-bit bytes, of a `tokenizers` file.

    If the file is a plain byte-level vocabulary whose ids are in the order of its merges, tiktoken runs these same
    merges in a third of the time (the tests compare the ids). Texts that hold the string of a special token or a very
    long run of white space, and other kinds of files, go to tokenizers itself.
    """

    _long_gap = re.compile(r"\s{1000}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        self.merging = _merging(told, self.special)

    def encode(self, text: str) -> bytes:
        if self.merging and not self._long_gap.search(text) and not any(s in text for s in self.special):
            return self.merging.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _merging(told: dict, special: list[str]):
    """The merges of a plain byte-level file as a tiktoken encoding; None if the file is of another kind."""
    import tiktoken

    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not told.get("normalizer")
        and not told.get("truncation")
        and "" not in special
    )
    if not plain:
        return None
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    merged = [model["vocab"][m] for m in made]
    byte_of = {letter: b for b, letter in byte_letters().items()}
    tokens = {token: number for token, number in model["vocab"].items() if token not in special}
    single = [number for token, number in tokens.items() if len(token) == 1]
    if merged != sorted(set(merged)) or len(single) != 256 or (merged and max(single) > merged[0]) or len(tokens) != 256 + len(merged) or not set("".join(tokens)) <= set(byte_of):
        return None
    ranks = {bytes(byte_of[x] for x in token): number for token, number in tokens.items()}
    return tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenize and cut: a document longer than `capacity` has a first piece of the remainder's
    size (if there is one) and full pieces after it."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                cuts = list(range(total % capacity, total + 1, capacity))
                if cuts[0]:
                    cuts.insert(0, 0)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on a histogram: take out sets that dominate all sets with their largest item.

    counts[s] items have size s; it is changed in place. Returns (sizes, how many bins).
    A set dominates if whatever else could stand beside its largest item would fit in the
    places of its other items:
      * nothing else fits: the item alone;
      * a partner fills the bin exactly;
      * no two others fit together: the largest partner that fits;
      * no three others fit together, and the largest fitting partner is at least as large as
        the largest fitting pair: that partner.
    All but the first two stay true when items are taken away, as long as the partner has others of its size, so bins are
    fixed in multiples: each time until the items of one of the two sizes are used up.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((sizes, times))
        for s in sizes:
            counts[s] -= times

    for size in range(capacity, 0, -1):  # exact partners first: they dominate at any size
        partner = capacity - size
        if partner and partner < size and (times := int(min(counts[size], counts[partner]))):
            fix((size, partner), times)
        elif partner == size and counts[size] >= 2:
            fix((size, size), int(counts[size]) // 2)
    if counts[capacity]:
        fix((capacity,), int(counts[capacity]))
    changed = True
    while changed:
        changed = False
        for size in range(capacity - 1, 0, -1):
            while counts[size]:
                counts[size] -= 1  # the others
                smallest = [int(s) for s in np.flatnonzero(counts)[:3] for _ in range(min(3, int(counts[s])))][:3]
                room = capacity - size
                fitting = np.flatnonzero(counts[: room + 1])
                best = int(fitting[-1]) if len(fitting) else 0
                counts[size] += 1
                if not best:
                    fix((size,), int(counts[size]))
                elif len(smallest) < 2 or smallest[0] + smallest[1] > room or ((len(smallest) < 3 or sum(smallest) > room) and best >= _best_pair(counts, size, room)):
                    fix((size, best), int(counts[size]) // 2 if best == size else int(min(counts[size], counts[best])))
                else:
                    break
                changed = True
    return fixed


def _best_pair(counts: np.ndarray, used: int, room: int) -> int:
    """The largest sum of two items, besides one of size `used`, that is at most `room`."""
    counts[used] -= 1
    sizes, best = np.flatnonzero(counts[: room + 1]), 0
    for s in sizes[::-1]:
        rest = np.flatnonzero(counts[: room - s + 1])
        if len(rest):
            other = int(rest[-1])
            if other == s and counts[s] < 2:
                other = int(rest[-2]) if len(rest) > 1 else 0
            if other:
                best = max(best, int(s) + other)
        if best == room:
            break
    counts[used] += 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram; bins with the same contents are one pattern with a count."""
    open_bins: dict[int, list[list]] = {}  # room left -> [pattern chain, how many bins]
    rooms: list[int] = []

    def add(room: int, chain, times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([chain, times])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if bins := left // each:
                    add(capacity - each * size, (None, size, each), bins)
                if rest := left % each:
                    add(capacity - rest * size, (None, size, rest), 1)
                break
            room = rooms[at]
            chain, bins = open_bins[room].pop()
            each = room // size
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0  # under `each`
            if full:
                add(room - each * size, (chain, size, each), full)
            if rest:
                add(room - rest * size, (chain, size, rest), 1)
            if spare := bins - full - (1 if rest else 0):
                open_bins[room].append([chain, spare])
            if not open_bins[room]:
                del open_bins[room]
                rooms.remove(room)
            left -= full * each + rest
    patterns = []
    for groups in open_bins.values():
        for chain, times in groups:
            sizes: list[int] = []
            while chain:
                chain, size, each = chain
                sizes += [size] * each
            patterns.append((tuple(reversed(sizes)), times))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted keys (size, first rank), with each range's first sequence and its offset, and the number of sequences."""
    cursor: dict[int, int] = {}
    keys, first, offsets, bins = [], [], [], 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            rank = cursor.get(size, 0)
            keys.append((size << 44) | rank)
            first.append(bins - rank)
            offsets.append(offset)
            cursor[size] = rank + times
            offset += size
        bins += times
    order = np.argsort(np.asarray(keys, dtype=np.int64)) if keys else np.empty(0, dtype=np.int64)
    return (*(np.asarray(x, dtype=np.int64)[order] for x in (keys, first, offsets)), bins)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    rest = counts.astype(np.int64).copy()
    return reduce_dominated(rest, capacity) + best_fit(rest, capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and offset."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    keys, first, offsets, _ = slots(plan(counts, capacity))
    shared = spark.sparkContext.broadcast((keys, first, offsets))

    deals = 64 + int(counts.sum() // 250_000)
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deals)))
    per_deal = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = per_deal.select("length", "deal", (F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "deal"])

    def place(batches):
        keys, first, offsets = shared.value
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, (batch.column(3).to_numpy() << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank), pa.array(offsets[at])], names=[*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*PIECES.names, (F.col("before") + F.col("within")).cast("long").alias("rank")).mapInArrow(place, schema)
