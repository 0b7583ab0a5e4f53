"""Benchmark decontamination by spaced-seed hashing (operator 1).

Texts become words: ASCII letters and digits, lower-cased, and all other characters from U+0080.
A mask picks positions out of a few consecutive words and ignores the others; its hash is the
same whatever the ignored words are. Masked hashes of the documents are joined with those of the
benchmark, and around each hit the two texts are laid side by side without gaps. A document holds
an item if some window of the item stands in it with few enough substituted words:

    item of 16 words or more: any 16 consecutive words, at most 3 substituted
    12 to 15 words: the whole item, at most 2;  8 to 11 words: the whole item, at most 1
    1 to 7 words: the whole item as it is

The four masks are lossless for these bounds: however the substitutions lie, at least one mask
hits inside the window (a test goes through all of them). Items under 8 words have one mask, which ignores nothing; it is
only used if there are items of that length. Such a short phrase is weak evidence, and the column `window` tells it.

To keep the documents' hashes out of the shuffle, executors first test them against a bitmap of
the benchmark's hashes, whose size has a fixed bound; false hits of the bitmap only make rows that
the join drops. Neighbouring hits of a document become one segment with the words around them, and
equal segments, as copies have them, are verified once. All shifts between a segment and an item are verified together, so
a repetitive text is laid beside an item once.

A passage that many items share, such as a prompt, would bring every document that holds it to every one of these items. So a
seed of more than HOT items makes no pairs. The windows around its hits are compared instead, each content once, by
what is left of them when as many words are taken out as may be substituted: two windows have such a rest in common
exactly if they are within the bound. The pairs that meet are thus the results, however many items share a passage.

Defined results: null and empty texts and items without words hold nothing; repeated rows of one key are reported once;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import ALNUM, chunks, cut, mix64, word_hashes

MASKS = ("1111011", "11001111", "111111", "11110101")
WINDOW, SHORTEST = 16, 8
#: A seed of more items than these finds its documents by whole windows.
HOT = 64
_BITS_MAX = 28
_SHORTEST_MASK = min(map(len, MASKS))


def allowed(window: int) -> int:
    """Substitutions allowed in a window of so many words."""
    return 3 if window >= 16 else 2 if window >= 12 else 1 if window >= SHORTEST else 0


_KEYS = mix64(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def masked_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The mask's hash at each place of a sequence of word hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, number + 1, dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k : k + n] * _KEYS[k]
    return mix64(total)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def masks_of(words: int) -> list[tuple[int, str]]:
    """The masks, with their numbers, that look for an item of so many words."""
    return list(enumerate(MASKS)) if words >= SHORTEST else [(len(MASKS) + words, "1" * words)]


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, words (hashes), and each masked hash with its place."""

    def run(batches):
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, _ = word_hashes((text.as_py() or "").encode(), ALNUM)
                if not len(words):
                    continue
                seeds = [masked_hashes(words, m, k) for k, m in masks_of(len(words))]
                places = np.concatenate([np.arange(len(s)) for s in seeds])
                out.append((item_id, words.view(np.int64).tolist(), np.concatenate(seeds).view(np.int64).tolist(), places.tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])],
                names=["item_id", "words", "seeds", "places"],
            )

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "item_id long, words array<long>, seeds array<long>, places array<long>")


def bitmap(seeds: DataFrame, each: int = 64) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes in column `seed`: `each` bits for one at first, at most 32 MB in all."""
    n = seeds.count()
    bits = int(min(_BITS_MAX, max(16, np.ceil(np.log2(max(1, n) * each)))))
    places = seeds.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND((1 << bits) - 1))).alias("slot"))
    words = places.groupBy(F.shiftrightunsigned("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("word"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for batch in words.toArrow().to_batches():  # at most 2^22 pairs of numbers
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8), bits


def _holds(filter_bits: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that the bitmap holds."""
    bits_set, bits = filter_bits
    high, low = _slots(hashes, bits)
    held = lambda slots: (bits_set[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(held(high))
    return at[held(low[at])]


def segments(docs: DataFrame, filter_bits: tuple[np.ndarray, int], masks: list[tuple[int, str]], keys: tuple[str, ...] = ("doc_id",), context: int = WINDOW) -> DataFrame:
    """The keys, start and words of each stretch around possible hits, with the hits' hashes and places in it."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches):
        for batch in batches:
            out = []
            for rows, data in chunks(range(batch.num_rows), batch.column(0)):
                words, starts = word_hashes(b"\n".join(data), ALNUM)
                ends = np.cumsum([len(d) + 1 for d in data])
                bounds = np.r_[0, np.searchsorted(starts, ends)]  # of each text's words
                hits = [np.empty((4, 0), dtype=np.int64)]
                for k, mask in masks:
                    hashes = masked_hashes(words, mask, k)
                    at = _holds(shared.value, hashes)
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    whole = at + len(mask) <= bounds[doc + 1]
                    hits.append(np.stack([at[whole], hashes[at[whole]].view(np.int64), doc[whole], at[whole] + len(mask)]))
                at, seed, doc, end = np.concatenate(hits, axis=1)
                if not len(at):
                    continue
                order = np.lexsort((seed, at))
                at, seed, doc, end = at[order], seed[order], doc[order], end[order]
                low = np.maximum(at - context, bounds[doc])
                high = np.minimum(end + context, bounds[doc + 1])
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])])
                for a, b in zip(new, [*new[1:], len(at)], strict=True):
                    first, last = int(low[a:b].min()), int(high[a:b].max())
                    out.append((rows[int(doc[a])], first - int(bounds[doc[a]]), words[first:last].view(np.int64).tolist(), seed[a:b].tolist(), (at[a:b] - first).tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            found = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(found) for c in batch.columns[1:]), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[2:])],
                names=[*keys, "start", "words", "seeds", "places"],
            )

    texts = docs.select(F.col("text").cast("string").alias("text"), *(F.col(k).cast("long").alias(k) for k in keys))
    return texts.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", start long, words array<long>, seeds array<long>, places array<long>")


def best_window(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int] | None:
    """(substitutions, place in the item) of the item's best window at this shift, if it is good enough."""
    window = min(len(item), WINDOW)
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high - low < window:
        return None
    same = np.cumsum(np.r_[0, item[low:high] == doc[low + diagonal : high + diagonal]])
    wrong = window - (same[window:] - same[:-window])
    k = int(wrong.argmin())
    return (int(wrong[k]), low + k) if wrong[k] <= allowed(window) else None


def windows_around(texts: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """The windows that hold a hot seed: name, place, window (its words).

    texts: name, words, places (of hot seeds). An item's windows are of WINDOW words, or the whole item if it is shorter; for
    documents `lengths` tells the windows to cut."""

    def run(batches):
        for batch in batches:
            for name, words, places in zip(*(batch.column(k) for k in range(3)), strict=True):
                own, at = words.values.to_numpy(), np.unique(places.values.to_numpy())
                for window in lengths or [min(len(own), WINDOW)]:
                    if len(own) < window:
                        continue
                    near = np.unique((at[:, None] - np.arange(window - _SHORTEST_MASK + 1)).ravel())
                    near = near[(near >= 0) & (near <= len(own) - window)]
                    cuts = np.lib.stride_tricks.sliding_window_view(own, window)
                    for k in range(0, len(near), 10_000):
                        some = near[k : k + 10_000]
                        ends = np.arange(len(some) + 1, dtype=np.int32) * window
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), name.as_py(), dtype=np.int64)), pa.array(some), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cuts[some].ravel()))],
                            names=["name", "place", "window"],
                        )

    return texts.select("name", "words", "places").mapInArrow(run, "name long, place long, window array<long>")


@cache
def _taken_out(window: int) -> np.ndarray:
    """All choices of as many places of a window as may be substituted."""
    return np.array(list(combinations(range(window), allowed(window))), dtype=np.int64).reshape(-1, allowed(window))


def rests(window: np.ndarray) -> np.ndarray:
    """A hash of what is left of a window, for each choice of words that are taken out."""
    out = _taken_out(len(window))
    terms = window.view(np.uint64) * _KEYS[: len(window)]
    left = terms.sum() - terms[out].sum(axis=1)
    return mix64(left + np.arange(len(out), dtype=np.uint64) * _KEYS[20] + _KEYS[len(window)])


def window_rests(windows: DataFrame, filter_bits: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """window_id and seed, a hash of a rest; only those that the bitmap holds, if there is one."""
    shared = windows.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                hashes = [rests(w.values.to_numpy()) for w in some.column(1)]
                if shared.value is not None:
                    hashes = [h[_holds(shared.value, h)] for h in hashes]
                ids = np.repeat(some.column(0).to_numpy(), [len(h) for h in hashes])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(hashes).view(np.int64))], names=["window_id", "seed"])

    return windows.select("window_id", "window").mapInArrow(run, "window_id long, seed long")


def shared_windows(hits: DataFrame, contents: DataFrame, seeds: DataFrame, seeded: DataFrame, hot: DataFrame) -> DataFrame:
    """The best window of a segment and an item around the seeds in `hot`, as `verified` in `contaminated` has it."""

    def cut_around(places, texts, name, lengths=None):
        around = places.join(hot, "seed", "left_semi").groupBy(name).agg(F.collect_set("place").alias("places"))
        named = around.join(texts.select(name, "words"), name).select(F.col(name).alias("name"), "words", "places")
        return cut(windows_around(named, lengths).withColumn("window_id", F.xxhash64("window")))

    of_items = cut_around(seeds.select("item_id", "seed", F.col("item_place").alias("place")), seeded, "item_id")
    lengths = [r["n"] for r in of_items.select(F.size("window").alias("n")).distinct().orderBy("n").collect()]  # at most nine
    of_docs = cut_around(hits, contents, "segment", lengths)
    item_windows, doc_windows = (w.groupBy("window_id").agg(F.first("window").alias("window")) for w in (of_items, of_docs))
    item_rests = cut(window_rests(item_windows))
    doc_rests = window_rests(doc_windows, bitmap(item_rests, 8))  # a false hit costs one row
    met = doc_rests.withColumnRenamed("window_id", "doc_window").join(item_rests.withColumnRenamed("window_id", "item_window"), "seed").select("doc_window", "item_window").distinct()
    both = met.join(doc_windows.select(F.col("window_id").alias("doc_window"), F.col("window").alias("own")), "doc_window").join(
        item_windows.select(F.col("window_id").alias("item_window"), F.col("window").alias("wanted")), "item_window"
    )
    wrong = F.size(F.filter(F.zip_with("own", "wanted", lambda a, b: a != b), lambda x: x))
    bound = F.element_at(F.array(*(F.lit(allowed(n)) for n in range(1, WINDOW + 1))), F.size("wanted"))
    close = both.withColumn("substitutions", wrong.cast("long")).filter((F.size("own") == F.size("wanted")) & (F.col("substitutions") <= bound))
    # a window's content fixes the substitutions, so each side takes its first place before the sides meet
    placed = close.join(of_docs.select(F.col("window_id").alias("doc_window"), F.col("name").alias("segment"), "place"), "doc_window")
    firsts = placed.groupBy("segment", "item_window").agg(F.min(F.struct("substitutions", "place")).alias("w"))
    items = of_items.groupBy(F.col("window_id").alias("item_window"), F.col("name").alias("item_id")).agg(F.min("place").alias("item_start"), F.first(F.size("window")).cast("long").alias("window"))
    return firsts.join(items, "item_window").select("segment", "item_id", "w.substitutions", "w.place", "item_start", "window")


def contaminated(docs: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("doc_id",), hot_items: int = HOT) -> DataFrame:
    """One row for each document and item that it holds, with the best window: fewest substitutions,
    then first in the document, then first in the item. Seeds of more than `hot_items` items are looked up by whole windows. Columns: the keys (whole numbers that name a document), item_id,
    substitutions, doc_start and item_start (in words from 0), window (words)."""
    seeded = cut(item_seeds(items))
    lengths = [r["n"] for r in seeded.select(F.least(F.size("words"), F.lit(SHORTEST)).alias("n")).distinct().orderBy("n").collect()]  # at most 8
    seeds = seeded.select("item_id", F.explode(F.arrays_zip("seeds", "places")).alias("z")).select("item_id", F.col("z.seeds").alias("seed"), F.col("z.places").alias("item_place"))
    found = cut(segments(docs, bitmap(seeds), [m for n in lengths for m in masks_of(n)], keys).withColumn("segment", F.xxhash64("words", "seeds", "places")))
    contents = found.groupBy("segment").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))
    hits = contents.select("segment", F.explode(F.arrays_zip("seeds", "places")).alias("z")).select("segment", F.col("z.seeds").alias("seed"), F.col("z.places").alias("place"))
    masked = seeds.join(seeded.filter(F.size("words") >= SHORTEST).select("item_id"), "item_id", "left_semi")  # shorter items' seeds are the whole items
    hot = cut(masked.groupBy("seed").agg(F.count_distinct("item_id").alias("items")).filter(F.col("items") > hot_items).select("seed"))
    any_hot = not hot.isEmpty()
    cold = seeds.join(hot, "seed", "left_anti") if any_hot else seeds
    shifts = hits.join(cold, "seed").groupBy("segment", "item_id").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    laid = shifts.join(contents.select("segment", "words"), "segment").join(seeded.select("item_id", F.col("words").alias("item")), "item_id")

    def verify(batches):
        for batch in batches:
            out = []
            for segment, item_id, shifts, doc, item in zip(*(batch.column(k) for k in range(5)), strict=True):
                item_words, doc_words = item.values.to_numpy(), doc.values.to_numpy()
                windows = ((best[0], shift + best[1], best[1]) for shift in shifts.as_py() if (best := best_window(doc_words, item_words, shift)))
                if first := min(windows, default=None):
                    out.append((segment.as_py(), item_id.as_py(), *first, min(len(item_words), WINDOW)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["segment", "item_id", "substitutions", "place", "item_start", "window"])

    verified = laid.select("segment", "item_id", "shifts", "words", "item").mapInArrow(verify, "segment long, item_id long, substitutions long, place long, item_start long, window long")
    if any_hot:
        verified = verified.unionByName(shared_windows(hits, contents, seeds, seeded, hot))
    best = verified.groupBy("segment", "item_id").agg(F.min(F.struct("substitutions", "place", "item_start", "window")).alias("w"))
    placed = found.select("segment", *keys, "start").join(best, "segment")
    return (
        placed.groupBy(*keys, "item_id")
        .agg(F.min(F.struct(F.col("w.substitutions"), (F.col("start") + F.col("w.place")).alias("doc_start"), F.col("w.item_start"), F.col("w.window"))).alias("w"))
        .select(*keys, "item_id", "w.substitutions", "w.doc_start", "w.item_start", "w.window")
    )
