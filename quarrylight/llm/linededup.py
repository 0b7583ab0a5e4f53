"""Line dedup with a suffix array over line-ID sequences (operator 7).

Every line (white space at its ends taken off; blank lines don't count) becomes an ID, and a
document is a sequence of IDs. A run of consecutive lines with at least `min_words` words in all
that also stands earlier in the corpus, in the order of doc_id and line, is deleted with the blank lines
in it; the first copy stays.

A line that occurs once can't be in a repeated run, so it only cuts the sequences; what is left are
islands of repeated lines. Prefix doubling then sorts the suffixes of the islands: ranks start as
the order of the line IDs, and each round sorts the pairs (rank here, rank 2^k lines on), so that equal
ranks mean equal runs of 2^(k+1) lines. A run of any length between is named by the ranks of the
two overlapping runs that cover it. A longest-common-prefix interval of the suffix array, the suffixes
that share their first n lines, is the group of one such name. Every line of a maximal repeated run
lies in a shortest sufficient run that begins or ends at a given line, so these are the depths at which
intervals are needed, with pairs of lines that have blank lines between: no more than `min_words` lines (two at
least), whatever the length of the documents, and log2(min_words) rounds. Together the later members of all intervals
make up the maximal runs.

A frequent line is one group in the sort. Its pairs are counted before the shuffle, so it costs as
many rows there as it has different successors in a partition, and those are summed in 4096 ranges; the joins that
hand ranks back to lines are plain equi-joins, which Spark can split where they are skewed.

Defined results: a null text stays null and has no lines; a text all of whose lines go becomes empty;
rows with equal doc_id and equal text count as one document, and all of them are changed alike; rows with a
null doc_id take no part and stay as they are; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight.llm.common import cut, free_name

_BLANK = b" \t\r\v\f"
_DOC = ("doc_id", "text_hash")


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos (among lines that aren't blank), line_no, key (128-bit hash), words.

    Of rows with equal doc_id and text_hash only one in a batch is read; sorted_suffixes leaves one of the rest.
    """

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            seen: set[tuple] = set()
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (doc_id, text_hash) in seen:
                    continue
                seen.add((doc_id, text_hash))
                pos = 0
                for number, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    if line := line.strip(_BLANK):
                        for c, v in zip(cols, (doc_id, text_hash, pos, number, xxhash.xxh3_128_digest(line), len(line.split())), strict=True):
                            c.append(v)
                        pos += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "text_hash", "pos", "line_no", "key", "words"])
            for a in range(0, table.num_rows, 20_000):
                yield table.slice(a, 20_000)

    texts = docs.select("doc_id", "text_hash", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, pos int, line_no int, key binary, words int")


def order_of_keys(keys: DataFrame) -> DataFrame:
    """key, rank: the number of lines whose key is smaller, for keys with their counts `n`."""
    bucketed = keys.withColumn("bucket", F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int"))
    sums = bucketed.groupBy("bucket").agg(F.sum("n").alias("total"))  # 4096 rows
    before = sums.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("key")) - F.col("n")
    return bucketed.withColumn("inside", inside).join(F.broadcast(before), "bucket").select("key", (F.col("before") + F.col("inside")).alias("rank"))


def order_of_pairs(pairs: DataFrame, shift: int) -> DataFrame:
    """r1, r2, rank: r1 and the number of pairs with that r1 and a smaller r2. A frequent r1 is summed in ranges of r2."""
    ranged = pairs.withColumn("range", F.shiftright("r2", shift))
    sums = ranged.groupBy("r1", "range").agg(F.sum("n").alias("total"))
    before = sums.select("r1", "range", (F.sum("total").over(Window.partitionBy("r1").orderBy("range")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("r1", "range").orderBy("r2")) - F.col("n")
    return ranged.withColumn("inside", inside).join(before, ["r1", "range"]).select("r1", "r2", (F.col("r1") + F.col("before") + F.col("inside")).alias("rank"))


def sorted_suffixes(lines: DataFrame, depth: int) -> DataFrame:
    """Lines that occur more than once, with their island and ranks[k]: the rank by the first 2^k lines.

    Lines of a repeated document are counted with it, so some that stand in no other document are kept with the
    rest; of a repeated document each line is kept once. Ranks of suffixes that end within 2^k lines, at their island's end, are only equal if all they have is equal.
    """
    keys = cut(lines.select("key", *_DOC, "pos").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    lines_in_all = keys.agg(F.sum("n")).first()[0] or 0
    shift = max(0, int(lines_in_all).bit_length() - 12)  # ranks in 4096 ranges
    inside = Window.partitionBy(*_DOC).orderBy("pos")
    island = F.col("pos") - F.dense_rank().over(inside)
    repeat = F.coalesce(F.lag("pos").over(inside) == F.col("pos"), F.lit(False))
    kept = lines.join(order_of_keys(keys), "key").select(*_DOC, "pos", "line_no", "words", F.array("rank").alias("ranks"))
    current = cut(kept.withColumn("island", island).withColumn("repeat", repeat).filter(~F.col("repeat")).drop("repeat"))
    along = Window.partitionBy(*_DOC, "island").orderBy("pos")
    for k in range(max(1, math.ceil(math.log2(depth)))):
        here = F.element_at("ranks", -1)
        paired = current.withColumn("r1", here).withColumn("r2", F.coalesce(F.lead(here, 1 << k).over(along), F.lit(-1)))
        pairs = paired.groupBy("r1", "r2").agg(F.count("*").alias("n"))
        refined = order_of_pairs(pairs, shift)
        current = cut(paired.join(refined, ["r1", "r2"]).select(*_DOC, "pos", "line_no", "words", F.concat("ranks", F.array("rank")).alias("ranks"), "island"))
    return current


def sufficient_runs(suffixes: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs with `min_words` words that begin or end at each line or span blank lines, named by depth and two ranks."""
    line = F.struct("pos", "line_no", "words", "ranks")
    islands = suffixes.groupBy(*_DOC, "island").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    arrays = islands.select(*_DOC, *(F.col(f"lines.{c}").alias(c) for c in ("pos", "line_no", "words")), F.flatten("lines.ranks").alias("ranks"))

    def run(batches):
        for batch in batches:
            out: list[np.ndarray] = []
            for doc_id, text_hash, pos, line_no, words, ranks in zip(*batch.columns, strict=True):
                n = len(words.values)
                total = np.r_[0, np.cumsum(words.values.to_numpy())]
                if total[-1] < min_words:
                    continue
                number, rank = line_no.values.to_numpy(), ranks.values.to_numpy().reshape(n, -1)
                begin = np.arange(n)
                stop = np.searchsorted(total, total[:-1] + min_words)  # one past the last line
                forward = np.stack([begin, stop])[:, stop <= n]
                end = np.arange(1, n + 1)
                start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                backward = np.stack([start, end])[:, start >= 0]
                # two neighbours with blank lines between, which go if both are one run
                pair = begin[:-1][(total[2:] - total[:-2] >= min_words) & (np.diff(number) > 1)]
                a, b = np.unique(np.concatenate([forward, backward, np.stack([pair, pair + 2])], axis=1), axis=1)
                size = b - a
                level = np.floor(np.log2(size)).astype(np.int64)
                same = np.ones(len(a), dtype=np.int64)
                out.append(np.stack([same * doc_id.as_py(), same * text_hash.as_py(), pos.values.to_numpy()[a], size, rank[a, level], rank[b - (1 << level), level], number[a], number[b - 1]]))
            cols = np.concatenate(out, axis=1) if out else np.empty((8, 0), dtype=np.int64)
            table = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "text_hash", "pos", "size", "head", "tail", "first_line", "last_line"])
            for at in range(0, table.num_rows, 20_000):
                yield table.slice(at, 20_000)

    return arrays.mapInArrow(run, "doc_id long, text_hash long, pos long, size long, head long, tail long, first_line long, last_line long")


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, and the ranges of line numbers to delete."""
    lines = line_ids(docs.filter("doc_id is not null"))
    runs = cut(sufficient_runs(sorted_suffixes(lines, min_words), min_words))
    interval = ["size", "head", "tail"]
    place = F.struct("doc_id", "text_hash", "pos")
    # Cut, so that both sides of the join come from an exchange and Spark can split the members of a large interval.
    intervals = cut(runs.groupBy(*interval).agg(F.count("*").alias("members"), F.min(place).alias("first")).filter("members > 1").drop("members"))
    later = runs.join(intervals, interval).filter(place != F.col("first"))
    return later.groupBy(*_DOC).agg(F.collect_set(F.struct("first_line", "last_line")).alias("ranges"))


def dedup_lines(docs: DataFrame, min_words: int = 8, name: str = "lines_removed") -> DataFrame:
    """The documents with later copies of repeated runs taken out of `text`, and how many lines went (long).
    A column of that name is replaced."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    removals = cut(later_copies(hashed, min_words))
    own_id, own_hash, ranges = (free_name(docs, n) for n in ("removal_id", "removal_hash", "removal_ranges"))
    named = removals.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("ranges").alias(ranges))
    joined = docs.join(named, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left").select(*docs.columns, ranges)
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for text, ranges in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py()
                if not ranges.is_valid:
                    texts.append(text)
                    removed.append(0)
                    continue
                lines = text.split("\n")
                gone = np.zeros(len(lines) + 1, dtype=np.int64)
                spans = ranges.values
                np.add.at(gone, spans.field(0).to_numpy(), 1)
                np.add.at(gone, spans.field(1).to_numpy() + 1, -1)
                keep = np.cumsum(gone)[:-1] == 0
                left = [x for x, k in zip(lines, keep.tolist(), strict=True) if k]
                texts.append("\n".join(left) if any(x.strip(" \t\r\v\f") for x in left) else "")
                removed.append(len(lines) - len(left))
            cols = [*batch.columns[:-1], pa.array(removed, pa.int64())]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)
