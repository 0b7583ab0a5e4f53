"""Token counts of whole texts, huge ones in overlapping chunks (operator 13).

A text of at most `chunk` characters is encoded whole. A longer one is cut into chunks that run `overlap` characters
into their successor; tasks encode the chunks apart, with the offset of each token, and the counts are spliced where
two encodings have provably met. The text of an overlap alone is a third encoding, which both neighbours compare
themselves with: the left one must meet it in the first half, the right one must be with it still in the second half.
So each chunk adds a number of its own, and the chunks of a text need not come together: their numbers are summed.

What proves that two encodings have met (all offsets are bytes):

* A common start of a word. Words are cut from left to right, and where the next one ends depends only on the text from
  its start on and at most `margin` bytes behind its end. So encodings with a common start of a word are equal from
  there to `margin` before the end of the shorter text.
* Inside a word too long for the overlap: a common token. Byte-pair merges that leave two tokens apart leave them apart
  whatever stands around them, and a row of tokens of which all neighbours stay apart is the encoding of its bytes. So
  the left tokens up to a common one and the right tokens from it on are an encoding together.

If two encodings don't meet (a word of one repeated letter is longer than the overlap, say), all chunks of that text are
encoded again, eight times as long with overlaps eight times as wide, at last the text in one piece. These rules hold for
plain byte-level files; with others (a normalizer, special tokens that eat white space, sentencepiece) texts are encoded whole.

Defined results: a null text is empty and has no tokens; special strings inside texts are what the library's default makes
of them; every row has a row in the result, also repeated ones and those without an id; an empty table gives no rows; other
columns are ignored. A chunk's task holds one chunk, a text's counts are numbers.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import cut

CHUNK, OVERLAP, WIDEN = 1 << 16, 1 << 10, 8
#: Runs of letters, digits or signs end where another kind begins; only contractions, of three characters, end earlier.
LONGEST_CONTRACTION = 3
BATCH = 1 << 20


class Counter:
    """The library's encoding of a tokenizer file: counts, and for plain byte-level files tokens with their bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.margin = None
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.margin = margin(told)
        if self.margin:
            special = {t["content"] for t in told.get("added_tokens") or []}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, number in vocab.items():  # a letter of a byte-level token stands for one byte
                self.bytes_of[number] = len(token.encode()) if token in special else len(token)

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> Tokens:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        lengths = self.bytes_of[np.asarray(e.ids, dtype=np.int64)]
        ends = np.cumsum(lengths)
        # A special token has no word of its own in some versions; its number is below all words.
        word = np.asarray([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], dtype=np.int64)
        return Tokens(ends - lengths, ends, np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, dtype=bool))


@dataclass
class Tokens:
    """Where the tokens of a text start and end, in bytes, and which of them start a word."""

    starts: np.ndarray
    ends: np.ndarray
    opens: np.ndarray

    def word_bytes(self) -> np.ndarray:
        """The length of each token's word."""
        at = np.flatnonzero(self.opens)
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        lengths = np.append(self.starts[at[1:]], self.ends[-1]) - self.starts[at]
        return np.repeat(lengths, np.diff(np.append(at, len(self.opens))))


def margin(told: dict) -> int | None:
    """Bytes behind a start of a word that its being one can depend on; None where the rules above don't hold."""
    model, before = told.get("model") or {}, told.get("pre_tokenizer") or {}
    added = told.get("added_tokens") or []
    special = [t["content"] for t in added]
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not told.get("normalizer")
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        and all(special)
    )
    # Special strings that can overlap are found differently when a text begins inside one.
    overlapping = any(a.endswith(b[:k]) and (a is not b or k < len(a)) for a in special for b in special for k in range(1, len(b) + 1))
    if not plain or overlapping:
        return None
    return 4 * (LONGEST_CONTRACTION + 1 + max(map(len, special), default=0))


def meetings(a: Tokens, b: Tokens, shift: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens at which a (whose offsets are larger by shift) and b have provably met, as numbers of tokens in each.

    Only tokens that end at most at byte `upto` of b count."""
    low, high = np.searchsorted(a.starts, shift), np.searchsorted(a.ends, shift + upto, side="right")
    _, i, j = np.intersect1d(a.starts[low:high] - shift, b.starts[: np.searchsorted(b.ends, upto, side="right")], assume_unique=True, return_indices=True)
    i = i + low
    same_word = a.opens[i] & b.opens[j]
    long_word = 4 * LONGEST_CONTRACTION
    same_token = (a.ends[i] - shift == b.ends[j]) & (a.word_bytes()[i] > long_word) & (b.word_bytes()[j] > long_word)
    met = same_word | same_token
    return i[met], j[met]


def splice(counter: Counter, piece: str, core: int, overlap: int, first: bool, last: bool) -> tuple[int, bool]:
    """What a chunk adds to its text's count, and whether it has met its neighbours.

    The piece is the chunk's own `core` characters and the overlap behind them."""
    own = counter.tokens(piece)
    total = len(own.starts)
    if not last:
        window = piece[core : core + overlap]
        beside, size = counter.tokens(window), len(window.encode())
        i, j = meetings(own, beside, len(piece[:core].encode()), size - counter.margin)
        early = np.flatnonzero(beside.starts[j] <= size // 2)
        if not len(early):
            return 0, False
        total = int(i[early[0]] - j[early[0]])
    if not first:
        window = piece[:overlap]
        beside, size = counter.tokens(window), len(window.encode())
        i, j = meetings(own, beside, 0, size - counter.margin)
        if not len(j) or beside.starts[j[-1]] < size // 2:
            return 0, False
        total -= int(i[-1] - j[-1])
    return total, True


def chunks_of(text: str, chunk: int, overlap: int):
    """(piece, core, first, last) of each chunk; the last one is longer than two overlaps."""
    at = 0
    while len(text) - at > chunk + 2 * overlap:
        yield text[at : at + chunk + overlap], chunk, at == 0, False
        at += chunk
    yield text[at:], len(text) - at, at == 0, True


def count_spliced(counter: Counter, text: str, chunk: int, overlap: int) -> int | None:
    """A text's count from its chunks; None if neighbours haven't met."""
    told = [splice(counter, piece, core, overlap, first, last) for piece, core, first, last in chunks_of(text, chunk, overlap)]
    return sum(n for n, _ in told) if all(ok for _, ok in told) else None


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    return _counters.get(path) or _counters.setdefault(path, Counter(path))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether a text has more than `limit` tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if tokenizer_path.endswith(".model") or not counter_of(tokenizer_path).margin:
        told = _whole(rows, tokenizer_path)
    else:
        if overlap <= 4 * counter_of(tokenizer_path).margin or chunk < 2 * overlap:
            raise ValueError("an overlap must exceed four margins, a chunk two overlaps")
        told = _whole(rows.filter(F.length("text") <= chunk), tokenizer_path).unionByName(_spliced(rows.filter(F.length("text") > chunk), tokenizer_path, chunk, overlap))
    return told.withColumn("over_limit", F.col("n_tokens") > limit)


def _whole(rows: DataFrame, path: str) -> DataFrame:
    def run(batches):
        counter = counter_of(path)

        def told(group, sizes):
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array(sizes, pa.int64()), pa.array(counter.counts([g[1] for g in group]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            group, sizes, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                group.append((doc_id, text.as_py()))
                sizes.append(text.as_buffer().size)
                held += sizes[-1]
                if held >= BATCH:
                    yield told(group, sizes)
                    group, sizes, held = [], [], 0
            if group:
                yield told(group, sizes)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """The counts of long texts. Each round's counts are few numbers a text; texts that failed go to the next round."""
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(13), "text")})
    key, texts, done = ["doc_id", "h1", "h2"], keyed, None
    while True:
        parts = _pieces(texts, chunk, overlap).repartition(*key, "chunk")
        # Repeated rows have the same chunks: their sums are divided by their number.
        sums = _spliced_pieces(parts, path, overlap).groupBy(*key, "n_bytes").agg(F.sum("n").alias("total"), F.min("met").alias("met"), F.count_if(F.col("chunk") == 0).alias("times"))
        told = cut(sums)
        good = told.filter("met").select("doc_id", "n_bytes", F.expr("total div times").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")
        done = good if done is None else done.unionByName(good)
        failed = told.filter("not met").select("h1", "h2").distinct()
        if failed.isEmpty():
            return done
        texts = texts.join(failed, ["h1", "h2"], "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def _pieces(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["doc_id", "h1", "h2", "n_bytes", "chunk", "core", "last", "piece"]

    def run(batches):
        for batch in batches:
            for doc_id, h1, h2, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                whole, size = text.as_py(), text.as_buffer().size
                for k, (piece, core, _, last) in enumerate(chunks_of(whole, chunk, overlap)):
                    row = (doc_id.as_py(), h1.as_py(), h2.as_py(), size, k, core, last, piece)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return texts.select("doc_id", "h1", "h2", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n_bytes long, chunk long, core long, last boolean, piece string")


def _spliced_pieces(parts: DataFrame, path: str, overlap: int) -> DataFrame:
    names = ["doc_id", "h1", "h2", "n_bytes", "chunk"]

    def run(batches):
        counter = counter_of(path)
        for batch in batches:
            told = [splice(counter, piece.as_py(), core, overlap, k == 0, last) for k, core, last, piece in zip(batch.column("chunk").to_pylist(), batch.column("core").to_pylist(), batch.column("last").to_pylist(), batch.column("piece"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([n for n, _ in told], pa.int64()), pa.array([met for _, met in told], pa.bool_())], names=[*names, "n", "met"])

    return parts.mapInArrow(run, "doc_id long, h1 long, h2 long, n_bytes long, chunk long, n long, met boolean")
