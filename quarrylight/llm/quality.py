"""Quality classifier with supervised subword embeddings (operator 4).

Each word and each character n-gram hashes to a row of an embedding table; a document is the
mean of its rows, and a softmax layer gives the class. Table and layer are learned together by
plain stochastic gradient descent in numpy, on a bounded sample of the labelled rows. The
sample's hashed counts come from the executors.

The output is linear in the mean vector, so for scoring the table is multiplied with the layer
once; a text then costs one table look-up per feature. Texts are read whole, in parts of about
a million characters that end at white space, where no feature crosses.

Defined results: a null or empty text has no features and gets the score of the mean document
without any (the bias alone); repeated rows are scored each; an empty table gives no rows; other
columns are ignored. Without labelled texts of both classes nothing is learned, and every row gets the share of
label 1 among the labelled rows (0.98 at most, also if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 1 << 20
_WORD, _GRAM, _REPEAT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


@dataclass(frozen=True)
class Settings:
    """sample_per_class bounds the rows learned from: the first of each class by a hash of doc_id.
    smoothing is added to the number of features in each mean, so that a very short text stays
    near the prior."""

    bits: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    dim: int = 12
    epochs: int = 12
    rate: float = 0.6
    sample_per_class: int = 1200
    smoothing: float = 40.0
    seed: int = 7


def parts(text: str):
    """Whole text in parts that end before white space."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def features(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text that begins and ends at word bounds, and the places where they stand.

    Besides words and n-grams there is one feature for a word that follows itself; a zero
    character between two words, which separates texts, keeps them from counting as that.
    """
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (c <= 32) | (c == 0xA0) | (c == 0x3000)
    shift = np.uint32(32 - settings.bits)
    hashes, places = [], []
    inside = ~space
    starts = np.flatnonzero(inside[1:] & space[:-1]) + 1
    if not len(starts):
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(space[1:] & inside[:-1]) + 1
    lengths = ends - starts
    chars = c[inside]
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(chars), dtype=np.int64) - np.repeat(first, lengths)).astype(np.uint32)
    letters = (chars + place * np.uint32(0x27D4EB2F)) * _WORD
    letters ^= letters >> np.uint32(15)
    letters *= np.uint32(0x2C1B3C6D)
    words = np.add.reduceat(letters, first, dtype=np.uint32)
    hashes.append((words * _WORD) >> shift)
    places.append(starts)
    section = np.cumsum(c == 0)[starts]
    again = np.flatnonzero((words[1:] == words[:-1]) & (section[1:] == section[:-1])) + 1
    hashes.append(np.full(len(again), _REPEAT >> shift, dtype=np.uint32))
    places.append(starts[again])
    # n-grams may begin and end with one white space, which marks a word's edge, and hold none inside
    edge = np.where(space, np.uint32(0x51ED270B), (c + np.uint32(1)) * _GRAM)
    rolled, clean = edge, np.ones(len(c), dtype=bool)
    for n in range(2, max(settings.grams) + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + edge[n - 1 :]
        if n > 2:
            clean = clean[:-1] & ~space[n - 2 : -1]
        else:
            clean = clean[:-1] & ~(space[:-1] & space[1:])
        if n in settings.grams:
            at = np.flatnonzero(clean)
            hashes.append(((rolled[at] + np.uint32(n)) * _GRAM) >> shift)
            places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def hashed_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc columns kept by name `key`, and each row's distinct features with their shares."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = [features(p, settings)[0] for p in parts(text.as_py() or "")]
                ids, n = np.unique(np.concatenate(found), return_counts=True)
                out.append((ids.astype("<u4").tobytes(), (n / (n.sum() + settings.smoothing)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["label", "ids", "shares"])

    return docs.select("label", "text").mapInArrow(run, "label int, ids binary, shares binary")


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Train on (label, ids, shares); returns the folded table and the bias of the log-odds.

    Classes are seen equally often; `prior`, the share of label 1 among all labelled rows, is put
    back into the bias.
    """
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / settings.dim, 1 / settings.dim, (1 << settings.bits, settings.dim)).astype(np.float32)
    layer, bias = np.zeros((settings.dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    by_class = [[r for r in rows if r[0] == k] for k in (0, 1)]
    steps = 2 * max(map(len, by_class))
    total, done = steps * settings.epochs, 0
    for _ in range(settings.epochs):
        orders = [np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps // 2 // len(x)))])[: steps // 2] for x in by_class]
        for pair in zip(*orders, strict=True):
            for label, at in enumerate(pair):
                _, ids, shares = by_class[label][at]
                rate = settings.rate * (1 - done / total)
                done += 1
                mean = shares @ table[ids]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = layer @ p
                layer -= rate * np.outer(mean, p)
                bias -= rate * p
                table[ids] -= (rate * shares)[:, None] * back * np.float32(settings.dim * 4)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + np.log(prior / (1 - prior)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> tuple[np.ndarray, float]:
    """Learn from labelled rows. `labels` has doc_id and label (0 or 1); null labels are left out."""
    settings = settings or Settings()
    known = labels.select(F.col("doc_id"), F.col("label").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    share = known.agg(F.avg("label")).first()[0]
    chosen = None
    for k in (0, 1):
        top = known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_per_class)
        chosen = top if chosen is None else chosen.unionByName(top)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 x sample_per_class rows
    rows = [(r["label"], np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["shares"], "<f4")) for r in hashed_counts(texts, settings).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    rows = [r for r in rows if len(r[1])]
    share = min(max(1.0 if share is None else share, 0.02), 0.98)
    if {r[0] for r in rows} != {0, 1}:
        return np.zeros(1 << settings.bits, dtype=np.float32), float(np.log(share / (1 - share)))
    return learn(rows, share, settings)


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings | None = None, name: str = "score") -> DataFrame:
    """The rows with `name`, the probability of label 1; a column of that name is replaced, all others are kept."""
    settings = settings or Settings()
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            total, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            pending: list[tuple[int, str]] = []
            size = 0

            def flush():
                ends = np.cumsum([len(p) + 1 for _, p in pending])
                hashed, places = features("\0".join(p for _, p in pending), settings)
                # places count the padding; so a feature that begins with the white space before a text is that text's
                owner = np.searchsorted(ends, places, side="right").clip(max=len(pending) - 1)
                rows = np.fromiter((r for r, _ in pending), dtype=np.int64, count=len(pending))[owner]
                total[:] += np.bincount(rows, weights[hashed], minlength=batch.num_rows)
                number[:] += np.bincount(rows, minlength=batch.num_rows)

            for row, text in enumerate(batch.column(text_at)):
                for p in parts(text.as_py() or ""):
                    pending.append((row, p))
                    size += len(p) + 1
                    if size >= PART // 4:
                        flush()
                        pending, size = [], 0
            if pending:
                flush()
            z = total / (number + settings.smoothing) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return docs.mapInArrow(run, schema)
