"""Helpers that several operators share: checkpoints, byte tables, word hashes."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quarrylight-checkpoints-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Plans made inside give their shuffle files back when their action ends, and not when the driver happens to collect its
    garbage: for plans that are run once, into a checkpoint. A stage run again after that would be computed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo a small number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def byte_table(is_separator) -> np.ndarray:
    """A 256-entry map: separators to 0, A-Z to a-z, other bytes to themselves."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(256):
        if is_separator(b):
            table[b] = 0
        elif 65 <= b <= 90:
            table[b] = b + 32
    return table


#: Words are runs of bytes other than ASCII white space.
SPACED = byte_table(lambda b: b == 32 or 9 <= b <= 13)
#: Words are runs of ASCII letters and digits and of all bytes from 0x80.
ALNUM = byte_table(lambda b: b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))

_DEPTH = 1024
_TABULATION = np.random.default_rng(20260101).integers(0, 1 << 64, size=(_DEPTH, 256), dtype=np.uint64).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on an array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PART = 1 << 20


def word_hashes(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a byte string, and their start offsets.

    Each byte is looked up in a random table by its place in the word (beyond 1024 bytes the table's numbers are multiplied,
    by another odd number for each further 1024); the sum, mixed with the word's length, is the hash. Equal words have equal hashes wherever they stand. Long data
    is taken in parts of about a megabyte that end between words.
    """
    raw = table[np.frombuffer(data, dtype=np.uint8)]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = at + _PART
        while end < len(raw) and raw[end]:
            end += 1
        h, s = _hashes_of(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _hashes_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = raw != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    chars = raw[raw != 0].astype(np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    numbers = _TABULATION[(place % _DEPTH) * 256 + chars]
    if lengths.max() > _DEPTH:
        far = place >= _DEPTH
        numbers[far] *= mix64((place[far] // _DEPTH).astype(np.uint64)) | np.uint64(1)
    sums = np.add.reduceat(numbers, first)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def chunks(ids: list, texts, limit: int = 1 << 20):
    """Rows of an Arrow batch in groups of about `limit` bytes: (ids, encoded texts). Null texts are empty."""
    group: list = []
    data: list[bytes] = []
    size = 0
    for doc_id, text in zip(ids, texts, strict=True):
        raw = (text.as_py() or "").encode()
        group.append(doc_id)
        data.append(raw)
        size += len(raw)
        if size >= limit:
            yield group, data
            group, data, size = [], [], 0
    if group:
        yield group, data
