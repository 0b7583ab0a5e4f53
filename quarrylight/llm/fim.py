"""Fill-in-the-middle transformation of whole texts (operator 12).

A text is cut at two code points into prefix, middle and suffix, which are laid out anew around sentinels. Places are drawn
as numbers of code points, texts are UTF-8, so a place must be turned into a byte. One Aho-Corasick automaton reads the
bytes of a text and reports its events: the ASCII characters at which the text changes between ASCII and other
characters, and the sentinels. (It reads bytes by their class, so that it has few patterns.) Between two events there are either ASCII characters alone, so that a unit is a byte, or others
alone; a gap of those whose characters are equally long gives its units by a division, and one that mixes lengths is
divided at the changes. Events are few, so a search among their numbers of units and a multiplication find a place.

Layouts: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle, plain is the text itself. An
empty text stays plain, as does one that holds a sentinel, since it could not be read back, and a share of all. All draws
come from the SHA-256 of a seed and the id, so that a text is cut alike wherever and whenever it is.

Defined results: a null text is empty; a null id draws as an empty string; rows with one id draw alike, and every row has a row in the
result; an empty table gives no rows; other columns are ignored. A text is handled in memory in proportion to its bytes; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The classes of the first bytes of characters that aren't ASCII, and how many bytes these characters have.
WIDTHS = {"2": 2, "3": 3, "4": 4}
STARTS, STOPS, SENTINEL = 1, 2, 3


@dataclass(frozen=True)
class Settings:
    seed: str = "1:"
    plain_percent: int = 10
    spm_percent: int = 20


def _classes() -> bytes:
    """What the automaton reads of each byte: the letters of sentinels as they are, other ASCII as one letter, the first
    byte of a longer character as its length, and the bytes after it as another letter."""
    table = bytearray(b"a" * 0x80 + b"c" * 0x40 + b"2" * 0x20 + b"3" * 0x10 + b"4" * 0x10)
    for letter in LETTERS.encode():
        table[letter] = letter
    return bytes(table)


LETTERS = "".join(sorted(set(PREFIX + SUFFIX + MIDDLE)))
CLASSES = _classes()


def automaton() -> ahocorasick.Automaton:
    """Finds, in the classes of a text's bytes, an ASCII character after another one's last byte, an ASCII character
    before another one's first byte, and the sentinels."""
    found = ahocorasick.Automaton()
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, SENTINEL)
    for ascii_class in "a" + LETTERS:
        found.add_word("c" + ascii_class, STARTS)
        for width in WIDTHS:
            found.add_word(ascii_class + width, STOPS)
    found.make_automaton()
    return found


class Ranks:
    """The gaps between a text's events: where each begins, the units before it, and the bytes of a unit in it."""

    def __init__(self, raw: bytes, found: ahocorasick.Automaton):
        self.at, self.units, self.widths = [0], [0], [1]
        self.sentinel, self.total = False, 0
        classes = raw.translate(CLASSES).decode("ascii")
        start = 0
        for end, kind in found.iter(classes):  # an event ends at the first byte of the next gap
            if kind == SENTINEL:
                self.sentinel = True
                continue
            self._gap(classes, start, end)
            start = end
        self._gap(classes, start, len(raw))

    def _gap(self, classes: str, start: int, end: int) -> None:
        width = WIDTHS.get(classes[start : start + 1], 1)
        if width == 1 or end - start == width or classes.count(classes[start], start, end) * width == end - start:
            self._add(start, width, (end - start) // width)
            return
        while start < end:  # characters of several lengths: a gap for each run of one length
            width, at = WIDTHS[classes[start]], start
            while start < end and classes[start] == classes[at]:
                start += width
            self._add(at, width, (start - at) // width)

    def _add(self, start: int, width: int, units: int) -> None:
        if units:
            self.at.append(start)
            self.units.append(self.total)
            self.widths.append(width)
            self.total += units

    def byte_of(self, unit: int) -> int:
        """The byte at which a unit begins (the end, for the number of all units)."""
        k = bisect_right(self.units, unit) - 1
        return self.at[k] + (unit - self.units[k]) * self.widths[k]


def draws(seed: str, doc_id: int | None) -> list[int]:
    told = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in range(0, 32, 8)]


def arrange(raw: bytes, doc_id: int | None, found: ahocorasick.Automaton, settings: Settings) -> tuple:
    """(units, form, units of the prefix, of the middle, laid-out bytes)"""
    told = Ranks(raw, found)
    h1, h2, h3, h4 = draws(settings.seed, doc_id)
    if not raw or told.sentinel or h3 % 100 >= 100 - settings.plain_percent:
        return told.total, "plain", None, None, raw
    low, high = sorted((h1 % (told.total + 1), h2 % (told.total + 1)))
    a, b = told.byte_of(low), told.byte_of(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < settings.spm_percent:
        return told.total, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return told.total, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null where plain) and the output text."""

    def run(batches):
        found = automaton()
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(doc_id, *arrange(raw, doc_id, found, settings)) for doc_id, raw in zip(ids, texts, strict=True)]
                columns = [list(c) for c in zip(*rows, strict=True)]
                columns[-1] = pa.array(columns[-1], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that was laid out: no part holds a sentinel, so the first one found is the one that was put in."""
    width = len(PREFIX)
    middle_at = F.locate(MIDDLE, output)
    second_at = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    first = F.substr(output, F.lit(width + 1), second_at - width - 1)
    second = F.substr(output, second_at + width, middle_at - second_at - width)
    middle = F.substr(output, middle_at + width)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What is laid out, with the hash of the output and that of the text read back from it."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return transform(docs, settings).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
