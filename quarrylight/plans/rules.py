"""Rules without number: an index of what their expressions require, joined with the lines.

Most expressions can only match a line that holds a certain literal, once each run of white space is taken as one space. The rules
are posted under a piece of this literal (4 to 24 bytes, as long as the literal allows; the rarest of the literal's pieces
among the rules). A bitmap of the posted pieces, of bounded size, goes to the lines: only lines that hold some of them become rows,
one for each such piece, and only the pairs that meet are matched. Rules of which no such literal is known are tried on every
line, up to a thousand in a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quarrylight.plans.monitoring import MAX_RULES, issues
from quarrylight.sources.writers import computed_once

PIECE = 4
#: Pieces grow by PIECE bytes up to this many.
LONGEST = 24
#: Slots of the bitmap for each rule, and the most slots it has, as a power of two.
SLOTS, MOST_BITS = 256, 26
#: Bytes of text that are hashed at a time.
STRETCH = 1 << 16
BROADCAST_RULES = 100_000
FIELDS = ("pattern", "regex", "severity", "description", "recommended_action", "related_article")
AT = ("file", "line_no", "ts", "level", "message")
_SPECIAL = set(".^$*+?()[]{}|\\")
_WHITE = " \t\n\x0b\f\r"  # what \s is to Spark's expressions
_IS_WHITE = np.isin(np.arange(256), list(_WHITE.encode()))
_SPACED = np.where(_IS_WHITE, 32, np.arange(256)).astype(np.uint8)


def required_literal(regex: str, spaced: bool = False) -> str:
    """The longest run of characters that every match must hold; empty if none is known.

    Only what stands outside groups and classes counts. An expression of alternatives, or with flags, has none. With `spaced`, the
    run is one of the text in which each run of white space is one space, so that it goes on over `\\s+`."""
    best = run = ""
    depth = i = 0
    while i < len(regex):
        c, size, literal = regex[i], 1, ""
        if c == "\\" and i + 1 < len(regex):
            size = 2
            n = regex[i + 1]
            if n in "QE" or n.isdigit():
                return ""  # quotations and references
            if n in "xucpPNkg0":
                return ""  # spellings of several characters
            literal = n if not n.isalnum() else ""
            if spaced and n == "s":
                literal, size = " ", 3 if regex[i + 2 : i + 3] == "+" else 2
        elif c == "[":
            end = i + 1
            if regex[end : end + 1] == "^":
                end += 1
            end += 1  # a bracket at the beginning is itself
            while end < len(regex) and regex[end] != "]":
                if regex[end] == "[" or regex[end : end + 2] == "&&":
                    return ""  # classes in classes
                end += 2 if regex[end] == "\\" else 1
            size = end + 1 - i
        elif c == "|" and not depth:
            return ""
        elif c == "{":  # how often; what it follows was left out
            size = max(regex.find("}", i) + 1 - i, 1)
        elif c == "(":
            if regex[i : i + 2] == "(?" and regex[i : i + 3] not in ("(?:", "(?=", "(?!"):
                return ""
            depth += 1
        elif c == ")":
            depth -= 1
        elif c not in _SPECIAL:
            literal = c
        after = regex[i + size : i + size + 1]
        optional = after in ("*", "?", "{") and after != ""
        if literal and not depth and not optional:
            if spaced and literal in _WHITE:
                literal = "" if run.endswith(" ") else " "
            run += literal
            if after == "+":
                best, run = max(best, run, key=len), ""
        elif not (c in "^$" and size == 1):
            best, run = max(best, run, key=len), ""
        i += size
    return max(best, run, key=len)


def pieces(text, size: int = PIECE):
    """The different pieces of `size` characters of a text column, cut from its list of characters: a substring would look for
    its place from the text's beginning each time."""
    letters = F.split(text, "")
    at = lambda c, i, k: F.get(c, i + k)
    cut = F.transform(F.array(letters), lambda c: F.transform(F.sequence(F.lit(0), F.length(text) - size), lambda i: F.concat(*(at(c, i, k) for k in range(size)))))
    return F.when(F.length(text) >= size, F.array_distinct(F.flatten(cut))).otherwise(F.array().cast("array<string>"))


def _hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 4, 8, ... LONGEST bytes the hashes of the pieces of so many bytes, one at each place; each goes on from the one before."""
    wide = data.astype(np.uint64)
    four = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
    h = np.full(len(four), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for size in range(PIECE, min(LONGEST, len(data)) + 1, PIECE):
        h = (h[: len(data) - size + 1] ^ four[size - PIECE :]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        yield size, h


@pandas_udf(T.ArrayType(T.LongType()))
def _keys(regex: pd.Series) -> pd.Series:
    """The hashes of the longest pieces of what an expression requires; none, if that is too short."""

    def of(r) -> np.ndarray:
        h = np.zeros(0, np.uint64)
        data = np.frombuffer(required_literal(r, spaced=True).encode(), np.uint8)
        if len(data) >= PIECE:
            for _, h in _hashes(data):  # noqa: B007  the last one
                pass
        return np.unique(h.view(np.int64))

    return regex.map(of)


def posted(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules with the hash of the piece under which they are found, and those that have none."""
    told = computed_once(rules.select(*FIELDS).filter("regex is not null").withColumn("keys", _keys("regex")))
    long_enough = told.filter(F.size("keys") > 0).withColumn("rule_id", F.xxhash64(*FIELDS))
    each = long_enough.select("rule_id", "regex", F.explode("keys").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("rules"))
    rarest = each.join(common, "key").groupBy("rule_id", "regex").agg(F.min_by("key", F.struct("rules", "key")).alias("key"))
    return long_enough.join(rarest, ["rule_id", "regex"]).drop("rule_id", "keys"), told.filter(F.size("keys") == 0).drop("keys")


def _spaced(message: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with each run of white space as one space, and where each text begins and the last ends."""
    start = np.frombuffer(message.buffers()[1], np.int64 if pa.types.is_large_string(message.type) else np.int32)[message.offset : message.offset + len(message) + 1].astype(np.int64)
    data = np.frombuffer(message.buffers()[2] or b"", np.uint8)[start[0] : start[-1]]
    start = start - start[0]
    white = _IS_WHITE[data]
    more = np.zeros(len(data), bool)
    more[1:] = white[1:] & white[:-1]
    more[start[start < len(data)]] = False
    return _SPACED[data[~more]], start - np.searchsorted(np.flatnonzero(more), start)


def _held(data: np.ndarray, start: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that hold pieces whose slots are taken, and these pieces' hashes, each once for a text, in order of texts."""
    bits = len(slots).bit_length() - 1
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(data) - PIECE + 1, STRETCH):
        for size, h in _hashes(data[low : low + STRETCH + LONGEST - 1]):
            h = h[:STRETCH]
            at = np.flatnonzero(slots[(h >> np.uint64(64 - bits)).view(np.int64)])
            at = at[slots[(h[at] & np.uint64(len(slots) - 1)).view(np.int64)]]
            text = np.searchsorted(start, low + at, side="right") - 1
            inside = low + at + size <= start[text + 1]
            texts.append(text[inside])
            keys.append(h[at[inside]].view(np.int64))
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[first], key[first]


def _bitmap(keys: DataFrame, rules: int) -> np.ndarray:
    """A bit for each of the two slots of each key, in words of 64."""
    bits = min(max((SLOTS * rules).bit_length(), 16), MOST_BITS)
    slot = F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))).alias("slot")
    words = keys.select(slot).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros((1 << bits) // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def asking(lines: DataFrame, keys: DataFrame, rules: int) -> DataFrame:
    """The lines (columns AT) that hold pieces of the given keys, with a row for each such `key`; by a small chance also for another."""
    told = lines.filter("message is not null").select(*AT)
    shared = lines.sparkSession.sparkContext.broadcast(_bitmap(keys, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            text, key = _held(*_spaced(batch.column("message")), slots)
            at, begin = np.unique(text, return_index=True)
            held = pa.ListArray.from_arrays(pa.array(np.append(begin, len(text)), pa.int32()), pa.array(key, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, held], names=[*AT, "keys"])

    schema = T.StructType([*told.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    return told.mapInArrow(run, schema).select(*AT, F.explode("keys").alias("key"))


def rule_issues(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """An issue for each line and rule whose expression it matches, for rules of any number.

    lines: file, line_no, ts, level, message; rules as of `rule_table`. A rule that is given twice, or a null message, gives no
    more issues. The index is broadcast up to BROADCAST_RULES rules; a larger one is joined by a shuffle on the pieces."""
    indexed, others = posted(rules.distinct())
    indexed = computed_once(indexed)  # counted first, then joined
    wanted = [c for c in FIELDS if c != "regex"]
    n = indexed.count()
    index = F.broadcast(indexed) if n <= BROADCAST_RULES else indexed.hint("merge")
    met = asking(lines, indexed.select("key"), n).join(index, "key").filter(F.expr("message rlike regex")).select(*AT, *wanted)
    rest = sorted(tuple(r) for r in others.select(*FIELDS).toLocalIterator())
    for k in range(0, len(rest), MAX_RULES):
        met = met.unionByName(issues(lines, rest[k : k + MAX_RULES]))
    return met
