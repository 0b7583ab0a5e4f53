"""Rules of any number: what an expression requires, and issues against trying every rule on every line."""

import random
import re
import warnings

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.plans import monitoring, rules
from quarrylight.plans.more_queries import phrase_rules, text_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("regex", "literal"),
    [
        ("^error", "error"), ("errors?", "error"), ("ab*cde", "cde"), ("ab+cde", "cde"), ("a{2}bcd", "bcd"), ("time.out", "time"), (r"a\.b\.c", "a.b.c"), (r"\d+ms later", "ms later"),
        ("(?:x|y)tail", "tail"), ("one|two", ""), ("(?i)error", ""), (r"\Qa.b\E", ""), ("[]a]rest", "rest"), ("[^]a]rest", "rest"), ("[a[b]]rest", ""), (r"[\]x]rest", "rest"), ("(longer inside)out", "out"),
        (r"ends\b of", "ends"), ("", ""), ("(?<name>a)b", ""), (r"\x41bcd", ""), ("abc$", "abc"), ("(ab)?cd", "cd"), ("x{0,2}yz", "yz"), ("(?=ahead)back", "back"), (r"(a)\1bcd", ""), ("\\", ""),
    ],
)
def test_required_literal(regex, literal):
    assert rules.required_literal(regex) == literal


@given(st.text(st.sampled_from("ab.*+?()|[]^{}1,$\\ds"), max_size=12), st.text(st.sampled_from("ab1,ds ."), max_size=10))
def test_a_match_holds_the_literal(regex, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            compiled = re.compile(regex)
    except (re.error, OverflowError):
        return
    if compiled.search(text):
        assert rules.required_literal(regex) in text


@pytest.mark.parametrize(
    ("regex", "literal"),
    [
        (r"(?:^|\s)de\s+la\s+os(?:\s|$)", "de la os"), (r"ab\s+?cd", "ab"), (r"ab\s*cd", "ab"), (r"ab \scd", "ab cd"), ("a \t b", "a b"), (r"a\ b", "a b"), (r"ab\S+cd", "ab"), (r"\s{2}abc", "abc"),
        (r"one\s|two", ""), ("ab +c", "ab "), (r"ab\s++c", "ab "), (r"(?:a\s+b)cd", "cd"), (r"日\s+本", "日 本"),
    ],
)
def test_required_literal_over_white_space(regex, literal):
    assert rules.required_literal(regex, spaced=True) == literal


@given(st.text(st.sampled_from("ab.*+?()|[]^{}1,$\\ds \t"), max_size=12), st.text(st.sampled_from("ab1,ds .\t\n"), max_size=10))
def test_a_match_holds_the_spaced_literal(regex, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            compiled = re.compile(regex)
    except (re.error, OverflowError):
        return
    if compiled.search(text):
        assert rules.required_literal(regex, spaced=True) in re.sub(r"\s+", " ", text)


def lines_of(spark, messages):
    return spark.createDataFrame([("f", i, None, "INFO", m) for i, m in enumerate(messages)], "file string, line_no long, ts timestamp, level string, message string")


def test_against_every_rule_on_every_line(spark):
    told = [(f"p{i}", x, "WARNING", None, None, None) for i, x in enumerate(["^error", "err.r code", "[0-9]{3}", "a|b", "(?i)TIMEOUT", "disk full", r"disk\s+full", "full$", "ab", "", "日本語の", "code \\d+", "x{0}code"])]
    table = monitoring.rule_table(spark, [*told, told[0], ("none", None, "WARNING", None, None, None)])
    messages = ["error code 17", "disk full", "disk   full", "a timeOUT", "", None, "日本語の行", "codes 123 ab", "error code 17"]
    got = rules.rule_issues(lines_of(spark, messages), table)
    want = sorted((i, p) for i, m in enumerate(messages) if m is not None for p, x, *_ in told if re.search(x, m))
    assert sorted((r.line_no, r.pattern) for r in got.collect()) == want
    assert got.columns == ["file", "line_no", "ts", "level", "message", "pattern", "severity", "description", "recommended_action", "related_article"]


@pytest.mark.parametrize(("broadcast", "n"), [(rules.BROADCAST_RULES, 20_000), (5, 500)])
def test_twenty_thousand_rules(spark, broadcast, n, monkeypatch, tmp_path):
    monkeypatch.setattr(rules, "BROADCAST_RULES", broadcast)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    phrase_rules(docs.select("text")).orderBy("pattern").limit(n).write.parquet(str(tmp_path / "rules"))
    table = spark.read.parquet(str(tmp_path / "rules"))
    patterns = {r.pattern for r in table.collect()}
    assert len(patterns) == n
    lines = text_lines(docs)
    got = rules.rule_issues(lines, table)
    if broadcast == 5:
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    want = set()
    for r in lines.filter("message is not null").collect():
        w = r.message.split()
        want |= {(r.file, r.line_no, p) for p in (" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if p in patterns}
    assert {(r.file, r.line_no, r.pattern) for r in got.select("file", "line_no", "pattern").collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_lines_are_asked(spark):
    """Rules of short words are posted too, and lines become rows for what they share with a rule, not for each of their characters."""
    texts = spark.createDataFrame([("de la os ga",), ("a b c",), ("i de ya",), ("the word here",), ("a word of something much longer than that",)], "text string")
    table = phrase_rules(texts)
    indexed, others = rules.posted(table)
    assert others.count() == 0 and indexed.count() == table.count()
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod".split()
    r = random.Random(5)
    messages = [" ".join(r.choice(words) for _ in range(60)) for _ in range(500)]
    hits = ["x a  b\tc", "a b\nc", "of something much", "of something  \x0b much", "xof something much", "de la osga", " de  la os ga ", "日本 i de ya", "i\t\tde ya", "a b", "c", "", " ", "\t \t"]
    assert rules.asking(lines_of(spark, messages), indexed.select("key"), indexed.count()).count() <= 5
    lines = lines_of(spark, messages + hits)
    got = {(x.line_no, x.pattern) for x in rules.rule_issues(lines, table).collect()}
    assert got == {(i, x.pattern) for i, m in enumerate(messages + hits) for x in table.collect() if re.search(x.regex, m)}
    assert len(got) == 8


@pytest.mark.parametrize("stretch", [5, 64, 1 << 16])
def test_held_pieces(stretch, monkeypatch):
    """Pieces over the bounds of stretches are found; pieces over the bounds of texts are not. Slices of a batch count from its own start."""
    monkeypatch.setattr(rules, "STRETCH", stretch)
    r = random.Random(stretch)
    texts = ["".join(r.choice("ab \té") for _ in range(r.randrange(0, 90))) for _ in range(60)]
    data, start = rules._spaced(pa.array(["cut", *texts]).slice(1))
    plain = [re.sub(r"\s+", " ", t).encode() for t in texts]
    assert [data[a:b].tobytes() for a, b in zip(start, start[1:], strict=False)] == plain
    wanted = {p: h[-1] for p in plain[:20] for i in (4, 8, 12, 24) for h in [[x for _, x in rules._hashes(np.frombuffer(p[:i], np.uint8))]] if len(p) >= i for p in [p[:i]]}
    bits = 20
    slots = np.zeros(1 << bits, bool)
    for h in wanted.values():
        slots[[int(h[0]) >> (64 - bits), int(h[0]) & ((1 << bits) - 1)]] = True
    text, key = rules._held(data, start, slots)
    got = set(zip(text.tolist(), key.tolist(), strict=True))
    assert len(got) == len(text)
    assert got == {(i, int(h.view(np.int64)[0])) for i, p in enumerate(plain) for w, h in wanted.items() if w in p}


def test_more_rules_without_literal_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_RULES", 3)
    table = monitoring.rule_table(spark, [(f"p{i}", f"[{i}]", "WARNING", None, None, None) for i in range(8)])
    got = rules.rule_issues(lines_of(spark, ["0 and 7", "35"]), table)
    assert sorted((r.line_no, r.pattern) for r in got.collect()) == [(0, "p0"), (0, "p7"), (1, "p3"), (1, "p5")]


def test_pieces(spark):
    rows = spark.createDataFrame([("abcdeabcde",), ("abc",), ("日本語テ",), ("",), ("a\nb😀c",)], "t string")
    assert [sorted(r[0]) for r in rows.select(rules.pieces(F.col("t"))).collect()] == [["abcd", "bcde", "cdea", "deab", "eabc"], [], ["日本語テ"], [], ["\nb😀c", "a\nb😀"]]


def test_no_rules(spark):
    assert rules.rule_issues(lines_of(spark, ["x"]), monitoring.rule_table(spark, [])).collect() == []


def test_analysis_is_one_pass(spark):
    from quarrylight.plans import queries

    out = queries.log_status(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    lines = queries.log_lines(spark, SF)
    old = monitoring.status(monitoring.findings(lines, queries.RULES), lines)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, old.collect()))


def test_run_over_files(spark):
    lines = spark.createDataFrame([("a", "ERROR", "x"), ("b", "INFO", "y"), ("c", None, "z")], "file string, level string, message string").withColumn("ts", F.lit(None).cast("timestamp"))
    access = spark.createDataFrame([("a", "read", None), ("b", "read", None), ("c", "read", None), ("empty", "read", None), ("gone", "inaccessible", "no path")], "file string, file_status string, problem string")
    told = {r.file: (r.status, r.issues, r.title, r.type) for r in monitoring.run(lines, access, [("z", "^z", "WARNING", None, None, None)]).collect()}
    assert told == {
        "a": ("CRITICAL", 1, "Log analysis: CRITICAL", "error"), "b": ("OK", 0, None, None), "c": ("WARNING", 1, "Log analysis: WARNING", "warning"),
        "empty": ("OK", 0, None, None), "gone": ("FAILED", None, "Log analysis failed: inaccessible", "error"),
    }
