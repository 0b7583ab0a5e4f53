"""Fill-in-the-middle: cuts by code points against Python's own, and what is read back."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import fim
from quarrylight.llm.queries import op12_fill_in_middle

FOUND = fim.automaton()


def plainly(doc_id, text):
    """The contract, on code points."""
    n = len(text)
    h1, h2, h3, h4 = fim.draws("1:", doc_id)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, a, b - a, out


@given(st.text(st.sampled_from("aB <>PSM\n\x00\x7f\x80éß日本語😀𝄞̀"), max_size=80), st.integers(-5, 10**12))
def test_bytes_as_by_code_points(text, doc_id):
    told = fim.arrange(text.encode(), doc_id, FOUND, fim.Settings())
    assert (*told[:4], told[4].decode()) == plainly(doc_id, text)


@given(st.text(max_size=60))
def test_every_unit_has_its_byte(text):
    told = fim.Ranks(text.encode(), FOUND)
    assert told.total == len(text)
    assert [told.byte_of(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_events_are_sparse():
    text = ("plain ascii words " * 50 + "日本語" * 50) * 20
    assert len(fim.Ranks(text.encode(), FOUND).at) == 41


def test_sentinels_at_seams(spark):
    """Halves of sentinels at the cuts must not read as sentinels."""
    texts = ["<" * 40, "<P" * 30, "S>" * 30, "<S<M<P" * 9, "P>M>S>" * 9]
    rows = spark.createDataFrame([(k, texts[k % 5] * (1 + k % 3)) for k in range(200)], "doc_id long, text string")
    sha = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows.collect()}
    told = fim.digest(rows).collect()
    assert len(told) == 200 and all(r.restored_sha256 == sha[r.doc_id] for r in told) and {r.form for r in told} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd, nothing):
    told = sorted((str(r.doc_id), r.n, r.form, r.output_sha256, r.restored_sha256) for r in fim.digest(odd).collect())
    want = []
    for r in odd.collect():
        n, form, _, _, out = plainly(r.doc_id, r.text or "")
        want.append((str(r.doc_id), n, form, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert told == sorted(want)
    assert fim.digest(nothing).collect() == []


def test_shares(spark):
    told = op12_fill_in_middle(spark, "/root/testdata/sf0.01").groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in told}
    total = sum(n.values())
    assert 0.05 < n["plain"] / total < 0.2 and 0.1 < n["spm"] / (total - n["plain"]) < 0.3


def test_nothing_is_shuffled(spark, small_docs):
    plan = fim.digest(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
