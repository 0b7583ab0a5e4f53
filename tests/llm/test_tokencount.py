"""Token counts: chunks spliced at proven meetings against the whole text's encoding."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import tokencount
from quarrylight.llm.queries import byte_bpe, op13_token_counts

PARTS = ["a", "x", "the ", " ", "\n", "'s", "'re", "'", "don't", "1", "23", "日", "本語", "é", "<|endoftext|>", "<|endof", "text|>", "😀", "...", "!!", "-", "\t", "ing", " tion", "　", "̀"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(byte_bpe())


def whole(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_spliced_counts_are_the_whole_texts(counter, data):
    few = data.draw(st.lists(st.sampled_from(PARTS), min_size=1, max_size=8, unique=True))
    text = "".join(p * n for p, n in data.draw(st.lists(st.tuples(st.sampled_from(few), st.sampled_from([1, 1, 2, 7, 90])), min_size=40, max_size=150)))
    assert tokencount.count_spliced(counter, text, 800, 300) in (None, whole(counter, text))


def test_ordinary_texts_meet(counter, small_docs):
    texts = [r.text for r in small_docs.filter("length(text) > 2000").collect()]
    assert texts and all(tokencount.count_spliced(counter, t, 800, 400) == whole(counter, t) for t in texts)


def test_long_words_meet_inside(counter):
    """A word of many chunks: byte-pair merges meet at a token, not at a word's start."""
    r = random.Random(5)
    letters = "".join(r.choice("acgt") for _ in range(30_000))
    assert tokencount.count_spliced(counter, letters, 2000, 600) == whole(counter, letters)


def test_a_repeated_letter_does_not_meet_but_is_counted(spark, counter):
    text = "y" + "x" * 20_001 + " end"
    assert tokencount.count_spliced(counter, text, 2048, 600) is None
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    told = tokencount.token_counts(rows, byte_bpe(), chunk=2048, overlap=600).first()
    assert (told.n_tokens, told.n_bytes, told.over_limit) == (whole(counter, text), len(text), True)


def test_special_string_over_a_cut(counter):
    for shift in range(14):
        text = "word " * 160 + "z" * shift + "<|endoftext|> more words" * 80
        assert tokencount.count_spliced(counter, text, 810, 300) == whole(counter, text)


def test_every_row_in_small_chunks(spark, counter, small_docs):
    """Distributed, with chunks so small that most texts are cut; repeated rows keep their rows."""
    docs = small_docs.unionByName(small_docs.filter("doc_id % 3 = 0"))
    told = tokencount.token_counts(docs, byte_bpe(), limit=100, chunk=1200, overlap=400).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), whole(counter, r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in told) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in told)


def test_query(spark, counter, small_docs):
    told = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in small_docs.collect():
        n = whole(counter, r.text or "")
        assert told[r.doc_id] == (len((r.text or "").encode()), n, n > 512)


def test_odd_rows(spark, counter, odd, nothing):
    told = tokencount.token_counts(odd, byte_bpe()).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), whole(counter, r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in told) == want
    assert tokencount.token_counts(nothing, byte_bpe()).collect() == []


def test_other_files_are_encoded_whole(spark, small_docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    docs = small_docs.select("doc_id", F.col("text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    path = public_tokenizers.path("word_bpe_49k.json")
    words = Tokenizer.from_file(path)
    assert tokencount.Counter(path).margin is None
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, path).collect()} == {d: len(words.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, path).collect()} == {d: len(pieces.encode(t)) for d, t in texts.items()}


def test_overlap_must_exceed_its_margins(spark, nothing):
    with pytest.raises(ValueError):
        tokencount.token_counts(nothing, byte_bpe(), chunk=1000, overlap=100)
