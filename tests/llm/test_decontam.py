import itertools

import numpy as np
import pytest

from quarrylight.llm import decontam


@pytest.mark.parametrize("window", range(8, 17))
def test_masks_are_lossless(window):
    """Wherever the allowed substitutions fall, some mask hits inside the window."""
    for wrong in itertools.combinations(range(window), decontam.allowed(window)):
        assert any(all(p + k not in wrong for k, bit in enumerate(m) if bit == "1") for m in decontam.MASKS for p in range(window - len(m) + 1))


def test_masks_ignore_their_gaps():
    words = np.arange(20, dtype=np.uint64)
    other = words.copy()
    other[4] = 99
    a, b = (decontam.masked_hashes(w, "1111011", 0) for w in (words, other))
    assert a[0] == b[0] and a[1] != b[1]


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec"


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.substitutions, r.doc_start, r.item_start, r.window) for r in decontam.contaminated(d, i).collect()}


def test_substitutions(spark):
    words = ITEM.split()
    swap = lambda *at: " ".join("zz" if k in at else w for k, w in enumerate(words))
    docs = [(1, "so " + ITEM.upper() + "."), (2, swap(2, 7, 12)), (3, swap(2, 6, 9, 12)), (4, "x " + " ".join(words[:15])), (5, swap(0, 3, 8, 13)), (6, "one two three four five six SEVEN eight"), (7, "one two"), (1, "so " + ITEM.upper() + ".")]
    items = [(10, ITEM), (11, "one two three nil five six seven eight"), (12, "one two"), (13, None)]
    got = run(spark, docs, items)
    assert got == {(1, 10): (0, 1, 0, 16), (2, 10): (3, 0, 0, 16), (5, 10): (3, 1, 1, 16), (6, 11): (1, 0, 0, 8), (6, 12): (0, 0, 0, 2), (7, 12): (0, 0, 0, 2)}


def test_short_items_are_found_as_they_are(spark):
    docs = [(1, "A b! c d e"), (2, "b c"), (3, "x"), (4, "d e f g h i j k"), (5, "d e f z h i j")]
    items = [(1, "b c"), (2, "X"), (3, "d e f g h i j"), (4, ""), (5, " - ")]
    assert run(spark, docs, items) == {(1, 1): (0, 1, 0, 2), (2, 1): (0, 0, 0, 2), (3, 2): (0, 0, 0, 1), (4, 3): (0, 0, 0, 7)}


def brute(docs, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = {}
    for d, text in docs:
        for i, item in items:
            own, want = words(text), words(item)
            n = min(len(want), 16)
            places = [(sum(a != b for a, b in zip(own[p : p + n], want[q : q + n], strict=True)), p, q) for p in range(len(own) - n + 1) for q in range(len(want) - n + 1)] if n else []
            places = [x for x in places if x[0] <= decontam.allowed(n)]
            if places:
                out[d, i] = (*min(places), n)
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(pool[k] for k in rng.integers(len(pool), size=n))
    items = [(k, say(int(n))) for k, n in enumerate([1, 2, 5, 7, 8, 9, 11, 12, 15, 16, 17, 30])]
    docs = [(k, say(40)) for k in range(20)]
    for k in range(60):  # passages with some words replaced
        text = items[k % len(items)][1].split()
        for at in rng.integers(len(text), size=int(rng.integers(0, 5))):
            text[at] = "zz"
        docs.append((100 + k, f"{say(5)} {' '.join(text)} {say(5)}"))
    assert run(spark, docs, items) == brute(docs, items)


def test_repetitive_texts(spark):
    """All shifts of a long repetitive text are verified in one row."""
    assert run(spark, [(1, "a b c " * 100_000)], [(1, "a b c a b c a b c"), (2, "b c a " * 10)]) == {(1, 1): (0, 0, 0, 9), (1, 2): (0, 0, 2, 16)}


def test_other_keys(spark):
    docs = spark.createDataFrame([(1, 7, ITEM), (1, 8, "clean")], "doc_id long, part long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"), ("doc_id", "part")).collect()
    assert [(r.doc_id, r.part, r.item_id) for r in got] == [(1, 7, 1)]


def test_words_that_differ_far_from_their_start():
    from quarrylight.llm.common import ALNUM, word_hashes

    word = bytearray(b"x" * 5000)
    seen = set()
    for at in (3, 1027, 2051, 4099):
        other = word.copy()
        other[at] = ord("y")
        seen.add(int(word_hashes(bytes(other), ALNUM)[0][0]))
    assert len(seen) == 4
    assert word_hashes(b"a " + bytes(word) + b" a", ALNUM)[0].tolist() == [*word_hashes(b"a", ALNUM)[0].tolist(), *word_hashes(bytes(word), ALNUM)[0].tolist(), *word_hashes(b"a", ALNUM)[0].tolist()]


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "a b c a b c a b c"), (2, "")], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(odd, items).collect()] == [6]
    assert decontam.contaminated(nothing, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0


def test_rests_meet_exactly_within_the_bound():
    rng = np.random.default_rng(3)
    for n in (8, 11, 12, 15, 16):
        window = rng.integers(1 << 60, size=n)
        for wrong in range(6):
            other = window.copy()
            other[rng.permutation(n)[:wrong]] += 1
            assert bool(np.intersect1d(decontam.rests(window), decontam.rests(other)).size) == (wrong <= decontam.allowed(n))


@pytest.mark.parametrize("prompt_words", [8, 12, 13, 20])
def test_many_items_with_one_prompt(spark, prompt_words):
    """Hot seeds are looked up by whole windows; the rows are those of brute force, however long the shared passage is."""
    rng = np.random.default_rng(prompt_words)
    pool = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(pool[k] for k in rng.integers(len(pool), size=n))
    prompt = say(prompt_words)
    items = [(k, f"{prompt} {say(int(n))}") for k, n in enumerate(rng.integers(0, 12, size=25))] + [(30, say(9)), (31, f"{say(8)} {prompt}"), (32, "w1 w2")]
    docs = [(k, f"{say(int(rng.integers(0, 20)))} {prompt} {say(int(rng.integers(0, 20)))}") for k in range(25)]
    for k in range(40):
        text = items[k % len(items)][1].split()
        for at in rng.integers(len(text), size=int(rng.integers(0, 5))):
            text[at] = "zz"
        docs.append((100 + k, f"{say(3)} {' '.join(text)} {say(3)}"))
    docs += [docs[0], (200, f"{prompt} " * 30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for hot in (3, 1000):
        got = decontam.contaminated(d, i, hot_items=hot).collect()
        assert {(r.doc_id, r.item_id): (r.substitutions, r.doc_start, r.item_start, r.window) for r in got} == brute(docs, items)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
