import numpy as np
from pyspark.sql import functions as F

from quarrylight.llm import quality
from quarrylight.llm.queries import op4_quality

S = quality.Settings(epochs=4, sample_per_class=150)


def plain_features(text, settings):
    """Hashed features of a text, character by character."""
    m32 = (1 << 32) - 1
    space = lambda ch: ord(ch) <= 32 or ord(ch) in (0xA0, 0x3000)
    shift = 32 - settings.bits
    padded, out = f" {text} ", []
    words, at = [], 0
    while at < len(padded):
        if space(padded[at]):
            at += 1
            continue
        end = at
        while end < len(padded) and not space(padded[end]):
            end += 1
        total = 0
        for place, ch in enumerate(padded[at:end]):
            x = (ord(ch) + place * 0x27D4EB2F) * 0x9E3779B1 & m32
            x ^= x >> 15
            total = total + x * 0x2C1B3C6D & m32
        words.append((total, padded[:at].count("\0")))
        out.append((total * 0x9E3779B1 & m32) >> shift)
        at = end
    out += [0xC2B2AE3D >> shift for a, b in zip(words, words[1:], strict=False) if a == b]
    edge = [0x51ED270B if space(ch) else (ord(ch) + 1) * 0x85EBCA77 & m32 for ch in padded]
    for n in settings.grams:
        for at in range(len(padded) - n + 1):
            gram = padded[at : at + n]
            if any(space(ch) for ch in gram[1:-1]) or (n == 2 and space(gram[0]) and space(gram[1])):
                continue
            x = edge[at]
            for k in range(1, n):
                x = ((x ^ (x >> 15)) * 0x2C1B3C6D + edge[at + k]) & m32
            out.append(((x + n) * 0x85EBCA77 & m32) >> shift)
    return out if words else []


def plain_score(text, model, settings):
    weights, bias = model
    own = plain_features(text or "", settings)
    z = sum(float(weights[h]) for h in own) / (len(own) + settings.smoothing) + bias
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_plain_computation(spark, small_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(small_docs, labels, S)
    docs = small_docs.filter(F.length("text") < 1500)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " x x\u00a0x "), (-4, "\u65e5\u672c \U0001f642")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).coalesce(1)
    got = quality.score(rows, model, S).collect()
    assert len(got) > 50 and all(abs(r.score - plain_score(r.text, model, S)) < 1e-5 for r in got)


def test_score_does_not_depend_on_neighbours():
    texts = ["one one two", "", "Zwei  Wörter", "x" * 50, "a\nb\tc"]
    alone = [sorted(quality.features(t, S)[0].tolist()) for t in texts]
    hashed, places = quality.features("\0".join(texts), S)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), places, side="right").clip(max=len(texts) - 1)
    assert [sorted(hashed[owner == k].tolist()) for k in range(len(texts))] == alone


def test_parts_cover_whole_texts():
    text = "ab cd " * 400_000
    assert "".join(quality.parts(text)) == text
    whole = np.bincount(quality.features(text, S)[0], minlength=1 << S.bits)
    assert (sum(np.bincount(quality.features(p, S)[0], minlength=1 << S.bits) for p in quality.parts(text)) - whole).sum() <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.7 for g in good]) > 0.97


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (2, None), (99, 1)], "doc_id long, label int")
    out = quality.score(odd, quality.fit(odd, labels, S), S)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in out.collect())
    none = quality.fit(nothing, labels.limit(0), S)
    assert quality.score(nothing, none, S).count() == 0
    assert {round(r.score, 6) for r in quality.score(odd, none, S).collect()} == {0.98}
    assert len({r.score for r in out.filter(F.col("doc_id") == 1).collect()}) == 1
