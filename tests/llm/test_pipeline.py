"""Every stage of the pipeline against a plain computation, and on odd tables."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quarrylight.llm import quality, simhash
from tests.llm.conftest import CLASHING, COLUMNS, ODD
from tests.llm.test_decontam import ITEM
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_packing import check_places, pieces_of
from tests.llm.test_quality import plain_score

SF = "/root/testdata/sf0.001"
FAR, NEAR = " ".join(f"a{n}" for n in range(300)), " ".join(f"b{n}" for n in range(300))
LEAK = " ".join(f"c{n}" for n in range(100)) + f" {ITEM}"
#: Two texts with one id, near copies of both, an exact copy, repeated rows, texts without an id.
REPEATED = [(1, FAR), (1, NEAR), (2, FAR + " x"), (3, NEAR + " y"), (3, FAR), (4, f"so {ITEM} it goes"), (4, "clean words with the id of another"), (5, "alone"), (5, "alone"), (None, "no id but a text"), (None, "no id but a text"), (None, LEAK)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Odd documents, labels with nulls, and benchmark items short and long."""
    at = tmp_path_factory.mktemp("tables")
    rows = ODD + [(100 + n, t, "en", "s", len(t)) for n, t in enumerate([FAR, NEAR, FAR + " x", f"it holds {ITEM} inside"])]
    odd = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in CLASHING})
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, None), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "plain words")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_tables(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    if name != "packing":
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert {r.score for r in out.collect()} <= {"clash"}
    assert out.count() <= 3 * docs.count() + 1000
    assert stage(spark, docs.limit(0), folder).count() == 0


def given(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in REPEATED], COLUMNS)


def told(out):
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_duplicates_keep_different_texts_of_one_id(spark, folder):
    out = told(pipeline.drop_near_duplicates(spark, given(spark), folder))
    want = [(1, FAR), (1, NEAR), (4, f"so {ITEM} it goes"), (4, "clean words with the id of another"), (5, "alone"), (None, "no id but a text"), (None, LEAK)]
    assert out == sorted(want, key=str)


def test_decontamination_keeps_different_texts_of_one_id(spark, folder):
    out = told(pipeline.drop_contaminated(spark, given(spark), folder))
    assert out == sorted([(i, t) for i, t in REPEATED if ITEM not in t], key=str)


def wide_print(text):
    """The bits of all words of the wide fingerprint, counted one by one."""
    words = (text or "").encode().lower().split()
    import xxhash

    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), seed=42) for i in range(max(1, len(words) - 4))] if words else []
    out = []
    for k in range(simhash.WIDE["words"]):
        mixed = np.array(hashes, dtype=np.uint64)
        if k:
            mixed = simhash.mix64(mixed + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        out.append(sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in mixed) > len(hashes)) if hashes else 0)
    return out


def test_near_duplicates_against_all_pairs(spark, small_docs):
    rows = [r for r in small_docs.collect() if len(r.text or "") < 1500]
    rows += [Row(**{**r.asDict(), "doc_id": r.doc_id + 10_000, "text": r.text + " and three more words"}) for r in rows[:40]]
    docs = spark.createDataFrame(rows, small_docs.schema)
    prints = [wide_print(r.text) for r in rows]
    parent = {n: n for n in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            apart = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
            blocks = (((x ^ y) >> s) & 0xFFFFFFFF for x, y in list(zip(prints[a], prints[b], strict=True))[: simhash.WIDE["posted"]] for s in (0, 32))
            if sum(apart) <= simhash.WIDE["limit"] and apart[simhash.WIDE["posted"]] <= simhash.BESIDE_LIMIT and any(x.bit_count() <= 2 for x in blocks):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(root(n), []).append(r.doc_id)
    assert len(groups) < len(rows)
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got) == sorted(min(g) for g in groups.values())


def test_decontamination_against_all_windows(spark, small_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in small_docs.collect() if len(r.text or "") < 1100]  # two of these hold a passage
    leaks = {d for (d, _), (_, _, _, window) in brute_leaks(docs, items).items() if window >= 8}
    chosen = small_docs.filter(F.col("doc_id").isin([d for d, _ in docs]))
    assert leaks and sorted(r.doc_id for r in pipeline.drop_contaminated(spark, chosen, SF).collect()) == sorted(d for d, _ in docs if d not in leaks)


def test_line_dedup_against_all_pairs(spark, small_docs):
    chosen = small_docs.filter(F.length("text") < 1200).limit(80)
    rows = [(r.doc_id, r.text) for r in chosen.collect()]
    want = {i: t for i, (t, gone) in brute_lines(rows, 8).items() if not gone or t}
    docs = small_docs.filter(F.col("doc_id").isin([i for i, _ in rows]))
    out = pipeline.drop_repeated_lines(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in out} == want
    changed = dict(rows)
    assert all(r.n_chars == len(r.text) for r in out if r.text != changed[r.doc_id])


def test_quality_against_plain_scores(spark, small_docs):
    labels = pipeline.read_table(spark, SF, "labels").filter(pipeline.crc_mod("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(small_docs, labels)
    scores = {r.doc_id: plain_score(r.text, model, quality.Settings()) for r in small_docs.filter(F.length("text") < 2000).collect()}
    kept = {r.doc_id for r in pipeline.keep_quality(spark, small_docs, SF).collect()}
    assert all((i in kept) == (s >= pipeline.KEEP_AT) for i, s in scores.items() if abs(s - pipeline.KEEP_AT) > 1e-6)


def test_packing_against_the_tokenizer(spark, small_docs):
    out = pipeline.pack_sequences(spark, small_docs, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted((r.doc_id, *p) for r in small_docs.collect() for p in pieces_of(r.text))
    check_places(out)


def test_the_whole_pipeline(spark, folder):
    """Every stage works on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    out = pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
    assert pipeline.run(spark, folder).count() > 0
