from quarrylight.llm import linededup


def brute(rows, min_words):
    """Later copies of repeated runs, looked for pair by pair."""
    docs = sorted(rows, key=lambda r: r[0])
    lines = [[(n, x.strip(" \t\r\v\f")) for n, x in enumerate(t.split("\n"))] for _, t in docs]
    lines = [[(n, x) for n, x in d if x] for d in lines]
    out = {}
    for b, later in enumerate(lines):
        gone = set()
        for i in range(len(later)):
            for a, first in enumerate(lines[: b + 1]):
                for j in range(len(first)):
                    if (a, j) >= (b, i):
                        break
                    n = 0
                    while i + n < len(later) and j + n < len(first) and later[i + n][1] == first[j + n][1]:
                        n += 1
                    if n and sum(len(x.split()) for _, x in later[i : i + n]) >= min_words:
                        gone.update(range(later[i][0], later[i + n - 1][0] + 1))
        text = docs[b][1].split("\n")
        left = [x for n, x in enumerate(text) if n not in gone]
        out[docs[b][0]] = ("\n".join(left) if any(x.strip() for x in left) or not gone else "", len(gone))
    return out


def run(spark, rows, min_words):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r.lines_removed) for r in linededup.dedup_lines(frame, min_words).collect()}


def test_runs(spark):
    rows = [
        (1, "head line\nalpha beta gamma\ndelta epsilon\n\nzeta eta\nown words of one"),
        (2, "head line\nother start here\nalpha beta gamma\ndelta epsilon\nzeta eta\n"),  # a run over a blank line
        (3, "delta epsilon\nnew\ndelta epsilon"),  # too short alone
        (4, "x y z\nx y z\nx y z\nx y z"),  # repeats inside one document
        (5, "head line\nalpha beta gamma\ndelta epsilon\n\nzeta eta\nown words of one"),  # an exact copy
        (6, " alpha beta gamma \n\tdelta epsilon"),
    ]
    for min_words in (1, 3, 5, 6, 8, 20):
        assert run(spark, rows, min_words) == brute(rows, min_words), min_words


def test_random_runs(spark):
    import random

    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    rows = [(n, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for n in range(30)]
    for min_words in (4, 9):
        assert run(spark, rows, min_words) == brute(rows, min_words)


def test_repeated_documents(spark):
    passage = "one two three\nfour five six\nseven eight nine"
    rows = [
        (1, f"own start\n{passage}\nown end"),
        (2, f"another start\n{passage}\nanother end\n{passage}"),
        (3, passage),
        (4, "lone line\nonly in this document\nand in its repeats\nwith these lines"),
    ]
    for again in ([2], [1], [1, 2, 4], [1, 1, 2, 3, 4]):
        assert run(spark, rows + [rows[n - 1] for n in again], 8) == brute(rows, 8), again
    other = (1, f"{passage}\nwith the same id")
    out = linededup.dedup_lines(spark.createDataFrame([*rows, other, other, rows[0]], "doc_id long, text string").repartition(5))
    assert sorted(r.lines_removed for r in out.collect() if r.doc_id == 1) == [0, 0, 3, 3]
    assert {r.doc_id: r.lines_removed for r in out.collect() if r.doc_id != 1} == {2: 6, 3: 3, 4: 0}


def test_ranks_sort_suffixes(spark):
    frame = spark.createDataFrame([(1, "a\nb\na\nb\nc\na\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    rows = linededup.sorted_suffixes(linededup.line_ids(frame), 4).collect()
    text = {1: "ababcabc", 2: "abc"}
    for x in rows:
        for y in rows:
            for k in range(3):
                same = text[x.doc_id][x.pos : x.pos + 2**k] == text[y.doc_id][y.pos : y.pos + 2**k]
                assert (x.ranks[k] == y.ranks[k]) == same, (x, y, k)


def test_odd_rows(odd, nothing):
    out = linededup.dedup_lines(odd)
    got = {(r.doc_id, r.text, r.lines_removed) for r in out.collect()}
    assert out.count() == 10 and {x for x in got if x[0] == 2} == {(2, None, 0)} and {x for x in got if x[0] == 3} == {(3, "", 0)}
    assert linededup.dedup_lines(nothing).count() == 0
