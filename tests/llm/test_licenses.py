import math
import random
import re

import pytest

from quarrylight.llm import licenses


def base(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(texts, notices):
    """labels and score of each text, trying every notice at every shift."""
    split = [words_of(t) for t in texts]
    weight = lambda w: math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) + 1e-3
    out = []
    for t, words in zip(texts, split, strict=True):
        n_base, labels, best = base(t)[1], set(filter(None, base(t)[4].split(","))), 0.0
        for label, text, phrases in notices:
            own = text.split()
            must = {i for p in phrases for at in [next(i for i in range(len(own)) if own[i : i + len(p.split())] == p.split())] for i in range(at, at + len(p.split())) if own[i] not in licenses.STOP_WORDS}
            rare = [i for i, w in enumerate(own) if w not in licenses.STOP_WORDS]
            stands = lambda i, shift: 0 <= shift + i < len(words) and words[shift + i] == own[i]  # noqa: E731, B023
            for shift in range(-len(own), len(words)):
                if all(stands(i, shift) for i in must):
                    labels.add(label)
                    best = max(best, sum(weight(own[i]) for i in rare if stands(i, shift)) / sum(weight(own[i]) for i in rare))
        out.append((",".join(sorted(labels)), 1.0 if n_base else best))
    return out


def test_against_brute_force(spark):
    """Whole notices, damaged ones, and licence words in any order."""
    rng = random.Random(3)
    pool = sorted(licenses.vocabulary()) + licenses.STOP_WORDS + ["other", "words"]
    texts = []
    for label, text, _ in licenses.NOTICES:
        damaged = [w if rng.random() > 0.1 else rng.choice(pool) for w in text.split()]
        texts += [text, " ".join(damaged), " ".join([rng.choice(pool) for _ in range(8)] + text.split() + damaged)]
    texts += [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(30)]
    texts += [" / ".join(rng.sample([t for _, t, _ in licenses.NOTICES], 6)).title() for _ in range(20)]
    rows = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, (labels, score), text in zip(rows, brute(texts, licenses.NOTICES), texts, strict=True):
        assert r.labels == labels, text
        assert abs(r.score - score) < 1e-9, text


def test_very_long_texts_of_licence_words(spark):
    texts = ["public license " * 100_000, "under the mit license " * 50_000, "gnu general public license version " * 40_000 + "3", "permission is hereby granted " * 50_000]
    rows = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_base, r.labels) for r in rows] == [(200_000, 0, ""), (200_000, 50_000, "mit"), (200_001, 0, "gpl-3"), (200_000, 0, "")]


def told(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_given_documents(small_docs):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    for r in licenses.scan(small_docs).collect():
        assert told(r) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert ("gpl-3" in r.labels.split(",")) == ("GNU General Public License, version 3" in texts[r.doc_id])


def test_notices(spark):
    texts = [
        "x Under the MIT License, under the mit-license!",
        "Apache License version 2, CC BY NC and more",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This work is licensed under the GNU General Public License, version 3.",
        "general public license of gnu, version 3 (words, but no notice)",
        "a license for software, hereby granted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "under the mıt license; UNDER THE MIT LICENSEK",
        None,
        "",
    ]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, t in enumerate(texts):
        assert told(rows[n]) == base(t)
    assert [rows[n].labels for n in range(len(texts))] == ["mit", "apache-2,cc-by-nc", "mit", "gpl-3", "", "", "bsd", "", "", ""]
    assert [rows[n].score > 0 for n in range(len(texts))] == [True, True, True, True, False, False, True, False, False, False]


def test_notices_with_many_rarer_words_beside_them(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. "
    gpl = "This work is licensed under the GNU General Public License, version 3."
    prose = "a charge or fee for the source, binary forms, domain, universal purpose and conditions of modification "
    common = ["3 version license public general gnu licensed"] * 40  # so these words are the commonest
    texts = [bsd + gpl, prose * 20 + gpl + prose, bsd, gpl, *common]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)][:5] == ["bsd,gpl-3", "gpl-3", "bsd", "gpl-3", ""]


def test_every_notice_alone_and_among_all_others(spark):
    notices = [(label, text) for label, text, _ in licenses.NOTICES]
    texts = [text for _, text in notices] + [" x ".join(text for _, text in notices)]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, (label, _) in enumerate(notices):
        assert label in rows[n].labels.split(","), label
        assert rows[n].score > 1 - 1e-9
    assert rows[len(notices)].labels == ",".join(sorted({label for label, _ in notices}))


def test_odd_rows(odd, nothing):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 10 and all(r.score == 0 and r.labels == "" for r in rows)
    assert {r.n_words for r in rows if r.doc_id == 6} == {180_000}
    assert licenses.scan(nothing).count() == 0


def test_no_python_on_the_executors(small_docs):
    for frame in (licenses.licence_words(small_docs), licenses.scan(small_docs)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "InArrow", "InPandas", "Exchange"))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("// SPDX-License-Identifier: MIT", "mit"), ("/* SPDX-License-Identifier: GPL-3.0-only */", "gpl-3"), ("# SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"), ("SPDX-License-Identifier: BSD-3-Clause\nint x;", "bsd-3"),
        ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("This library is free under the GNU Library General Public License, version 2.", "lgpl-2"), ("the license identifier is mit", ""), ("SPDX identifier: MIT", ""),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "gpl-2"),
    ],
)
def test_identifiers_and_headers(spark, text, label):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == label
