"""License scan with a positional rare-token index, in Spark expressions only (operator 10).

A library holds licence notices as word sequences. Its words without the stop words are the licence words. In each file:

1. the places of licence words are found, and the places of three fixed phrases (the base labels);
2. every place of a key word is looked up in the postings of the notices (word -> notice, place), which
   gives the notice at one shift between notice and file. The key word of a notice is its mandatory word with
   the highest IDF, counted over all files, so a file with the notice always has it;
3. a notice at a shift is accepted if every word of its mandatory key phrases stands where that shift
   puts it. Its coverage is the IDF-weighted share of the notice's licence words that stand in place.

Licence words are kept as two arrays (place and number of the word). The words of a notice can only be among the few
licence words next to its key word, so each look-up reads a slice as long as the notice, and the work is in
proportion to the licence words of a file however often they repeat. All of it happens inside the file's row: no
rows are made, joined or shuffled. The postings have the size of the notice library, whatever the corpus.

Words are ASCII letters and digits, lower-cased, and all other characters from U+0080. Long notices with places for
names in them are several entries, one for each stretch between such places.

Defined results: a null or empty text has no words, labels '' and score 0; repeated rows are reported each;
an empty table gives no rows; other columns are ignored. The score is 1 where a base phrase stands, and
otherwise the best coverage of an accepted notice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import cut

#: Phrases of the contract, each with its label.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public licence notices as (label, words, mandatory key phrases).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["hereby granted free", "obtaining", "associated documentation files"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included", "substantial portions"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["file except in compliance", "apache org licenses"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ("gpl-2", "it under the terms of the gnu general public license version 2 as published by the free software foundation", ["gnu general public license version 2", "free software foundation"]),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu lesser general public license", "version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "version 3"]),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["granted to copy distribute", "gnu free documentation license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["source code form", "mozilla public license v 2"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", ["mozilla public license version 1 1"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["accompanying materials", "eclipse public license 2"]),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ["accompanying materials", "eclipse public license v1"]),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", ["common development", "distribution license"]),
    ("eupl-1.2", "licensed under the eupl version 1 2", ["eupl version 1 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution", "binary forms", "modification", "permitted provided", "conditions are met"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution", "source", "binary forms", "conditions"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions", "binary form must reproduce", "materials provided"]),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["names of its contributors", "endorse or promote products", "prior written permission"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["copy modify", "fee", "hereby granted provided", "permission notice appear"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["copy modify", "fee", "hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["express or implied warranty", "authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["origin", "misrepresented", "wrote the original software"]),
    ("boost-1", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["hereby granted free", "organization obtaining", "accompanying documentation covered"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released", "public domain"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["copy modify publish", "compile sell", "compiled binary"]),
    ("wtfpl", "do what the fuck you want to public license", ["fuck", "public license"]),
    ("artistic-2", "licensed under the artistic license 2 0", ["artistic license 2"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["font software", "sil open font license"]),
    ("ncsa", "university of illinois ncsa open source license", ["illinois ncsa open source license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["copy modify", "documentation", "fee", "written agreement", "hereby granted"]),
    ("psf-2", "python software foundation license version 2", ["python software foundation license version 2"]),
    ("ms-pl", "this source code is subject to the microsoft public license", ["microsoft public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc", "nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4"]),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license", ["creative commons attribution noncommercial noderivatives"]),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["licensed", "cc", "sa"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed", "cc", "4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0"]),
    ("cc0", "has waived all copyright and related or neighboring rights", ["waived", "neighboring rights"]),
    ("gpl-2", "as published by the free software foundation version 2 of the license", ["published", "free software foundation version 2 of the license"]),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("lgpl-2", "gnu library general public license version 2", ["gnu library general public license version 2"]),
]

#: Identifiers of the SPDX list, as words, by label; those of "only" and "or later" begin alike.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl-2.1": "lgpl 2 1", "lgpl-3": "lgpl 3 0", "agpl-3": "agpl 3 0", "mpl-2": "mpl 2 0", "mpl-1.1": "mpl 1 1",
    "epl-1": "epl 1 0", "epl-2": "epl 2 0", "cddl-1": "cddl 1 0", "eupl-1.2": "eupl 1 2", "bsd": "bsd 2 clause", "bsd-3": "bsd 3 clause", "isc": "isc", "zlib": "zlib", "boost-1": "bsl 1 0", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "artistic-2": "artistic 2 0", "ofl-1.1": "ofl 1 1", "cc-by": "cc by 4 0", "cc-by-sa": "cc by sa 4 0", "cc-by-nd": "cc by nd 4 0", "cc-by-nc": "cc by nc 4 0", "cc0": "cc0 1 0",
}
NOTICES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in SPDX.items()]

#: Words of the notices that say nothing about a licence.
STOP_WORDS = "a all and any are as at be by can do for from has if in into is it its made may met must no nor not of or person that the this to under use used want was what will with without work you your either following".split()

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _rare(words: list[str]) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]


def _mandatory(words: list[str], phrases: list[str]) -> list[tuple[int, str]]:
    places: set[int] = set()
    for phrase in phrases:
        parts = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
        places.update(i for i in range(at, at + len(parts)) if words[i] not in STOP_WORDS)
    if not places:
        raise ValueError("a notice needs a mandatory phrase that isn't stop words only")
    return [(i, words[i]) for i in sorted(places)]


def notice_rows(notices=NOTICES) -> list[tuple]:
    """(label, licence words with their places, mandatory words with their places)."""
    return [(label, _rare(text.split()), _mandatory(text.split(), phrases)) for label, text, phrases in notices]


def vocabulary(notices=NOTICES) -> list[str]:
    """The licence words, by number."""
    return sorted({w for _, rare, _ in notice_rows(notices) for _, w in rare})


def _lower(words: Column, at: Column) -> Column:
    return F.lower(F.element_at(words, at))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Places (from 0) at which all words of the phrase follow each other; its rarest word leads there."""
    parts = phrase.split()
    lead = next(w for w in ("mit", "apache", "nc") if w in parts)
    back = parts.index(lead)
    candidates = F.transform(F.filter("leads", lambda i: _lower(words, i) == lead), lambda i: i - 1 - back)
    inside = F.filter(candidates, lambda p: (p >= 0) & (p + len(parts) <= F.size(words)))

    def stands(p: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(parts):
            out = out & F.coalesce(_lower(words, p + k + 1) == w, F.lit(False))
        return out

    return F.filter(inside, stands)


def licence_words(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, base places and labels, and all licence words (arrays pos and word); a row for each document."""
    known = vocabulary(notices)
    number = F.create_map(*(F.lit(x) for k, w in enumerate(known) for x in (w, k)))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SEPARATORS), lambda w: w != "").alias("words"))
    words = F.col("words")
    indexes = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))

    def one_of(i: Column, wanted: list[str]) -> Column:
        word = F.element_at(words, i)
        return F.lower(word).isin(*wanted) & (F.octet_length(word) == F.length(word))

    found = split.withColumn("at", F.filter(indexes, lambda i: one_of(i, sorted({*known, "mit", "apache", "nc"}))))
    found = found.withColumn("leads", F.filter("at", lambda i: one_of(i, ["mit", "apache", "nc"]))).withColumn("at", F.filter("at", lambda i: one_of(i, known)))
    named = found.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.transform("at", lambda i: i - 1).alias("pos"),
        F.transform("at", lambda i: F.element_at(number, _lower(words, i)).cast("short")).alias("word"),
        *(_phrase_places(words, p).alias(f"p{k}") for k, p in enumerate(BASE_PHRASES)),
    )
    places = F.flatten(F.array(*(f"p{k}" for k in range(len(BASE_PHRASES)))))
    labels = F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(BASE_PHRASES.values()))), lambda x: x.isNotNull())
    return named.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        "pos",
        "word",
    )


def idf(found: DataFrame, n_words: int) -> list[float]:
    """The IDF of each licence word (by number) over all files; as many entries as the library has words."""
    n = found.count()
    counts = {r["word"]: r["count"] for r in found.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").count().collect()}
    return [math.log((n + 1) / (counts.get(k, 0) + 1)) + 1e-3 for k in range(n_words)]


def postings(notices, weight: list[float]) -> dict[int, list[tuple]]:
    """By key word: (label, words before and after it, mandatory and licence words by their distance from it, with weights)."""
    number = {w: k for k, w in enumerate(vocabulary(notices))}
    out: dict[int, list[tuple]] = {}
    for label, rare, must in notice_rows(notices):
        place, key = max(must, key=lambda p: (weight[number[p[1]]], -p[0]))
        out.setdefault(number[key], []).append((label, place, rare[-1][0] - place, [(i - place, number[w]) for i, w in must], [(i - place, number[w], weight[number[w]]) for i, w in rare]))
    return out


def _postings_map(index: dict[int, list[tuple]]) -> Column:
    """The postings as a constant of the plan."""
    words = lambda ps: "array(" + ", ".join(f"named_struct('off', {p[0]}, 'word', {p[1]}S" + (f", 'weight', {p[2]!r}D" if len(p) > 2 else "") + ")" for p in ps) + ")"
    one = lambda label, before, after, must, rare: f"named_struct('label', '{label}', 'before', {before}, 'after', {after}, 'must', {words(must)}, 'rare', {words(rare)}, 'total', {sum(w for _, _, w in rare)!r}D)"
    return F.expr("map(" + ", ".join(f"{k}S, array({', '.join(one(*e) for e in entries)})" for k, entries in sorted(index.items())) + ")")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = cut(licence_words(docs, notices))
    index = postings(notices, idf(found, len(vocabulary(notices))))
    posted = _postings_map(index)
    pos, word = F.col("pos"), F.col("word")
    places = F.when(F.size(pos) > 0, F.sequence(F.lit(1), F.size(pos))).otherwise(F.array().cast("array<int>"))

    def accepted(i: Column) -> Column:
        """The notices that stand around licence word i."""

        def verified(p: Column) -> Column:
            first = F.greatest(F.lit(1), i - p["before"])
            near = F.struct(F.slice(pos, first, p["before"] + p["after"] + 1).alias("pos"), F.slice(word, first, p["before"] + p["after"] + 1).alias("word"))

            def told(n: Column) -> Column:
                def stands(w: Column) -> Column:
                    at = F.array_position(n["pos"], (F.element_at(pos, i) + w["off"]).cast("int"))
                    return (at > 0) & (F.element_at(n["word"], F.greatest(F.lit(1), at.cast("int"))) == w["word"])

                coverage = F.aggregate(p["rare"], F.lit(0.0), lambda s, w: s + F.when(stands(w), w["weight"]).otherwise(0.0)) / p["total"]
                return F.when(F.forall(p["must"], stands), F.struct(p["label"].alias("label"), F.least(F.lit(1.0), coverage).alias("coverage")))

            return _let(near, told)

        return F.filter(F.transform(F.element_at(posted, F.element_at(word, i)), verified), lambda x: x.isNotNull())

    keys = F.filter(places, lambda i: F.element_at(word, i).isin(*index)) if index else places
    own = F.flatten(F.transform(keys, accepted))
    scanned = found.withColumn("own", own if index else F.array().cast("array<struct<label:string,coverage:double>>"))
    labels = F.array_sort(F.array_union("base", F.transform("own", lambda x: x["label"])))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("own", lambda x: x["coverage"])), F.lit(0.0))).alias("score"),
    )
