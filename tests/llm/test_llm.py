"""Every operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm import bpe, langid, licenses, lines, lm, media, near, packing, sketches, substring
from tidepanel.llm.queries import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


def corpus() -> list[tuple]:
    draw = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdlmst" for b in "aeio" for c in ("n", "r", "ss", "é")]
    text = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    passage, line = text(70), text(12)
    rows = []
    for i in range(60):
        t = text(draw.choice([1, 3, 30, 120]))
        if i % 4 == 0:
            t += " " + passage
        if i % 5 == 0:
            t += f"\n  {line.upper() if i % 2 else line}\t\n" + text(9)
        if i % 9 == 0:
            t += "\nReleased under the MIT License, or the Apache License, Version 2.0."
        rows.append((i * 3, t, "xx" if i % 2 else "yy"))
    base = rows[7][1] + " " + text(100)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k):
            w[draw.randrange(len(w))] = draw.choice(vocab)
        rows.append((500 + k, " ".join(w), "xx"))
    rows += [(900, rows[3][1], "xx"), (901, "", "xx"), (902, None, None), (903, " \t\n ", "yy"), (904, "日本語 テキスト", "xx"), (905, "x" * 5000, "yy"), (906, text(30000), "yy"), (None, passage, "xx"), (907, "a\x00b 12!?", "xx")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, "clash", 1.0) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def texts() -> list[tuple[int | None, str]]:
    return [(r[0], r[1] or "") for r in corpus()]


def test_language_id(docs, empty):
    got = by_id(langid.identify(docs, langid.profiles(docs)))
    assert set(got) == {r[0] for r in corpus()}
    assert got[901]["lang_pred"] == got[902]["lang_pred"] == got[903]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9]["lang_pred"] == got[900]["lang_pred"]  # equal texts
    assert langid.identify(empty, langid.profiles(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.profiles(empty)).collect()} == {"und"}


def test_language_profile_is_the_plain_count(docs):
    want = Counter()
    for _, t, lang, *_ in corpus():
        if lang == "xx" and t:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                p = f" {w} "
                want.update(w)
                want.update(p[i : i + 2] for i in range(len(p) - 1))
                want.update(p[i : i + 3] for i in range(len(p) - 2))
    value = lambda g: sum((1 if c == " " else ord(c)) << (16 * k) for k, c in enumerate(reversed(g)))
    want = {value(g): n for g, n in want.items()}
    rows = [r for r in langid.profiles(docs).collect() if r["lang"] == "xx"]
    assert len(rows) == min(langid.PROFILE, len(want))
    assert [r["gram"] for r in sorted(rows, key=lambda r: r["place"])] == sorted(want, key=lambda g: (-want[g], g))[: langid.PROFILE]


def plain_language(text: str | None, profiles: dict[str, dict[int, int]]) -> tuple[str, float]:
    grams = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        p = f" {w} "
        grams.update(w)
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    value = lambda g: sum((1 if c == " " else ord(c)) << (16 * k) for k, c in enumerate(reversed(g)))
    mine = sorted(((-n, value(g)) for g, n in grams.items()))[: langid.PROFILE]
    if not mine or not profiles:
        return "und", 0.0
    away = {lang: sum(abs(k - places[g]) if g in places else langid.PROFILE for k, (_, g) in enumerate(mine)) for lang, places in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, max(0.0, 1 - away[best] / (len(mine) * langid.PROFILE))


@pytest.mark.parametrize("languages", [1000, 1])
def test_language_predictions_equal_brute_force(docs, monkeypatch, languages):
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    learned = langid.profiles(docs)
    profiles = defaultdict(dict)
    for r in learned.collect():
        profiles[r["lang"]][r["gram"]] = r["place"]
    got = by_id(langid.identify(docs, learned))
    for i, t in texts():
        lang, score = plain_language(t, profiles)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score), i


def test_language_accuracy_on_held_out_rows(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    d = spark.read.parquet(path)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = langid.identify(d.where(held), langid.profiles(d.where(~held))).join(d, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def plain_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in t.split("\n")}:
                if len(k) >= 40:
                    holders[k].append(i)
    out = {}
    for i, t in rows:
        parts = t.split("\n")
        kept = [x for x in parts if i is None or not (len(holders[key(x)]) >= 5 and max(holders[key(x)]) > i)]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.LineIndex.build(docs).clean(docs).collect()}
    assert got == plain_lines(texts())
    assert sum(v[1] for v in got.values()) > 0
    assert lines.LineIndex.build(empty).clean(empty).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_line_index_is_reversible(docs, monkeypatch, large):
    if large:  # filters too large to be sent, several copies and shards
        monkeypatch.setattr(lines, "FILTER_BYTES", 0)
        monkeypatch.setattr(lines, "PROBED_LINES", 7)
        monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    half = docs.where("doc_id % 2 = 0")
    rest = docs.where("doc_id % 2 = 1")
    index = lines.LineIndex.build(half)
    grown = index.insert(rest)
    whole = {r["doc_id"]: r["kept"] for r in grown.clean(docs).collect()}
    assert whole == {i: v[2] for i, v in plain_lines(texts()).items()}
    back = grown.delete(rest.select("doc_id"))
    assert set(map(tuple, back.counts.collect())) == set(map(tuple, index.counts.collect()))
    marks = lambda x: {r["shard"]: sorted(np.frombuffer(r["filter"], np.uint16)[np.frombuffer(r["filter"], np.uint16) > 0].tolist()) for r in x.filters.collect()}
    if not large:
        assert {k: v for k, v in marks(back).items() if v} == {k: v for k, v in marks(index).items() if v}
    assert {r["doc_id"]: r["kept"] for r in back.clean(half).collect()} == {i: v[2] for i, v in plain_lines([r for r in texts() if r[0] is not None and r[0] % 2 == 0]).items()}


def test_rows_that_repeat_a_doc_id_are_one_holder(spark):
    import duckdb

    from tidepanel.llm.sql import OP2

    two, five = "a line that only two documents hold, one of them in many rows", "a line that five documents hold, so it stays in the last one only"
    rows = [(1, two), *[(2, two)] * 4, *[(i, five) for i in range(3, 8)], (7, five)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[2] > 0 for r in db.execute(OP2).fetchall()}
    whole = lines.LineIndex.build(docs)
    assert {r["doc_id"]: r["n_dropped"] > 0 for r in whole.clean(docs).collect()} == want == {i: 3 <= i < 7 for i in range(1, 8)}
    grown = lines.LineIndex.build(docs.where("doc_id % 2 = 0")).insert(docs.where("doc_id % 2 = 1"))
    assert set(map(tuple, grown.counts.collect())) == set(map(tuple, whole.counts.collect()))


def test_cuckoo_filter_has_no_false_negatives():
    draw = np.random.default_rng(0)
    k1, k2 = (draw.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    f = lines._full(k1, k2)
    assert f.has(k1, k2).all()
    other = draw.integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert f.has(other, other[::-1]).mean() < 0.01
    f.delete(k1[:2500], k2[:2500])
    assert f.has(k1[2500:], k2[2500:]).all() and f.has(k1[:2500], k2[:2500]).mean() < 0.01


def test_license_scan(docs, empty):
    got = by_id(licenses.scan(docs))
    for i, t in texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, name) for phrase, name in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0])
        assert r["base_labels"] == sorted({name for _, name in at})
        assert set(r["base_labels"]) <= set(r["labels"])
    assert "apache-2.0" in got[0]["labels"]
    assert licenses.scan(empty).count() == 0
    assert len(licenses.rules()) > 200


def test_contained_detections_are_suppressed(spark):
    rows = [(1, "Licensed under the GNU Lesser General Public License, version 2.1"), (2, "the BSD license and the new BSD license")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["labels"] == ["gpl", "lgpl-2.1"]  # gpl is a base phrase and stays
    assert got[2]["labels"] == ["bsd", "bsd-3-clause"]


def test_the_gate_is_never_stricter_than_a_rule(spark):
    rows = [("Released under GPL 3.0", "gpl-3.0"), ("distributed under the Apache 2.0", "apache-2.0"), ("It is available under CC BY-SA 4.0.", "cc-by-sa-4.0"), ("published under BSD", "bsd"), ("provided under the terms of the ISC", "isc")]
    got = by_id(licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")))
    for i, (text, label) in enumerate(rows):
        assert label in got[i]["labels"] and got[i]["score"] == 0.95, text
    forms = re.search(r"\(\?:(licensed.*?)\) under", licenses.FORMS[1][0])[1].split("|")
    assert all(any(k in f"{verb} under" for k in licenses.gate()) for verb in forms)


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_USE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
BSD_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by X."
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
QUOTED = (
    ({"mit"}, f"{MIT_GRANT}, subject to the following conditions: The above copyright notice shall be included. {MIT_END}"),
    ({"mit"}, "Permission is hereby granted, free of charge, to the reader."),
    ({"mit"}, "THE SOFTWARE IS PROVIDED \u201cAS IS\u201d, take it."),
    ({"mit-0"}, f"{MIT_GRANT}. {MIT_END}"),
    ({"bsd"}, BSD_USE[:120]),
    ({"bsd-2-clause"}, f"{BSD_USE} {BSD_END}"),
    ({"bsd-3-clause"}, f"{BSD_USE} 3. {BSD_NAME} {BSD_END}"),
    ({"bsd-4-clause"}, f"{BSD_USE} {BSD_ADVERT} 4. {BSD_NAME} {BSD_END}"),
    ({"isc"}, f"{ISC_USE}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}."),
    ({"0bsd"}, f"{ISC_USE}. {ISC_END}."),
    ({"zlib"}, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. The origin of this software must not be misrepresented; you must not claim that you wrote it."),
    ({"unlicense"}, f"This is free and unencumbered software released into the public domain. Anyone is free to copy it. {MIT_END}"),
    ({"gpl-2.0", "gpl"}, GNU_NOTICE.format("General Public License", 2)),
    ({"gpl-3.0", "gpl"}, GNU_NOTICE.format("General Public License", 3)),
    ({"lgpl-2.1", "gpl"}, GNU_NOTICE.format("Lesser General Public License", 2.1)),
    ({"agpl-3.0", "gpl"}, GNU_NOTICE.format("Affero General Public License", 3)),
    ({"apache-2.0", "apache"}, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ({"mpl-2.0"}, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ({"epl-2.0"}, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ({"boost-1.0"}, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ({"cc-by-sa-4.0"}, "see https://creativecommons.org/licenses/by-sa/4.0/"),
    ({"gpl-3.0"}, "covered by GPLv3"),
    ({"lgpl-2.1"}, "covered by LGPLv2.1"),
    ({"agpl-3.0"}, "released under the AGPLv3"),
    ({"mpl-2.0"}, "licensed under MPLv2"),
    ({"mit"}, "It has the X11 license."),
    ({"ruby"}, "It has the Ruby license. Tests pass."),
    *(
        (set(), text)
        for text in (
            "The permission to use the garden was granted, and the software arrived without warranty papers.",
            "The driver license office is open. We run X11 on it.",
            "Buy ruby license plates here.",
            "The common public license fee rises; a driver's licence costs more.",
            "An Elastic license key and a PostgreSQL license holder are not needed.",
            "The vim licence holder moved. A license for fishing, hunting and for Apache helicopters.",
            "Enter the OpenSSL license number.",
            "He was licensed under the age of 18 in 2.0 states.",
            "The film was released under a new title in the public eye.",
            "This artistic licence fee was provided under protest.",
            "Our boost in software license revenues, and the mozilla in the public license office.",
        )
    ),
)


def test_license_texts_are_found_without_their_names(spark):
    got = by_id(licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(QUOTED)], "doc_id long, text string")))
    wrong = {text: got[i]["labels"] for i, (labels, text) in enumerate(QUOTED) if set(got[i]["labels"]) != labels}
    assert not wrong


def plain_labels(text: str) -> tuple[list[str], float]:
    """Labels and score by trying every rule and comparing all matches in pairs."""
    plain = re.sub(licenses.OTHER, " ", lower(text)).strip(" ")
    words = plain.split(" ")
    base = [name for phrase, name in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    hits = []
    for n, (label, priority, sure, _, _, regex) in enumerate(licenses.rules()):
        for m in re.finditer(regex, plain, re.ASCII):
            hits.append((plain[: m.start()].count(" "), plain[: m.end()].count(" "), priority, -n, label, sure))
    inside = lambda a, b: a is not b and b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[:2] != a[:2] or b[2:4] > a[2:4])
    kept = [a for a in hits if not any(inside(a, b) for b in hits)]
    return sorted({a[4] for a in kept} | set(base)), max([a[5] for a in kept], default=0.9 if base else 0.0)


def test_license_labels_equal_brute_force(spark):
    draw = random.Random(8)
    some = [t for _, t in QUOTED] + [f"SPDX-License-Identifier: {ident}" for _, _, ident, _ in licenses.LICENSES] + ["licensed under the MIT or GPL v3 license", "see the new BSD license"]
    rows = list(enumerate(some + [" and then ".join(draw.sample(some, 6)) for _ in range(40)]))
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        assert (got[i]["labels"], got[i]["score"]) == plain_labels(text), text
    for i, (label, _, ident, _) in enumerate(licenses.LICENSES):
        assert label in got[len(QUOTED) + i]["labels"], ident


def test_license_scan_of_long_texts(spark):
    rows = [(1, "mit license foo " * 130_000), (2, "license " * 250_000), (3, "x " * 1_000_000 + "Apache License, Version 2.0")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (130_000, 0, 3 * 129_999, ["mit"])
    assert (got[2]["n_words"], got[2]["labels"]) == (250_000, [])
    assert (got[3]["first_word"], got[3]["labels"]) == (1_000_000, ["apache", "apache-2.0"])


def test_packing(docs, empty):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = []
    for i, t in texts():
        ids = coder.encode(t, add_special_tokens=False).ids + [2]
        start = 0
        for k in range(-(-len(ids) // 1024)):
            n = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
            want.append((i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start += n
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, path).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    def fewest(sizes, cap):
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= cap and bins[b] not in bins[:b]:
                    go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return best[0]

    draw = random.Random(1)
    for _ in range(40):
        sizes = sorted((draw.randint(1, 20) for _ in range(10)), reverse=True)
        counts = [0] * 21
        for s in sizes:
            counts[s] += 1
        for steps in (packing.STEPS, None):
            made = packing.complete(counts, 20, steps)
            used = Counter()
            for times, pieces in made:
                assert sum(s * n for s, n in pieces.items()) <= 20
                for s, n in pieces.items():
                    used[s] += n * times
            assert used == Counter(sizes)
            assert sum(t for t, _ in made) == fewest(sizes, 20) >= packing.least_sequences(counts, 20)
    assert packing.complete([0] * 21, 20) == packing.complete([0] * 21, 20, None) == []


def test_bin_completion_finds_perfect_triples():
    draw = random.Random(4)
    for n in (5, 8, 12, 15):
        for _ in range(4):
            counts = [0] * 1025
            for _ in range(n):
                a = draw.randint(256, 500)
                b = draw.randint(256, min(500, 824 - a))
                for x in (a, b, 1024 - a - b):
                    counts[x] += 1
            assert sum(t for t, _ in packing.complete(counts)) == n < sum(t for t, _ in packing.best_fit(counts))


def test_undominated_fillings_are_those_without_a_better_exchange():
    counts = [0, 0, 2, 1, 1, 1]
    found = {tuple(items) for _, items in packing.fillings(counts, 5, 5, None, packing._Steps(10**6))}
    assert found == {((5, 1),)}  # 3 + 2 could be exchanged for 5, 4 alone for 5, 2 + 2 for 4


def test_byte_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    own, coder = packing.ByteTokenizer(path), Tokenizer.from_file(path)
    draw = random.Random(2)
    for t in ["".join(draw.choice("ab  e'st.\n\t10éÉ中😀\x85\xa0") for _ in range(draw.randint(0, 30))) for _ in range(600)] + ["a <|endoftext|> b"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids
    for t in ["x" + " " * 5_000_000 + "y", "^" * 1_000_000, "\n" * 60_000 + "z"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids


def test_media_round_trip(docs, empty):
    got = by_id(media.decode(media.encode(docs)))
    for i, t in texts():
        raw = t.encode()
        assert bytes(got[i]["payload"]) == raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert got[i]["n_bytes"] == len(raw) and len(got[i]["phash"]) == 8
    assert got[9]["png"] == got[900]["png"]
    assert media.decode(media.encode(empty)).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter_is_undone(kind):
    draw = np.random.default_rng(kind)
    rows = draw.integers(0, 256, (5, 12), dtype=np.uint8)
    body = np.zeros((5, 13), np.uint8)
    body[:, 0] = kind
    zero = np.zeros(12, int)
    for y in range(5):
        for x in range(12):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            near_ = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            body[y, x + 1] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, near_][kind]) % 256
    assert zero.sum() == 0 and (media._unfilter(body, 3) == rows).all()


def test_damaged_image_raises():
    png = bytearray(media.to_png(b"x" * 192))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_damaged_images_leave_the_others_alone(spark):
    good = media.to_png(b"abc".ljust(192))
    cut = [good[:k] for k in (0, 5, 9, 20, 40, len(good) - 6)] + [good[:-16] + good[-12:], b"x" * 300, None]
    rows = spark.createDataFrame([(0, 3, good)] + [(k, 3, bytearray(x) if x is not None else None) for k, x in enumerate(cut, 1)], "doc_id long, n_bytes long, png binary")
    got = by_id(media.decode(rows))
    assert got[0]["payload"] == b"abc".ljust(192) and got[0]["damage"] is None
    assert all(got[k]["payload"] is None and got[k]["phash"] is None and got[k]["damage"] for k in range(1, len(cut) + 1))


def test_media_features_equal_a_plain_transform(spark):
    text = " ".join(str(k * k) for k in range(3000))
    r = media.decode(media.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    grey = np.frombuffer(bytes(r["payload"]), np.uint8).reshape(-1, 32, 6).mean(2)
    n = len(grey)
    grid = [[np.mean([grey[y][x] for y in range(i * n // 32, (i + 1) * n // 32)]) for x in range(32)] for i in range(32)]
    low = [[sum(grid[y][x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = [0.0, *[x for row in low for x in row][1:]]
    bits = [x > np.median(flat) for x in flat]
    assert bytes(r["phash"]) == np.packbits(bits).tobytes()


def shingle_set(text: str, size: int) -> frozenset:
    w = WORDS.findall(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def spark_hash(*values) -> int:
    """Spark's xxhash64 of texts and numbers, as an unsigned number."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), h)
    return h


def plain_sketch(text: str) -> list[int]:
    h = [spark_hash(w) for w in WORDS.findall(text)]
    found = {spark_hash(*h[k : k + 5]) for k in range(max(1, len(h) - 4))} if h else set()
    return sorted(x - (x >> 63 << 64) for x in found)[:128]


@pytest.mark.parametrize(("fan", "size"), [(1, 2000), (2, 2000), (3, 20_000), (5, 2000), (32, 20_000)])
def test_sketches(docs, empty, monkeypatch, fan, size):
    monkeypatch.setattr(sketches, "RANGE_BYTES", size)
    monkeypatch.setattr(sketches, "FAN", fan)
    got = by_id(sketches.compared(docs).withColumns({"e": sketches.resemblance(F.col("sketch"), F.col("edited_sketch")), "n": sketches.resemblance(F.col("sketch"), F.col("next_sketch"))}))
    order = sorted(((i, t) for i, t in texts() if i is not None), reverse=True) + [(i, t) for i, t in texts() if i is None]

    def share(a, b):
        union = sorted(set(a) | set(b))[:128]
        return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0

    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, nxt = map(plain_sketch, (t, edited, after))
        assert (got[i]["sketch"], got[i]["edited_sketch"]) == (own, other)
        assert (got[i]["e"], got[i]["n"]) == (share(own, other), share(own, nxt))
    assert got[9]["sketch"] == got[900]["sketch"]
    assert sketches.compared(empty).count() == 0


def test_ranges_follow_the_size_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_BYTES", 2000)
    monkeypatch.setattr(sketches, "FAN", 3)  # nine borders in the plan, the others in a table
    rows = spark.createDataFrame([(k * 7, f"{k} " * 40) for k in range(4000)], "doc_id long, text string").repartition(4)
    got = sketches.with_next(rows)[0].where("not extra").select("doc_id", "next_text", "part").collect()
    sizes = Counter(r["part"] for r in got)
    assert len(sizes) > 180 and max(sizes.values()) < 4 * len(got) / len(sizes)
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(got, key=lambda r: (r["part"], r["doc_id"]))
    assert all(r["next_text"] == f"{(r['doc_id'] // 7 - 1) % 4000} " * 40 for r in got)


def test_rows_without_a_doc_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_BYTES", 500)
    rows = spark.createDataFrame([(None, f"text {k} " * 9) for k in range(60)] + [(1, "one")], "doc_id long, text string")
    got = sketches.with_next(rows)[0].where("not extra").select("doc_id", "text", "next_text", "part").collect()
    assert len({r["part"] for r in got}) > 5
    after = {r["text"]: r["next_text"] for r in got}
    walk, at = [], "one"
    while at not in walk:
        walk.append(at)
        at = after[at]
    assert len(walk) == 61  # one ring through all


def test_sketches_merge_and_estimate(spark):
    a, b = list(range(0, 6000)), list(range(3000, 9000))
    rows = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(*(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"))
    rows = rows.select(sketches.bottom(F.col("a")).alias("a"), sketches.bottom(F.col("b")).alias("b"), sketches.bottom(F.concat("a", "b")).alias("ab"))
    r = rows.select(sketches.merged(F.col("a"), F.col("b")).alias("m"), "ab", sketches.resemblance(F.col("a"), F.col("b")).alias("j"), sketches.containment(F.col("a"), F.col("b")).alias("c"), sketches.distinct(F.col("a")).alias("n")).first()
    assert r["m"] == r["ab"]
    assert abs(r["j"] - 1 / 3) < 0.12 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 6000) < 1500


def linked(rows, size: int, percent: int) -> dict:
    sets = {i: shingle_set(lower(t), size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids} | {None: None}


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups(docs, empty, size):
    got = {r["doc_id"]: r["component_id"] for r in near.groups(docs, size, 80).collect()}
    assert got == linked(texts(), size, 80)
    assert near.groups(empty, size, 80).count() == 0


def test_near_groups_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    draw = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    base = [draw.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(draw.choice([1, 3, 4, 5, 6, 7])):
            w[draw.randrange(len(w))] = draw.choice(vocab)
        rows.append((i, " ".join(w)))
    rows.append(rows[0])
    got = {r["doc_id"]: r["component_id"] for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    want = linked(rows, 4, 80)
    assert got == {i: c for i, c in want.items() if i is not None}
    assert 1 < len(set(got.values())) < 90


def test_rows_of_one_doc_id_with_different_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, a + " else"), (4, "on its own")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {(1, 37): 1, (2, 38): 1, (3, 38): 1, (5, 38): 1, (4, 1): 4}


def thue_morse(letters: int) -> tuple[str, str]:
    """A word and its complement, whose polynomials modulo 2**64 agree at every odd base."""
    bits = [bin(k).count("1") & 1 for k in range(letters)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_of_like_structure_are_told_apart(spark):
    from tidepanel.llm.chunks import Words, windows

    x, y = thue_morse(4096)
    h = Words(pa.array([f"{x} {y}"]), True).hashes()
    assert h[0] != h[1]
    bits = np.array([bin(k).count("1") & 1 for k in range(64)])
    u, v = np.where(bits, h[0], h[1]), np.where(bits, h[1], h[0])
    assert windows(u, 64)[0] != windows(v, 64)[0]
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*words, x])), (2, " ".join([*words[10:], y, *words[:9]])), (3, " ".join([x] + [f"z{k}" for k in range(8)])), (4, " ".join([y] + [f"z{k}" for k in range(8)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(docs).collect()} == {1: 0, 2: 50, 3: 0, 4: 0}
    want = linked(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in near.groups(docs, 4, 80).collect()} == {i: c for i, c in want.items() if i is not None}


def test_hot_buckets_are_split_without_losing_a_pair(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    draw = np.random.default_rng(8)
    n, width = 600, near.BANDS * near.ROWS
    minima = draw.integers(0, 1 << 32, (n, width), dtype=np.uint32)
    minima[:, : width // 2] = minima[0, : width // 2]  # what a passage of all documents gives
    for i in range(0, 60, 2):  # pairs around the least number of equal values
        minima[i + 1] = minima[i]
        changed = draw.permutation(width)[: 20 + i]
        minima[i + 1, changed] = draw.integers(0, 1 << 32, len(changed), dtype=np.uint32)
    classes = spark.createDataFrame([(i, bytearray(m.tobytes())) for i, m in enumerate(minima)], "rep long, minima binary")
    rows = spark.createDataFrame([(7, i, i) for i in range(n)] + [(9, i, i) for i in range(5)], "key long, rep long, comp long")
    got, sizes = near._narrowed(rows, "key", classes, 0.8)
    holds = defaultdict(set)
    for r in got.collect():
        holds[r["key"]].add(r["rep"])
    assert holds.pop(9) == set(range(5)) and 7 not in holds
    least = near.least_matches(0.8)[-1]
    equal = np.array([(minima == m).sum(1) for m in minima])
    need = {(i, j) for i, j in np.argwhere(equal >= least).tolist() if i < j}
    assert 5 < len(need) < 30
    assert all(any({i, j} <= h for h in holds.values()) for i, j in need)
    assert set.union(*holds.values()) <= set(range(60)) and max(len(h) for h in holds.values()) == 2  # the passage brings nobody together
    assert {r["key"] for r in sizes.collect()} - {9} <= set(holds)


def test_near_groups_of_documents_that_share_a_passage(spark, monkeypatch):
    draw = random.Random(12)
    vocab = [f"w{k}" for k in range(5000)]
    passage = [draw.choice(vocab) for _ in range(66)]
    rows = [(i, " ".join(passage + [draw.choice(vocab) for _ in range(54)])) for i in range(150)]
    for i in range(30):  # copies with a few words changed, at both sides of the threshold
        w = rows[i][1].split()
        for _ in range(1 + i % 6):
            w[draw.randrange(len(w))] = draw.choice(vocab)
        rows.append((150 + i, " ".join(w)))
    split = []
    narrowed = near._narrowed

    def seen(rows, key, classes, similar):
        out = narrowed(rows, key, classes, similar)
        split.append(out[0] is not rows)
        return out

    monkeypatch.setattr(near, "_narrowed", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, c in linked(rows, 4, 80).items() if i is not None}
    for block in (4, 512):
        monkeypatch.setattr(near, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near.groups(docs, 4, 80).collect()} == want
        assert split[0] == (block == 4)
        split.clear()


def test_a_large_component_meets_only_strangers(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = spark.createDataFrame([(1, i, 0 if i < 100 else i) for i in range(110)], "key long, rep long, comp long")
    laid = near._blocks(rows, "key").collect()
    assert len(laid) <= 100 * 2 + 10 * (2 + 13)
    met = set()
    groups = defaultdict(list)
    for r in laid:
        groups[r["p"], r["q"]].append(r)
    for (p, q), g in groups.items():
        met |= {(min(a["rep"], b["rep"]), max(a["rep"], b["rep"])) for a in g for b in g if a["comp"] != b["comp"] and (a["mine"] != b["mine"] or p == q)}
    assert met == {(i, j) for j in range(100, 110) for i in range(j)}


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    got = by_id(bpe.encode_decode(docs, path))
    for i, t in texts():
        ids = coder.encode(t, add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes()
        assert got[i]["decoded"] == coder.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path).count() == 0
    own = bpe.WordTokenizer(path)
    draw = random.Random(1)
    for t in ["".join(draw.choice("aaabbett hin\n'\"!.01éÉßİΣς\x1c\x85　中文😀") for _ in range(draw.randint(0, 40))) for _ in range(1000)] + ["a" * k for k in range(30)] + ["x<|endoftext|>Y"]:
        ids = coder.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (np.array(ids, "<u4").tobytes(), coder.decode(ids, skip_special_tokens=False))


def test_substring_dedup(docs, empty):
    for layout in (False, True):
        got = by_id(substring.without_repeats(docs.select("doc_id", "text"), layout=layout))
        first: dict = {}
        for i, t in sorted((r for r in texts() if r[0] is not None)):
            w = WORDS.findall(t)
            for k in range(len(w) - 49):
                first.setdefault(tuple(w[k : k + 50]), i)
        total = 0
        for i, t in texts():
            w = WORDS.findall(t)
            gone = [False] * len(w)
            for k in range(len(w) - 49):
                if i is not None and first.get(tuple(w[k : k + 50]), i) < i:
                    gone[k : k + 50] = [True] * 50
            kept = [x for x, g in zip(w, gone, strict=True) if not g]
            assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
            assert (WORDS.findall(got[i]["kept"]) if layout else got[i]["kept"]) == (kept if layout else " ".join(kept))
            total += sum(gone)
        assert total > 500
    assert substring.without_repeats(empty.select("doc_id", "text")).count() == 0


def test_windows_around_a_shared_passage_are_dealt_evenly(spark, monkeypatch):
    draw = random.Random(11)
    text = lambda n: " ".join(str(draw.randrange(10**6)) for _ in range(n))
    passage = text(120)
    rows = [(i, f"{text(60)} {passage} {text(60)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    loads = Counter()
    for r in substring.sent(docs, 50, 64).where("not known").collect():
        loads[r["bucket"]] += len(r["hashes"]) // substring.VALUE.itemsize
    assert max(loads.values()) < 1.5 * sum(loads.values()) / 64
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 14)  # many buckets and groups of documents
    found = substring.repeated(docs).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 400))  # one row a document
    assert {sum(map(len, r["hashes"])) // substring.VALUE.itemsize for r in found} == {71}
    got = substring.without_repeats(docs).collect()
    assert {(r["doc_id"] > 0, r["n_words"], r["n_removed"]) for r in got} == {(False, 240, 0), (True, 240, 120)}


@pytest.mark.parametrize("hold", [1 << 18, 20])
def test_a_passage_of_all_documents_is_sent_once_a_task(spark, monkeypatch, hold):
    monkeypatch.setattr(substring, "HOLD", hold)
    monkeypatch.setattr(substring, "MERGE_BYTES", 3000)  # a few documents a chunk
    draw = random.Random(12)
    text = lambda n: " ".join(str(draw.randrange(10**6)) for _ in range(n))
    passages = [text(70), text(55), text(50)]
    rows = [(draw.randrange(200), f"{text(20)} {passages[0]} {text(20)} {passages[1 + (i % 7 > 0)] if i % 3 == 0 else text(9)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = Counter()
    for r in substring.sent(docs, 50, 8).where("not known").collect():
        counts.update(np.frombuffer(r["hashes"], substring.VALUE).tolist())
    if hold > 20:  # once when it is first met (not yet known to come again), once at the end of a task
        assert max(counts.values()) <= 8
    holders = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    want = {i: 0 for i, _ in rows}
    for found in holders.values():
        for i in found - {min(found)}:
            want[i] += 1
    got = {r["doc_id"]: len(set(np.frombuffer(b"".join(r["hashes"]), substring.VALUE).tolist())) for r in substring.repeated(docs).collect()}
    assert got == {i: n for i, n in want.items() if n}


def plain_log10(classes: list[int], model) -> float:
    """Sum of log10 probabilities of a text's classes, token by token."""
    out = 0.0
    for i, c in enumerate(classes):
        r = np.zeros(lm.SIZE)
        for k in range(1, lm.CONTEXT + 1):
            r += model.weights[k - 1] * model.context[classes[i - k] if i >= k else model.m]
        near_ = classes[max(0, i - lm.WINDOW) : i]
        for x in near_:
            r += model.topic[x] / np.sqrt(len(near_) * lm.WINDOW)
        s = model.target.astype(float) @ r + model.bias
        out += (s[c] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
    return out


def test_lm_scores(docs, empty, monkeypatch):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False))
    monkeypatch.setattr(lm, "SHORT", 20)
    fitted, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda encoded, classes, total: fitted.append((classes, fit(encoded, classes, total))) or fitted[-1][1])
    got = by_id(lm.scores(docs, train))
    own = {i: [*WORDS.findall(lower(t)), None] for i, t in texts()}
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, ws in own.items() if learns(i) for w in ws)
    n, v = sum(c.values()), len(c)
    ending = lambda w: 0 if w is None else (w.encode()[-1] * 31 + (w.encode()[-2] * 7 if len(w.encode()) > 1 else 0)) % lm.ENDINGS
    model = lm.LogBilinear(*fitted[0])
    code = {w: int(lm.Words(pa.array([w]), False).hashes().view(np.int64)[0]) for w in {w for ws in own.values() for w in ws} if w is not None} | {None: int(lm.END)}
    short = {h: k for k, h in enumerate(fitted[0][0].short.tolist())}
    rest = [w for w in c if code[w] not in short]
    mass = Counter(ending(w) for w in rest) + Counter()
    share = {e: sum(c[w] for w in rest if ending(w) == e) + mass[e] + 1 for e in range(lm.ENDINGS)}
    for i, ws in own.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        if len(ws) < 1000:
            classes = [short.get(code[w], len(short) + ending(w)) for w in ws]
            inside = sum(np.log10((c[w] + 1) / share[ending(w)]) for w in ws if code[w] not in short)
            assert r["score"] == pytest.approx(plain_log10(classes, model) + inside, rel=1e-4)
    assert lm.scores(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_lm_beats_the_unigrams_on_held_out_texts_at_any_partitioning(spark, parts):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    from tidepanel.llm.queries import remainder

    docs = spark.read.parquet(path).repartition(parts)
    held = lm.scores(docs, F.coalesce(remainder(7) != 2, F.lit(False))).where(remainder(7) == 2)
    tokens, base, score = held.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert score / tokens > base / tokens + 0.1
    SCORES.append(score)
    assert SCORES[0] == pytest.approx(score, rel=1e-9)


SCORES: list[float] = []


def test_the_end_is_known_in_tables_of_few_long_texts(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(draw.choice(words) for _ in range(9000))) for k in range(3)] + [(9, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {i: (r["base_score"], r["score"]) for i, r in by_id(lm.scores(docs, F.col("doc_id") < 9)).items()}
    monkeypatch.setattr(lm, "FREQUENT", 600)  # the end is rarer than all of these
    got = {i: (r["base_score"], r["score"]) for i, r in by_id(lm.scores(docs, F.col("doc_id") < 9)).items()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_lm_probabilities_sum_to_one():
    classes = lm.Classes([(5, 0, 10), (6, 1, 4), (int(lm.END), 0, 3)], 17, 3, {0: (2, 13), 1: (1, 4)})
    model = lm.LogBilinear(classes)
    for before in ([], [0, 1], [2] * 100):
        p = [np.exp(model.log_probability(np.array([*before, k]), np.zeros(len(before) + 1, np.int64))[-1]) for k in range(classes.size)]
        assert sum(p) == pytest.approx(1, abs=1e-4)


def test_lm_runs_do_not_depend_on_how_texts_arrive(monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 3)
    draw = np.random.default_rng(1)
    texts_ = [(draw.integers(0, 9, n), k) for k, n in enumerate([1, 5, 40, 2, 2, 17, 1, 9])]
    runs = list(lm.blocks(texts_, 10))
    assert np.concatenate([c[f:] for c, _, f in runs]).tolist() == np.concatenate([c for c, _ in texts_]).tolist()
    assert np.concatenate([o[f:] for _, o, f in runs]).tolist() == [k for c, k in texts_ for _ in c]
    assert [len(c) - f for c, _, f in runs[:-1]] == [10] * (len(runs) - 1) and all(f == 3 for _, _, f in runs[1:])


def test_lm_gradient_is_that_of_the_objective(monkeypatch):
    """One step's gradient against differences of the NCE objective."""
    frequent = [(k, k % 4, 20 - k) for k in range(12)] + [(int(lm.END), 0, 3)]
    classes = lm.Classes(frequent, 200, 17, {e: (1 + sum(x[1] == e for x in frequent), 9 + sum(x[2] for x in frequent if x[1] == e)) for e in range(4)})
    draw = np.random.default_rng(5)
    own, owner = draw.integers(0, classes.size, 30), np.repeat([0, 1], [18, 12])
    start = lm.LogBilinear(classes).flat.astype(float)

    def objective(flat):
        model = lm.LogBilinear(classes, flat)
        guess = model.predicted(own, *model._before(own, owner))[4:].astype(float)
        noise = np.minimum(np.searchsorted(model.noise, np.random.default_rng(2).random(lm.NOISE)), model.m - 1)
        shift = model.bias - model.log_noise - np.log(lm.NOISE)
        real = (guess * model.target[own[4:]]).sum(1) + shift[own[4:]]
        false = guess @ model.target[noise].T + shift[noise]
        return -np.log1p(np.exp(-real)).sum() - np.log1p(np.exp(false)).sum()

    model = lm.LogBilinear(classes, start.copy())
    slopes = np.full_like(start, 1e12)  # so the step is a small multiple of the gradient
    model.train(own, owner, 4, np.random.default_rng(2), slopes)
    grad = (model.flat - start) * 1e6 / lm.RATE
    rows = [own[0], own[10], classes.size, classes.size + 1 + own[6], 2 * classes.size + 2 + own[20], 3 * classes.size + 2]
    for row in rows:
        for k in (0, 7):
            up, down = start.copy(), start.copy()
            up[row, k] += 1e-3
            down[row, k] -= 1e-3
            assert grad[row, k] == pytest.approx((objective(up) - objective(down)) / 2e-3, rel=0.02, abs=0.02), (row, k)


def test_pipeline_matches_plain_python(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in ((r[0], r[1], r[2]) for r in corpus()) if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    current = {r[0]: r[1] or "" for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    first = {r["doc_id"]: r["text"] for r in cp.language_id(spark, docs, "").collect()}
    current = {i: t for i, t in current.items() if i in first}
    assert first == current and set(first) >= {r[0] for r in rows if r[0] < 900}
    current = {i: v[2] for i, v in plain_lines(list(current.items())).items()}
    comp = linked(list(current.items()), 5, 80)
    current = {i: t for i, t in current.items() if comp[i] == i}
    got = cp.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == set(current)
    stage = docs
    for name, f in cp.STAGES[:-1]:
        stage = f(spark, stage, "")
        assert stage.columns == docs.columns, name


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    same = " ".join(f"word{k}" for k in range(70))
    rows = [(None, same), (None, None), (1, same), (1, same), (1, "another text of the same document"), (2, same + " and more"), (3, ""), (4, None), (5, "12 34"), (6, "x" * 300_000), (7, "a few letters")]
    kind = "doc_id long, text string, lang string, source string, n_chars int, kept string, rest string"
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), "clash", "clash") for i, t in rows], kind)
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = cp.run(spark, str(tmp_path / "odd")).collect()
    # no row has a language, so only texts without a letter go; of 1 and 2 only 1 stays
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == {None: 1, 1: 3, 6: 1, 7: 1}
    stage = docs
    for name, f in cp.STAGES[:-1]:
        stage = f(spark, stage, "")
        assert (stage.columns, [x.dataType for x in stage.schema]) == (docs.columns, [x.dataType for x in docs.schema]), name
        assert {r["kept"] for r in stage.collect()} == {"clash"}, name
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_sql_agrees_on_a_small_table(spark, tmp_path):
    import duckdb

    from tidepanel.llm import queries

    rows = [(r[0], r[1], r[2]) for r in corpus() if r[0] is not None and r[0] != 906 and "\x00" not in (r[1] or "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(r[1].split()[:20])) for k, r in enumerate(rows) if r[1] and k % 9 == 0], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name, text in queries.SQL.items():
        want = con.execute(text)
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(got.columns) == sorted(columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want.fetchall())), name
