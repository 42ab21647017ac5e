"""Operators that answer row by row: language id, licenses, HTML text, token counts, fingerprints."""

import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyscope.llm import fingerprints, html_text, language_id, licenses, queries, token_counts
from tests.llm.helpers import LOWER, corpus, frame

SF = "/root/testdata/sf0.001"
ODD = ["<|endoftext|> hi<|startoftext|>x", "it's DON'T ''s ΣΑΣ İ x\x85y \x1c 12345 ½", "aaaaaaa " * 50, "日本語 \U0001f600\U0001f600 é"]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (None, "null id")]
    got = token_counts.token_counts(frame(spark, rows), path, limit=20).collect()
    library = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in got)


def test_token_counts_bounded_table(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 5)
    pieces = token_counts.WordPieces(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for _, t in corpus()]
    assert [pieces.count([t])[0] for t in texts] == token_counts.WordPieces(public_tokenizers.path("word_bpe_49k.json")).count(texts)


def brute_base(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))
    at = []
    for phrase, label in licenses.BASE:
        p = phrase.encode().split()
        at += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


LICENSED = [
    "Released under the MIT License. The mit-LICENSE again, GNU General  Public\nLicense, version 3.",
    "Licensed under the Apache License, Version 2.0; permit licenses; mit licensed; smit license",
    "SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under CC BY-NC 4.0.", "general public", "license mit license",
]


def test_license_scan(spark):
    rows = corpus() + [(2000 + i, t) for i, t in enumerate(LICENSED)]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[2000]["labels"] == "gpl,gpl-3.0,mit"
    assert got[2001]["labels"] == "apache,apache-2.0"
    assert got[2002]["labels"] == "apache-2.0,mit"
    assert got[2003]["labels"] == "cc-by-nc"


WRAPPED = [
    "All rights\nreserved", "in the public\ndomain", "CC\nBY 4.0", "CC Attribution 4.0", "Creative\nCommons Attribution", "SIL Open\nFont License", "GNU General\nPublic License",
    "Permission is\nhereby granted, free of charge, to any person obtaining a copy of it without restriction", "this program is free\nsoftware; you can redistribute it and/or modify it",
    "Free\nDocumentation License", "Common\nPublic License 1.0", "European\nUnion Public Licence", "do what the f* you want\nto public license", "Redistribution and\nuse in source and binary forms, with or without modification",
    "Common\nDevelopment and Distribution License", "Permission to\nuse, copy, modify, and/or distribute this software for any purpose",
]


def test_license_gates_lose_no_wrapped_notice(monkeypatch):
    rules = licenses.rules()
    texts = [t.lower().encode() for t in WRAPPED + LICENSED] + [t.lower().replace("\n", " ").encode() for t in WRAPPED]
    gated = [licenses.scan(t, rules) for t in texts]
    monkeypatch.setattr(licenses, "GATES", (b"",))
    assert gated == [licenses.scan(t, [r._replace(gates=()) for r in rules]) for t in texts]
    assert all(gated[: len(WRAPPED)])


NOTICES = {
    "Apache-2.0": "apache-2.0", "License: MIT": "mit", "licence: MIT": "mit", "CC-BY-SA 4.0": "cc-by-sa", "CC-BY-4.0": "cc-by", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
    "LGPL-2.1-or-later": "lgpl-2.1", "GPL-3.0-only": "gpl-3.0", "AGPL-3.0+": "agpl-3.0", "Eclipse Public License - v 2.0": "epl-2.0", "Eclipse Public License \u2013 v 2.0": "epl-2.0",
    '{"license": "ISC"}': "isc", "license = 'BSD'": "bsd", "License :: OSI Approved :: zlib License": "zlib", "https://img.shields.io/badge/license-MIT-blue": "mit", "MPL-1.1": "mpl-1.1",
    "Neither the name of the University nor the names of its\ncontributors may be used to endorse or promote products": "bsd-3-clause",
    "You may not use this file except in compliance with the License.": "apache-2.0",
    "This software is provided 'as-is', without any express or implied\nwarranty.": "zlib",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl-2.1",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document": "wtfpl",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "Artistic-2.0": "artistic", "0BSD": "0bsd",
}
CLEAN = ["driving licence", "his license was lost", "the mit hall", "a boost of energy", "apache helicopters", "smit-2.0", "summit: license", "license to kill", "an isc", "mental health", "the gpls", "2.0 license", ""]


def test_license_notices_and_clean_texts(monkeypatch):
    rules = licenses.rules()
    for text, label in NOTICES.items():
        for t in (text, f"x {text} y", text.replace(" ", "\n")):
            low = t.encode().translate(LOWER)
            hits = licenses.scan(low, rules)
            assert label in {h.label for h in hits}, t
    assert not [t for t in CLEAN if licenses.scan(t.encode(), rules)]
    texts = [t.encode().translate(LOWER) for t in NOTICES]
    gated = [licenses.scan(t, rules) for t in texts]
    monkeypatch.setattr(licenses, "GATES", (b"",))
    assert gated == [licenses.scan(t, [r._replace(gates=()) for r in rules]) for t in texts]


def test_license_resolution_equals_all_pairs():
    rng = np.random.default_rng(5)
    stronger = lambda k, h: (k.priority, k.start - k.end, k.order) < (h.priority, h.start - h.end, h.order)
    for n in (0, 1, 2, 7, 60):
        for _ in range(40):
            hits = []
            for i in range(n):
                a = int(rng.integers(0, 30))
                hits.append(licenses.Hit(a, a + int(rng.integers(1, 12)), int(rng.integers(1, 5)), i, str(i), 0.5))
            want = {h for h in hits if not any(stronger(k, h) and k.start <= h.start and h.end <= k.end for k in hits)}
            got = licenses.resolve(hits)
            assert len(got) == len(want) and set(got) == want


def test_license_scan_long_text_null_id_empty_table(spark):
    long = "gpl-3.0 apache-2.0 " * 40_000
    began = time.time()
    rows = frame(spark, [(None, long), (None, None), (5, "License: MIT"), (5, "License: MIT")])
    got = licenses.license_scan(rows).collect()
    assert time.time() - began < 60
    assert sorted((r["doc_id"] or 0, r["labels"], len(r["detections"])) for r in got) == [(0, "", 0), (0, "apache-2.0,gpl-3.0", 80_000), (5, "mit", 1), (5, "mit", 1)]
    assert licenses.license_scan(rows.limit(0)).count() == 0


def test_license_rules_are_ordered_and_contained_hits_go():
    rules = licenses.rules()
    assert len(rules) > 200 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    hit = lambda a, b, p, label: licenses.Hit(a, b, p, 0, label, 0.5)
    assert [h.label for h in licenses.resolve([hit(3, 9, 4, "in"), hit(0, 10, 1, "out"), hit(8, 12, 4, "across")])] == ["out", "across"]


def test_language_id_accuracy_and_edges(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_small(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and runs away " * 5, "le renard brun saute par dessus le chien et part en courant vers la " * 5
    rows = [(i, (en if i % 2 else fr)[i:], "en" if i % 2 else "fr", 5) for i in range(20)] + [(50, None, "en", 0), (51, "12 34 ...", None, 0), (52, "", "fr", 0), (53, en * 200, None, 1), (None, fr, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(docs, "true").collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52, 53, None, 4)] == ["und", "und", "und", "en", "fr", "fr"]
    assert got[50]["score"] == 0.0 and isinstance(got[53]["score"], float)
    assert language_id.identify(docs.limit(0), "true").count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, "lang = 'none'").collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies on this site, please accept.</div>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><main><article><header><h1>A  real\n title</h1></header><p>First &amp; long paragraph of the article &lt;here&gt; with <a href=z>a link</a> in it.
<p>Second one<br>with a break &#233;.<div class="ad">Buy it now, great deals for you!</div><ul><li>point one of the list<li>point two</ul><script>var x = "<p>no</p>";</script>
<form><label>Email</label><input></form><!-- <p>no</p> --></article></main><aside><p>Related story that is long enough to look like text.</p></aside>
<section id="comments"><p>Nice article, thank you for writing this long piece.</p></section><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text"), (5, "x", "<p>" * 3000 + "<article><p>Deep text that is long enough, certainly so.")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = "A real title\nFirst & long paragraph of the article <here> with a link in it.\nSecond one with a break é.\npoint one of the list\npoint two"
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == "" and got[2]["url"] is None and got[3]["n_chars"] == 0
    assert got[5]["text"].startswith("Deep text")


def test_min_cut_is_a_minimum():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 7
        root = html_text.Element("div", None, "")
        homes = [html_text.Element("section", root, "") for _ in range(2)]
        blocks = [html_text.Block("x", html_text.Element("p", homes[int(rng.integers(0, 2))], ""), float(rng.normal())) for _ in range(n)]
        edges = []
        real = html_text.FlowNet.edge

        def spy(self, a, b, there, back=0.0):
            edges.append((a, b, there, back))
            real(self, a, b, there, back)

        html_text.FlowNet.edge = spy
        try:
            label = html_text.label_blocks(blocks)
        finally:
            html_text.FlowNet.edge = real
        if not edges:
            continue
        cut = lambda side: sum((t if side[a] and not side[b] else 0) + (k if side[b] and not side[a] else 0) for a, b, t, k in edges)
        best = min(cut([bool(m >> i & 1) for i in range(n)] + [True, False]) for m in range(2**n))
        assert cut([*label, True, False]) == pytest.approx(best)


def test_fingerprints_against_brute_force(spark):
    rows = [(i * 3 % 67 if i < 67 else i, t) for i, t in corpus()]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark, frame(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(t)
        changed = t[: n - n // 4] + after[: n // 4]
        a, b, c = (fingerprints.fingerprint_texts([x]) for x in (t, changed, after))
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert [r["fingerprint"]] == fingerprints.to_text(a) and [r["edited_fingerprint"]] == fingerprints.to_text(b)
        assert r["near_edited"] == fingerprints.likeness(a, b)[0] and r["near_next"] == fingerprints.likeness(a, c)[0]


def test_fingerprints_edges(spark):
    one = fingerprints.edited_fingerprints(spark, spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0]["n_chars"] == 8 and one[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    ties = fingerprints.edited_fingerprints(spark, frame(spark, [(1, "b" * 9), (1, "a" * 9), (None, None), (None, "x")]))
    assert ties.count() == 4
    assert fingerprints.fingerprints(frame(spark, [(1, "same text here"), (2, "same text here"), (3, None)])).select("fingerprint").distinct().count() == 2


def test_parse_is_locally_consistent():
    rng = np.random.default_rng(5)
    core = bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode()
    names = []
    for head in ("", "x" * 17, core[::-1][:301]):
        data = np.frombuffer((head + core).encode(), np.uint8)
        level, off = fingerprints.phrases(data, np.array([0, len(data)]))
        names.append(fingerprints.phrases(level, off)[0])
    inner = [set(x.tolist()) for x in names]
    assert len(inner[0] & inner[1]) > 0.97 * len(inner[0]) and len(inner[0] & inner[2]) > 0.97 * len(inner[0])


STORY = "<p>" + "The council met on Tuesday and decided to build a new bridge over the river, as the old one is closed. " * 3 + "</p>"
SHELLS = [
    "<article data-title='the hidden city'>{}</article>", "<div data-slug=hidden-gems>{}</div>", "<body class='has-sidebar'><article>{}</article></body>", "<div id='main' class='no-comments'>{}</div>",
    "<div class='post with-comments'><article>{}</article></div>", "<main class='post social-story'>{}</main>", "<body class='sidebar'><div>{}</div></body>", "<div class=social><h1>A title</h1>{}</div>",
    "<div title=\"a > b\" class=post>{}</div>", "<div data-x='<nav class=ad>'>{}</div>", "<div onclick=\"f('x')\">{}</div>",
]


@pytest.mark.parametrize("shell", SHELLS)
def test_names_do_not_lose_the_article(shell):
    page = "<html><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>" + shell.format(STORY * 4) + "<div class=sidebar><a href=1>More</a></div><footer>© 2020 Site</footer></body></html>"
    text = html_text.main_text(page)
    assert text.count("old one is closed.") == 12 and not any(x in text for x in ("Home", "News", "More", "©"))


def test_comments_and_notices_go():
    page = f"<article>{STORY}</article><section class='comments'><article class='comment'><p>" + "I think this is a very good idea, thank you for it. " * 3 + "</p></article></section><div class='cookie-notice'><p>We use cookies on this site, please accept all of them now.</p></div>"
    text = html_text.main_text(page)
    assert "council" in text and "good idea" not in text and "cookies" not in text


@pytest.mark.parametrize("page", [
    "<b" * 100_000, "<script" * 100_000, "<script>" * 100_000, '<a href="x' * 100_000, '<a x=">" ' * 100_000, "<!" * 200_000, "<!--" * 100_000, "<" * 1_000_000, "</" * 500_000,
    "<div>" * 10_000 + "<p>some text of it</p>" * 10_000, "<div>x" * 10_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<a " + '"' * 1_000_000, "<a " + "=" * 1_000_000,
    ("<p>" + "The council met on Tuesday and decided it. " * 5 + "</p><div class=ad><a href=x>buy now</a></div>") * 35_000])
def test_broken_deep_and_long_pages_take_linear_time(page):
    begin = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - begin < 10


def test_pages_repeated_rows_null_ids_and_empty(spark):
    pages = spark.createDataFrame([(None, None, STORY, 1), (None, None, STORY, 1), (2, "u", None, 2)], "page_id bigint, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len(got[0]["text"]) or len(got[1]["text"]), len(got[1]["text"]) or len(got[0]["text"])] and len(got) == 3
    assert html_text.extract(pages.limit(0)).count() == 0


def test_long_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, pieces = Tokenizer.from_file(path), token_counts.WordPieces(path)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzé"))
    for n, k in ((513, 26), (700, 1), (701, 2), (3000, 3), (5000, 27), (20_000, 26)):
        word = "".join(letters[rng.integers(0, k, n)])
        texts = [word, f"{word} and {word[:600]} x", "ab" * n, "é" * n, "!?" * n]
        assert pieces.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert all(len(t) <= token_counts.KEPT for t in pieces.table)
    begin = time.perf_counter()
    pieces.count(["".join(letters[rng.integers(0, 26, 1_000_000)])])
    assert time.perf_counter() - begin < 15
