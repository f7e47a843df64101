"""Embeddings, licenses, archives, chats, pages, the pipeline: brute force and odd rows."""

import base64
import gzip
import hashlib
import random
import re
import time
from html import unescape

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quizloom.llm import chat_format, language_id, license_scan, page_text, simhash_dedup, vector_dedup, warc_convert
from quizloom.llm.common import scratch_folder, stored
from tests.llm.conftest import SF


# ------------------------------------------------------------------ embeddings
def _brute_vectors(ids, x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in zip(*np.nonzero(near)):
        p, q = find(a), find(b)
        label[max(p, q)] = min(p, q)
    return near.sum(1), [ids[find(i)] for i in range(len(ids))]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 24))
    x = np.concatenate([c + rng.normal(size=(rng.integers(1, 30), 24)) * rng.choice([0.05, 0.15]) for c in centres])
    return np.concatenate([x, x[:40]])  # some exact copies


def test_forest_recall_against_brute_force(llm, clustered):
    x, ids = clustered, list(range(100, 100 + len(clustered)))
    n, component = _brute_vectors(ids, x)
    rows = llm.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = vector_dedup.vector_groups(rows, leaf=60).toPandas().sort_values("vec_id")
    assert got.n_links.sum() >= 0.97 * n.sum() and (got.n_links.values <= n).all()
    assert (got.component_id.values == np.array(component)).mean() >= 0.97
    assert (got.kept == (got.component_id == got.vec_id)).all()


def test_unsplittable_leaf_is_compared_in_blocks(llm):
    rows = llm.range(900).selectExpr("id vec_id", "array(1.0D + id, 2 * (1.0D + id)) embedding")
    got = vector_dedup.vector_groups(rows, leaf=40, trees=2).toPandas()
    assert set(got.n_links) == {899} and set(got.component_id) == {0}


def _dense_group(m, size=64, seed=5):
    """Unit vectors of which any two are at about 0.96."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=size)
    away = rng.normal(size=(m, size))
    return centre / np.linalg.norm(centre) + 0.195 * away / np.linalg.norm(away, axis=1, keepdims=True)


def test_dense_groups_keep_their_links(llm):
    rng = np.random.default_rng(6)
    x = np.concatenate([_dense_group(2000), rng.normal(size=(1500, 64))])
    ids = list(range(len(x)))
    n, component = _brute_vectors(ids, x)
    assert n.sum() > 3_000_000
    rows = llm.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = vector_dedup.vector_groups(rows).toPandas().sort_values("vec_id")
    assert got.n_links.sum() >= 0.97 * n.sum() and (got.n_links.values <= n).all()
    assert got.component_id.tolist() == component


def test_forest_is_the_same_by_either_way(llm, monkeypatch):
    """Splits sent to the vectors and vectors sent to their nodes find the same links."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, 16)) for c in centres]).astype(np.float32)
    ids = list(range(len(x)))
    n, component = _brute_vectors(ids, x.astype(float))
    rows = llm.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = []
    for few in (vector_dedup.FEW_NODES, 0):
        monkeypatch.setattr(vector_dedup, "FEW_NODES", few)
        got.append(vector_dedup.vector_groups(rows, leaf=60, trees=6).toPandas().sort_values("vec_id"))
    assert got[0].n_links.tolist() == got[1].n_links.tolist()
    assert got[0].component_id.tolist() == got[1].component_id.tolist()
    assert got[0].n_links.sum() >= 0.97 * n.sum() and (got[0].n_links.values <= n).all()
    assert (got[0].component_id.values == np.array(component)).mean() >= 0.97


def test_vectors_of_one_id_are_separate(llm):
    rows = llm.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02])],
                               "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links) for r in vector_dedup.vector_groups(rows).collect())
    assert got == [(1, 0), (1, 2), (2, 2), (3, 2)]


def test_vectors_odd_rows(llm):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []),
            (8, [1.0, 0.0]), (9, [1e300, 1e290]), (10, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (11, [1e-310, 0.0])]
    table = llm.createDataFrame([(i, v, "w", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, node int")
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_groups(table).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 4, 5, 6, 7, 10))
    assert {got[i][:2] for i in (2, 3, 8, 9, 11)} == {(5, 2)}
    assert got[None][0] == 0
    assert vector_dedup.vector_groups(table.limit(0)).collect() == []


def test_embedding_query(llm):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    n, component = _brute_vectors(e.vec_id.tolist(), np.stack(e.embedding).astype(float))
    got = vector_dedup.op1_embedding_dedup(llm, SF).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == n.tolist() and got.component_id.tolist() == component


# ------------------------------------------------------------------ licenses
def test_licenses_brute(llm):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = {r.doc_id: r.licenses for r in license_scan.op2_license_scan(llm, SF).collect()}
    assert set(got) == set(docs.index)
    for i, t in docs.items():
        for line, name in lines.items():
            assert (name in got[i].split(",")) == (line in t), (i, name)


@pytest.mark.parametrize("text,names", [
    ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
    ("licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
    ("Licensed under the Apache License, Version 1.1", []), ("a driving license is needed", []),
    ("LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0", ["Apache-2.0"]),
    ("Copyright Muster, mit freundlicher Erlaubnis", []), ("This file is GPL-2.0 licensed\nReleased under the MIT License", ["GPL-2.0", "MIT"]),
    ("x " * 50000 + "SPDX-License-Identifier: MIT", ["MIT"])])
def test_license_wordings(text, names):
    n, found = license_scan.Scanner(license_scan.TEMPLATES).scan(text)
    assert n >= 1 and [f["license"] for f in found] == names


@pytest.mark.parametrize("text,names", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
     "(the \"Software\"), to deal\nin the Software without restriction, including without limitation", ["MIT"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided "
     "that the above\ncopyright notice appear in all copies.", ["ISC"]),
    ("# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the "
     "License, or\n# (at your option) any later version.", ["GPL-2.0"]),
    (" * Neither the name of the copyright holder nor the names of its\n * contributors may be used to endorse or promote products derived "
     "from\n * this software without permission.", ["BSD-3-Clause"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", ["MPL-2.0"]),
    (" * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", ["MPL-2.0"]),
    ("Licensed under the Apache License, Version 2.0 or released under the MIT License", ["Apache-2.0", "MIT"]),
    ("GPL-2.0, GPL-3.0, LGPL-3.0, LGPL-2.1, AGPL-3.0, CC0 1.0 and ISC License",
     ["AGPL-3.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0"]),
    ("a copyright by MIT.\nLicense plates", []), ("copyright MIT\n\nLicense plates", [])])
def test_licenses_over_line_ends_and_all_of_a_block(text, names):
    _, found = license_scan.Scanner(license_scan.TEMPLATES).scan(text)
    assert sorted(f["license"] for f in found) == names


def test_license_odd_rows(llm, docs):
    rows = [(1, None, "en"), (2, "", "en"), (3, "no cue", None), (4, "Released under the MIT License", "en"),
            (4, "Released under the MIT License", "en"), (None, "license", "en")]
    out, name = license_scan.license_scan(docs(rows), out="tokens")
    assert name == "tokens_" and out.columns == docs(rows).columns + ["tokens_"]
    got = sorted((str(r.doc_id), r[name].n_blocks, [f.license for f in r[name].finds]) for r in out.collect())
    assert got == [("1", 0, []), ("2", 0, []), ("3", 0, []), ("4", 1, ["MIT"]), ("4", 1, ["MIT"]), ("None", 1, [])]
    assert license_scan.license_scan(docs(rows).limit(0))[0].collect() == []


# ------------------------------------------------------------------ archives
def test_warc_matches_sql(same):
    same(warc_convert.op7_warc_convert, warc_convert.OP7_SQL)


PAGES = [(1, "http://a b/", None), (None, None, "x" * 1200), (3, "", "x" * 1200), (3, "u", "x" * 1200), (9, "v", "x" * 1200),
         (4, "q", "WARC/1.0\r\n\r\n\n\nHTTP/1.0 é"), (5, "z", "\n"), (6, "z", "a\r\n\r\n"), (7, "z", "y" * 999), (8, "z", "y" * 999),
         (10, "long", "ab\n" * 400000)]


def _pages(llm):
    return llm.createDataFrame([(*p, "t") for p in PAGES], "page_id long, url string, html string, type string").repartition(3)


def test_archives_odd_rows(llm):
    arc, warc = scratch_folder(llm, "arc"), scratch_folder(llm, "warc")
    warc_convert.write_arc(_pages(llm), arc)
    assert warc_convert.arc_records(llm, arc).count() == len(PAGES)
    warc_convert.arc_to_warc(llm, arc, warc)
    rows = warc_convert.warc_records(llm, warc, payloads=True).collect()
    full = [(r.id, (r.payload or b"").decode()) for r in rows if r.type == "response"]
    same = [p for p in PAGES if p[2] == "x" * 1200]
    assert sorted(full, key=repr) == sorted([(i, h or "") for i, _, h in PAGES if (i, _, h) not in same] + [(9, "x" * 1200)], key=repr)
    target = next(r.record_id for r in rows if r.id == 9)
    again = [r for r in rows if r.type == "revisit"]
    assert len(again) == 3 and {r.refers_to for r in again} == {target} and {r.payload_bytes for r in again} == {1200}
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"x" * 1200).digest()).decode()
    assert {r.payload_digest for r in again} == {digest}
    empty = scratch_folder(llm, "arc"), scratch_folder(llm, "warc")
    warc_convert.write_arc(_pages(llm).limit(0), empty[0])
    warc_convert.arc_to_warc(llm, *empty)
    assert warc_convert.warc_records(llm, empty[1]).collect() == []


def test_legacy_arc_of_both_versions(llm, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n\xff\xfe\nraw"
    v1 = b"filedesc://a.arc 0.0.0.0 19970101 text/plain 12\n1 0 x\nabcdef\n"
    v1 += b"http://a.example/x y 1.2.3.4 19970203040506 text/html %d\n" % len(body) + body + b"\n\n"
    v1 += b"dns:a.example 1.2.3.4 1997 text/dns 3\nabc\n"
    v2 = b"filedesc://b.arc 0.0.0.0 19970101 text/plain 200 - - 0 b.arc 12\n2 0 x\nabcdef\n"
    v2 += b"http://b.example/ 1.2.3.4 19970203040506 text/html 200 - - 17 b.arc %d\n" % len(body) + body + b"\n"
    for name, data in (("a", v1), ("b", v2)):
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(data))
    rows = sorted(warc_convert.arc_records(llm, str(tmp_path)).collect(), key=lambda r: (r.path, r.ordinal))
    assert [(r.url, r.type, r.date, r.mime, r.payload_bytes) for r in rows] == [
        ("http://a.example/x y", "response", "1997-02-03T04:05:06Z", "text/html", 6),
        ("dns:a.example", "resource", "1997-00-00T00:00:00Z", "text/dns", 3),
        ("http://b.example/", "response", "1997-02-03T04:05:06Z", "text/html", 6)]
    assert bytes(rows[0].block) == body and rows[0].digest == base64.b32encode(hashlib.sha1(b"\xff\xfe\nraw").digest()).decode()


# ------------------------------------------------------------------ chats
def test_chat_matches_sql(same):
    same(chat_format.op8_chat_format, chat_format.OP8_SQL)


def test_chat_odd_rows(llm):
    rows = [(1, 0, None, None), (1, None, "a\nb", "x\\s<|q<"), (1, 0, "assistant", "\\l\\"), (2, 1, "system", ""),
            (None, 1, "assistant", "é😀"), (3, 0, "user", "q"), (3, 1, "assistant", "w " * 200000), (4, 0, "user", "a"), (4, 0, "user", "a")]
    table = llm.createDataFrame([(*r, "f", "v") for r in rows], "conv_id long, turn long, role string, text string, formatted string, v string")
    read = chat_format.read_turns(chat_format.format_turns(chat_format.canonical_turns(chat_format.raw_records(table))))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in read.collect()}
    assert got == {1: [("a\nb", "x\\s<|q<"), ("", ""), ("assistant", "\\l\\")], 2: [("system", "")], None: [("assistant", "é😀")],
                   3: [("user", "q"), ("assistant", "w " * 200000)], 4: [("user", "a"), ("user", "a")]}
    loss = {r.conv_id: "".join(r.loss_texts) for r in read.collect()}
    assert loss == {1: "\\l\\", 2: "", None: "é😀", 3: "w " * 200000, 4: ""}
    assert all(r.formatted.count("<|im_start|>") == len(r.turns) for r in read.collect())
    assert chat_format.raw_records(table.limit(0)).collect() == []


def test_layouts_by_fingerprint(llm):
    cases = [('{"foo":1}', "unknown", None), ("nope", "unknown", None), (None, "unknown", None), ('{"messages":[]}', "messages_empty", []),
             ('{"messages":[{"role":"user","content":null}]}', "messages", [("user", "")]),
             ('{"completion":5,"prompt":"a"}', "prompt", [("user", "a"), ("assistant", "5")]),
             ('{"prompt":"a","response":"b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
             ('{"instruction":"do","input":"x","output":"y"}', "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
             ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")])]
    table = llm.createDataFrame([(r, i, "l") for i, (r, *_) in enumerate(cases)], "record string, i int, name string")
    got = {r.i: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(table).collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(cases)}


@pytest.mark.parametrize("conv", [1, 2, 3, 4])  # both kinds of layout
def test_chat_long_texts(llm, conv):
    """Over 20 M characters no variant holds the text."""
    rows = llm.range(2).select(
        F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") == 0, 'say "x" \\').otherwise(F.repeat(F.lit("abc"), 7_000_000)).alias("text"))
    got = chat_format.canonical_turns(chat_format.raw_records(rows)).selectExpr(
        "layout", "transform(turns, t -> length(t.text)) n", "turns[0].text first").first()
    assert got.layout in ("prompt", "instruction") and got.n == [9, 21_000_000] and got.first == 'say "x" \\'


def test_skeletons_have_the_schema(llm):
    cases = ['{"messages":[{"role":"a","content":"x\\"},{:"},{"role":"b","content":null}, {"role":"b","content":null}]}', '["a","b",{"k:":"v,"}]',
             '{"prompt":"a","completion":5}', "nope", '{"a":{"b":["x"]},"c":"\\\\"}']
    rows = llm.createDataFrame([(c,) for c in cases], "r string")
    for r in rows.select("r", chat_format.schema_paths(F.col("r")).alias("a"), chat_format.schema_paths(chat_format.skeleton(F.col("r"))).alias("b")).collect():
        assert r.a == r.b, r


def test_chat_plan_has_no_python(llm):
    plan = chat_format.op8_chat_format(llm, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ pages
def test_page_text_brute(llm):
    def brute(h):
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(unescape(x.replace("<b>", "").replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", a)]
        return "\n\n".join(b for b in blocks if b)
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    rows = page_text.op10_html_text(llm, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute(pages.html[r.page_id]) and r.n_chars == len(r.text) and r.url == pages.url[r.page_id]


def _site(i, rng, article):
    say = lambda: " ".join(rng.choice("alpha beta gamma delta eta".split()) for _ in range(rng.randint(5, 30)))
    parts = [f"Title {i}"] + [say() for _ in range(rng.randint(2, 6))]
    inner = f"<h1>{parts[0]}</h1><div class='ad'>Buy {i}</div>" + "".join(f"<p>{p[:9]}<b>{p[9:]}</b>" for p in parts[1:])
    comments = "".join(f"<li class=comment><p>{say()}</p>" for _ in range(rng.randint(0, 3)))
    side = "".join(f"<li><a href=x>{say()}</a>" for _ in range(3))
    body = f"<article>{inner}</article>" if article else f'<div class="content"><div class=inner>{inner}</div></div>'
    return parts, (f"<html><head><title>T</title><script>var x='</p><article>';</script></head><body><div class='cookie-notice'>We use "
                   f"cookies</div><header><a href=/>Site</a><form><label>Search</label></form></header><div id=menu><ul><li><a>a</a>"
                   f"</ul></div><div id='sidebar'><h3>Side</h3><ul>{side}</ul></div><div class=wrap>{body}</div><section id=comments>"
                   f"<h3>Comments</h3><ul>{comments}</ul></section><!-- <p>no</p> --><footer>foot {i}</footer></body>")


@pytest.mark.parametrize("article", [True, False])
def test_wrappers_find_the_article(article):
    rng = random.Random(1)
    site = [_site(i, rng, article) for i in range(40)]
    wrapper = page_text._mark(page_text.infer([h for _, h in site[:24]]))
    for parts, h in site:
        assert page_text.extract(h, wrapper) == parts


def test_repeats_and_options_are_inferred():
    wrapper = page_text.infer(["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>n</h2><p>x</p>", "<dl><dt>k<dd>v<dt>k2<dd>v2</dl>"])
    kinds = [(p["label"], p["opt"]) for p in wrapper]
    assert kinds == [("ul", True), ("h2", True), ("p", True), ("dl", True)] or [k for k, _ in kinds].count("dl") == 1
    items = wrapper[0]["kids"]
    assert items[0]["label"] == "li" and items[0]["rep"] and items[0]["kids"][0]["same"] is None
    pair = next(p for p in wrapper if p["label"] == "dl")["kids"]
    assert pair[0]["label"] == "()" and pair[0]["rep"] and [k["label"] for k in pair[0]["kids"]] == ["dt", "dd"]


def test_pages_odd_rows(llm):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "nope", "just text &amp; more\n\n words"), (4, "http://H:80/", "<p>a<p>b<article><p>c"),
            (4, "http://H:80/", "<p>a<p>b<article><p>c"), (None, "http://u", "<script>x"), (5, "http://v", "<" * 2000 + "p" * 300000),
            (6, "http://w", "<div>" * 3000 + "deep")]
    table = llm.createDataFrame([(*r, "b", "w") for r in rows], "page_id long, url string, html string, blocks string, wrapper string")
    got = {r.page_id: r.blocks for r in page_text.page_texts(table).collect()}
    assert got[1] == got[2] == got[None] == [] and got[3] == ["just text & more words"] and got[4] == ["c"] and got[6] == ["deep"]
    assert len(got[5][0]) >= 300000
    assert page_text.page_texts(table.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<a " * 350_000, "<" + "p" * 1_000_000, "<!" * 400_000, "<a \"" * 250_000, "<a '\">" * 150_000,
                                  "<p x=\">\" '" * 100_000 + ">", "<script>" * 100_000, "<!--" * 200_000, "</" * 400_000,
                                  "&" * 500_000, "<p>x" * 100_000, "<b><ul><li>x" * 40_000])
def test_broken_pages_end(page):
    began = time.monotonic()
    page_text.extract(page, page_text._mark(page_text.infer([page, page + "<p>z", "<div>" + page])))
    assert time.monotonic() - began < 60


def test_scan_reads_tags():
    page = "a<!-- <p> -->b<!DOCTYPE x><P Class='a>b'>c<br/>1 < 2<script>if (a<b) '</p>'</SCRIPT >d</p>e<p <3 > '<"
    assert list(page_text.scan(page)) == [
        (None, False, "a"), (None, False, "b"), ("p", False, " Class='a>b'"), (None, False, "c"), ("br", False, "/"),
        (None, False, "1 "), (None, False, "<"), (None, False, " 2"), (None, False, "d"), ("p", True, ""), (None, False, "e"),
        ("p", False, " <3 "), (None, False, " '<")]


@pytest.mark.parametrize("cells", [1 << 28, 4])
def test_longest_common_subsequence(cells):
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcd"[:rng.randint(1, 4)], k=rng.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = page_text.common(a, b, cells)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))


def test_long_siblings_align():
    rng = random.Random(9)
    pages = ["".join(f"<div class={rng.choice('abcdefg')}>t</div>" for _ in range(6000)) for _ in range(2)]
    began = time.monotonic()
    page_text.infer(pages)
    assert time.monotonic() - began < 60


def _words(i, n):
    return " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(n))


def test_article_is_not_lost(llm):
    """Layouts that few pages have, copies, teasers in main, class words and constants within the article."""
    def page(inner):
        return f"<body><nav><a href=/>Home</a></nav>{inner}<footer>foot</footer>"
    rows, want = [], {}

    def add(host, html, blocks):
        want[len(rows)] = blocks
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))
    for i in range(300):  # a hot host with a rare layout
        a, b = _words(i, 20), _words(i + 1000, 30)
        if i % 100 == 7:
            add("hot", f"<body class=b><nav>n</nav><div class=post><p>{a}</p><p>{b}</p></div>", [a, b])
        else:
            add("hot", page(f"<div class=content><p>{a}</p><p>{b}</p></div>"), [a, b])
    for i in range(30):  # main on a host of articles
        a = _words(i, 25)
        tag = "main" if i == 11 else "article"
        add("mixed", page(f"<{tag}><p>{a}</p></{tag}>"), [a])
    copy = _words(5, 25)
    for i in range(40):  # copies and other layouts
        a = copy if i < 26 else _words(i, 25)
        add("copies", page(f"<div class=content><p>{a}</p></div>" if i < 36 else f"<section class=text><p>{a}</p></section>"), [a])
    for i in range(12):  # teasers beside the article's text in main
        a, b = _words(i, 40), _words(i + 50, 30)
        add("teasers", page(f"<main><h1>T{i}</h1><p>{a}</p><p>{b}</p><article class=card><p>more {i}</p></article></main>"),
            [f"T{i}", a, b, f"more {i}"])
    lead = "The same lead stands on every page."
    for i in range(12):
        a = _words(i, 30)
        add("words", page(f'<article><div class="entry-header"><h1>Head {i}</h1></div><p class=lead>{lead}</p>'
                          f'<p class="share-price">{a}</p><p><a href=x>all a link {i}</a></p><div class="ad">Buy!</div></article>'),
            [f"Head {i}", lead, a, f"all a link {i}"])
    table = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.blocks for r in page_text.page_texts(table).collect()}
    assert got == want


def test_wrappers_merge_in_rounds(llm, monkeypatch):
    monkeypatch.setattr(page_text, "MERGE", 2)
    pages = [(i, "http://h/", f"<div class=content><p>{_words(i, 9)}</p>{'<h2>x</h2><ul><li>a</ul>' * (i % 3)}"
              f"<{'abcdefgh'[i % 8]}x>{i}</{'abcdefgh'[i % 8]}x></div>") for i in range(40)]
    table = llm.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    assert [r.host for r in page_text.host_wrappers(table).collect()] == ["h"]


def test_every_wording_is_found_on_its_own_line(llm, docs):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    wordings = [(name, x.replace("[", "").replace("]", "")) for name, v in license_scan.TEMPLATES.items() for x in v]
    for name, line in wordings:
        _, found = scanner.scan(f"some text before it\n\n{line}\n\nand after it")
        assert name in {f["license"] for f in found}, line
    out, column = license_scan.license_scan(docs([(i, f"words\n\n{line}\n", "en") for i, (_, line) in enumerate(wordings)]))
    got = {r.doc_id: {f["license"] for f in r[column]["finds"]} for r in out.collect()}
    assert all(name in got[i] for i, (name, _) in enumerate(wordings))


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(llm, docs):
    raw = llm.read.parquet(f"{SF}/documents.parquet")
    kept = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stored(stage(llm, kept, SF))
        assert kept.columns == raw.columns and kept.count() <= before.count(), name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    groups = {r.doc_id: r.component_id for r in simhash_dedup.simhash_groups(raw).collect()}
    assert len({groups[i] for i in ids}) == len(ids)  # one of each group
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    last = corpus_pipeline.run(llm, SF)
    assert last.columns == raw.columns + ["tokens"]
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids


def test_language_stage_keeps_switching_texts(llm):
    raw = llm.read.parquet(f"{SF}/documents.parquet")
    d = raw.toPandas()
    words = [" ".join(t.split()[:60]) for t in d.dropna(subset=["lang"]).groupby("lang").text.first()]
    assert len(words) >= 3
    mixed = raw.limit(1).withColumn("doc_id", F.lit(-5).cast(raw.schema["doc_id"].dataType)).withColumn(
        "text", F.lit(" ".join(words))).withColumn("lang", F.lit(None).cast("string"))
    out, name = language_id.language_id(mixed, language_id.fit_language_model(raw))
    best = out.first()[name]
    assert best.lang_pred != language_id.UNKNOWN and best.score < 0.4
    kept = corpus_pipeline.language(llm, raw.unionByName(mixed), SF).select("doc_id").toPandas().doc_id
    assert -5 in set(kept)
    told = d[[isinstance(t, str) and any(c.isalpha() for c in t) for t in d.text]].doc_id
    assert sorted(kept) == sorted([*told, -5])


def test_pipeline_odd_rows(llm, docs, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (None, "the cat sat on the mat by the sea", "en"), (4, "the dog and the fox ran away", "en"),
            (4, "the dog and the fox ran away", "en"), (5, "le chat est dans la maison avec un chien", "fr"), (6, "12 34", None)]
    docs(rows).withColumnRenamed("tokens", "extra").write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([(1, "le chat est dans la maison")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(llm, str(tmp_path)).collect())
    assert got == ["4", "None"]
    docs(rows).limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    llm.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(llm, f"{tmp_path}/e").collect() == []


def test_pipeline_brute(llm):
    """Stages two to four against plain Python, on what the first one keeps."""
    from tests.llm.test_text_ops import _brute_fingerprint, _brute_groups, _brute_repeats
    docs = stored(corpus_pipeline.STAGES[0][1](llm, llm.read.parquet(f"{SF}/documents.parquet"), SF)).toPandas().sort_values("doc_id")
    ids, texts = docs.doc_id.tolist(), docs.text.tolist()
    groups = _brute_groups(ids, np.array([_brute_fingerprint(t) for t in texts], np.uint64))
    left = [(i, t) for i, t, g in zip(ids, texts, groups) if i == g]
    cut = _brute_repeats([t for _, t in left], 35)
    left = [(i, t if not gone else kept) for (i, t), (n, gone, kept) in zip(left, cut) if not gone or gone < n]

    def words(t):
        return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]

    windows = {}
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        own = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w, *_ in words(t)]
        m = min(13, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            windows.setdefault(m, set()).add(tuple(own[i:i + m]))
    want = {}
    for i, t in left:
        ws = words(t)
        low = ["".join(c.lower() if c.isascii() else c for c in t[a:b]) for _, a, b in ws]
        hit = set()
        for m, some in windows.items():
            for j in range(len(low) - m + 1):
                if tuple(low[j:j + m]) in some:
                    hit.update(range(j, j + m))
        if hit and 20 * len(hit) >= len(ws):
            continue
        keep, at = [], 0
        for j in sorted(hit):
            if j - 1 not in hit:
                keep.append(t[at:ws[j][1]])
            at = ws[j][2]
        want[i] = "".join(keep) + t[at:]
    got = {r.doc_id: r.text for r in corpus_pipeline.run(llm, SF).collect()}
    assert got == want
