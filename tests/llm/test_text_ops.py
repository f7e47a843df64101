"""Substring dedup, near-dedup, decontamination, language ID, pieces: brute force and odd rows."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from quizloom.llm import decontaminate, language_id, sentence_pieces, simhash_dedup, substring_dedup
from quizloom.llm.common import ALNUM, Words, rolling
from quizloom.llm.graph import connected_components
from tests.llm.conftest import SF

LONG = " ".join(f"w{i % 700}" for i in range(30000))
ODD = [(1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (None, "null id here", "en"), (4, "same text twice", "en"),
       (4, "same text twice", "en"), (5, "same text twice", "fr"), (6, LONG, "en"), (7, "é ü 中文 😀 \x0b", None)]


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ------------------------------------------------------------------ substring dedup
def _brute_repeats(texts, size):
    count = {}
    lists = [_words(t) for t in texts]
    for ws in lists:
        for i in range(len(ws) - size + 1):
            k = tuple(ws[i:i + size])
            count[k] = count.get(k, 0) + 1
    out = []
    for ws in lists:
        gone = set()
        for i in range(len(ws) - size + 1):
            if count[tuple(ws[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def test_substring_matches_sql(same):
    same(substring_dedup.op4_substring_dedup, substring_dedup.OP4_SQL)


@pytest.mark.parametrize("size,chunk", [(3, 1 << 20), (3, 300), (1, 200)])
def test_substring_brute(llm, docs, size, chunk):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 25))), "en") for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in
           substring_dedup.substring_dedup(docs(rows), size=size, chunk_bytes=chunk).collect()}
    assert got == dict(zip([i for i, *_ in rows], _brute_repeats([t for _, t, _ in rows], size)))


def test_substring_odd_rows(llm, docs):
    rows = substring_dedup.substring_dedup(docs(ODD), size=3).collect()
    want = sorted(zip([i for i, *_ in ODD], _brute_repeats([t for _, t, _ in ODD], 3)), key=repr)
    assert sorted(((r.doc_id, (r.n_words, r.n_removed, r.kept_text)) for r in rows), key=repr) == want
    spans = next(r.spans for r in rows if r.doc_id == 6)
    assert [list(s) for s in spans] == [[0, 30000]]
    assert substring_dedup.substring_dedup(docs(ODD).limit(0)).collect() == []
    kept = substring_dedup.substring_dedup_filter(docs(ODD), size=3)
    assert kept.columns == docs(ODD).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "3", "7", "None"]


def test_rolling_hash_tells_order():
    h = Words([b"a b c a b"]).hashes()
    two = rolling(h, 2)
    assert two[0] == two[3] and len(set(two.tolist())) == 3
    assert len(rolling(h, 6)) == 0


# ------------------------------------------------------------------ simhash
def _brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = _words(t)
    shingles = [" ".join(ws[j:j + 4]) for j in range(max(1, len(ws) - 3))] if ws else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def _brute_groups(ids, f):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1:] ^ f[a]) <= 4) + a + 1:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash_brute(llm):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    f = np.array([_brute_fingerprint(t) for t in docs.text], np.uint64)
    groups = _brute_groups(docs.doc_id.tolist(), f)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.op6_simhash_dedup(llm, SF).collect()}
    assert got == {i: (f"{int(x):016x}", g) for i, x, g in zip(docs.doc_id, f, groups)}


@pytest.mark.parametrize("block", [4096, 20])
def test_pigeonring_links_lose_nothing(llm, block):
    rng = np.random.default_rng(1)
    found = set()
    for base in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        for _ in range(120):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(k)
            found.add(x)
    f = np.array(sorted(found), np.uint64)
    ids = [3 * i + 5 for i in range(len(f))]
    nodes = llm.createDataFrame(pd.DataFrame({"fp": f.view(np.int64), "node": ids}))
    links = simhash_dedup.near_links(nodes, block=block)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert [got.get(i, i) for i in ids] == _brute_groups(ids, f)


def test_simhash_odd_rows(llm, docs):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup.simhash_groups(docs(ODD)).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == 1
    assert {c for (i, _), c in got.items() if i in (4, 5)} == {4}
    assert [c for (i, _), c in got.items() if i is None] == [None]
    kept = simhash_dedup.simhash_filter(docs(ODD))
    assert kept.columns == docs(ODD).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "None"]
    assert simhash_dedup.simhash_groups(docs(ODD).limit(0)).collect() == []


def test_components_of_a_chain_and_a_star(llm):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(llm.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(llm.createDataFrame([], "u long, v long")).collect() == []


# ------------------------------------------------------------------ decontamination
def test_decontamination_matches_sql(same):
    same(decontaminate.op9_benchmark_decontamination, decontaminate.OP9_SQL)


def _brute_hits(text, items, window):
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, gone, names = split(text), set(), set()
    for k, t in items:
        own = split(t)
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(ws) - m + 1):
                if ws[j:j + m] == own[i:i + m]:
                    gone.update(range(j, j + m))
                    names.add(str(k))
    return len(ws), len(gone), sorted(names)


@pytest.mark.parametrize("part", [100_000, 12])
def test_decontamination_brute(llm, docs, part):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["ab", "B", "c", "é", "d1", "zz"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), "en") for i in range(40)]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(3, "ab b"), (None, "ab"), (99, None), (98, "..")]
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(
        docs(rows), bench, window=4, part_words=part).collect()}
    real = [(k, t) for k, t in items if k is not None]
    assert got == {i: _brute_hits(t, real, 4) for i, t, _ in rows}


def test_decontamination_long_items(llm, docs):
    """Items over many segments and parts: every window found, parts bounded."""
    rng = random.Random(5)
    long = [f"v{rng.randint(0, 3000)}" for _ in range(9000)]
    items = [("long", " ".join(long)), ("copy", " ".join(long[4000:4020])), ("long", " ".join(long)), ("other", "x y z")]
    bench = llm.createDataFrame(items, "item_id string, text string")
    rows = [(1, " ".join(long), "en"), (2, " ".join(["q"] * 9 + long[1980:2005] + ["q"]), "en"), (3, " ".join(long[8987:]), "en"),
            (4, " ".join(long[3999:4011]), "en"), (5, "x Y z", "en"), (6, " ".join(long[3995:4021]), "en")]
    want = {1: (9000, 9000, ["copy", "long"]), 2: (35, 25, ["long"]), 3: (13, 13, ["long"]), 4: (12, 0, []),
            5: (3, 3, ["other"]), 6: (26, 26, ["copy", "long"])}
    for part in (100_000, 2_500):
        got = decontaminate.contamination(docs(rows), bench, part_words=part).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    cut = decontaminate.item_segments(bench, "item_id", "text", 13, 2_500)
    sizes = sorted(r.n for r in cut.collect())
    assert sizes == [3, 20] + [9000 - 4 * 1988] + [2000] * 4
    parts = decontaminate.automata(cut, 13, 2_500).select("n").collect()
    assert sum(r.n for r in parts) == sum(sizes) and max(r.n for r in parts) <= 2_500


def test_decontamination_odd_rows(llm, docs):
    bench = llm.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "twice")], "item_id long, text string")
    rows = decontaminate.contamination(docs(ODD), bench).collect()
    hit = {str(r.doc_id): (r.n_hit, r.contaminated) for r in rows}
    assert hit == {"1": (0, False), "2": (0, False), "3": (0, False), "None": (0, False), "4": (1, True), "5": (1, True),
                   "6": (43 * 13, False), "7": (0, False)}
    kept = decontaminate.decontaminate_filter(docs(ODD), bench)
    assert kept.columns == docs(ODD).columns
    texts = {str(r.doc_id): r.text for r in kept.collect()}
    assert set(texts) == {"1", "2", "3", "None", "6", "7"} and texts["1"] is None and texts["7"] == ODD[-1][1]
    assert len(texts["6"].split()) == 30000 - 43 * 13 and "w13 " not in texts["6"][:40]
    empty = decontaminate.contamination(docs(ODD), bench.limit(0)).collect()
    assert len(empty) == len(ODD) and not any(r.n_hit for r in empty)
    assert decontaminate.contamination(docs(ODD).limit(0), bench).collect() == []


def test_normalised_words():
    w = Words([b"Ab-c9 \xc3\xa9A", b""], ALNUM, lower=True)
    assert [w.raw[a:b] for a, b in zip(w.start, w.end)] == [b"ab", b"c9", b"\xc3\xa9a"] and w.first.tolist() == [0, 3, 3]


# ------------------------------------------------------------------ language ID
@pytest.fixture(scope="module")
def model(llm):
    return language_id.fit_language_model(llm.read.parquet(f"{SF}/documents.parquet"))


def test_language_held_out_accuracy(llm):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    rows = [r for r in language_id.op5_language_id(llm, SF).collect()]
    assert len(rows) == len(docs)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs.lang[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_sample_with_a_shared_id(llm):
    """One id on all rows and many copies: the draw keeps to its bound, spread over the texts; copies count once."""
    wide = llm.range(100_000).selectExpr("4L AS doc_id", "concat('word', id, ' two three') AS text",
                                         "CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END AS lang")
    copies = llm.range(50_000).selectExpr("4L AS doc_id", "'one text' AS text", "'c' AS lang")
    got = language_id.fitting_sample(wide.unionByName(copies), words_per_doc=2).toPandas()
    sizes = got.groupby("l").size().to_dict()
    assert 300 <= sizes["a"] <= 400 and 300 <= sizes["b"] <= 400 and sizes.get("c", 0) <= 1  # all copies or none
    assert got.h.nunique() == len(got) and got.t.str.split().str.len().max() <= 2
    assert (got[got.l == "b"].t.str.extract(r"word(\d+)")[0].dropna().astype(int) > 50_000).mean() > 0.3


def test_language_switches_are_labelled(llm, model, docs):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    en, fr = (d[d.lang == x].text.iloc[0][:300] for x in ("en", "fr"))
    out, name = language_id.language_id(docs([(1, f"{en} {fr} {en}", "en")]), model, segments=True)
    runs = out.first()[name].segments
    assert [r.lang for r in runs if r.n_words > 3] == ["en", "fr", "en"]


def test_language_odd_rows(llm, model, docs):
    rows = ODD + [(8, "12 34 !!", "en"), (9, "— …", "en")]
    out, name = language_id.language_id(docs(rows), model)
    got = {str(r.doc_id): r[name] for r in out.collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in "12389")
    assert got["6"].lang_pred in model.labels
    out, name = language_id.language_id(docs(rows), None)
    assert {r[name].lang_pred for r in out.collect()} == {"und"}
    assert language_id.fit_language_model(docs(rows).limit(0)) is None
    kept = language_id.language_filter(docs(ODD))
    assert kept.columns == docs(ODD).columns and not {"1", "2", "3"} & {str(r.doc_id) for r in kept.collect()}


def test_forward_backward_against_all_paths():
    import itertools
    rng = np.random.default_rng(0)
    m = language_id.Crf(["a", "b"], None, None, None, rng.normal(size=2), rng.normal(size=(2, 2)))
    lengths = np.array([3, 1, 4])
    e = rng.normal(size=(8, 2))
    got, _, _ = language_id._forward_backward(language_id._Chains(lengths), e, m)
    at = 0
    for n in lengths:
        p = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            s = m.start[path[0]] + sum(e[at + i, k] for i, k in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:]))
            for i, k in enumerate(path):
                p[i, k] += np.exp(s)
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


# ------------------------------------------------------------------ pieces
@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    body = open(sentence_pieces.default_model(), "rb").read()
    return sentence_pieces.PieceModel(body), sentencepiece.SentencePieceProcessor(model_proto=body), body


def _split(m, texts):
    ids, at = m.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def _fuzz(n):
    rng = random.Random(2)
    some = "abcdeehitnosr .,\n\t▁é中😀<>s/0x1AŹ \x00\x01"
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        " " * k + "a" for k in range(20)] + ["a" * k for k in range(40)] + ["a\n", "\na", "a\nb", "a \n b", "\n", "", LONG]


def test_pieces_equal_the_library(pieces):
    m, library, _ = pieces
    texts = _fuzz(3000) + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    got = _split(m, texts)
    assert got == library.encode(texts)
    flat, at = np.array([i for x in got for i in x]), np.cumsum([0] + [len(x) for x in got])
    assert m.decode(flat, at) == [t.replace("▁", " ") for t in texts]


def test_unigram_scores_are_the_best(pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    p = pb.ModelProto()
    p.ParseFromString(pieces[2])
    p.trainer_spec.model_type = 1
    for q in p.pieces:
        if q.type == 1:
            q.score = max(q.score, -40000) / 2500
    body = p.SerializeToString()
    m, library = sentence_pieces.PieceModel(body), sentencepiece.SentencePieceProcessor(model_proto=body)
    texts = _fuzz(1500)
    total = lambda ids: sum(m.scores[i] for i in ids)
    for a, b in zip(_split(m, texts), library.encode(texts)):
        assert abs(total(a) - total(b)) < 1e-3  # the library adds in single precision


def test_pieces_odd_rows(llm, docs, pieces):
    coded = sentence_pieces.piece_encode(docs(ODD))
    assert coded.columns[-1] == "tokens_"  # the name was taken
    back = sentence_pieces.piece_decode(coded, tokens="tokens_")
    rows = back.select("text", "decoded").collect()
    assert len(rows) == len(ODD) and all(r.text == r.decoded for r in rows)
    assert sentence_pieces.piece_encode(docs(ODD).limit(0)).collect() == []


def test_pieces_query(llm, pieces):
    _, library, _ = pieces
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    rows = sentence_pieces.op3_sentencepiece(llm, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert r.round_trip and r.n_tokens == len(ids)
        assert r.tokens_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
