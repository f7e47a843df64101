"""Source divergence, filter interaction and best-fit packing against SQL and plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizloom.llm import best_fit, filter_audit, source_audit

DOCS = "doc_id long, text string, lang string, source string, term string, mask int, item long, digest string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


def test_op11_sql(same):
    same(source_audit.op11_source_divergence, source_audit.OP11_SQL)


def test_op12_sql(same):
    same(filter_audit.op12_filter_interaction, filter_audit.OP12_SQL)


# ---------------------------------------------------------------- source divergence

def audit_plain(rows, least, top):
    found = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
                                             re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    out = set()
    for lang in {f[0] for f in found}:
        own = [f for f in found if f[0] == lang]
        spread = Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in spread.items() if n >= least]
        use = {s: Counter() for _, s, _ in own}
        for _, s, ws in own:
            use[s].update(w for w in ws if w in set(kept))

        def shares(c):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p = {s: shares(c) for s, c in use.items()}
        q = shares(sum(use.values(), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in use:
            pair = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in use if t != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if use[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)}
    return out


def audit_rows():
    rng = np.random.default_rng(5)
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "Über", "über", "überall", "I'm", "naïve—x",
             "z" * 40, "z" * 41, "q1r2", "日本", "日本語", "abcdefgh" * 300]
    rows = [(" ".join(rng.choice(words, rng.integers(1, 9))), "en" if i % 3 else None, f"s{i % 4}") for i in range(90)]
    rows += [("ab abc", "en", "s0")] * 12  # repeated rows
    rows += [(None, "en", "only null"), ("", "xx", None), ("12 34", "xx", "s1"), ("rare", "yy", "s1"), (None, None, None)]
    rows += [("long " * 400_000 + "tail", "en", "s2")]
    return rows


@pytest.mark.parametrize("chunk", [200, 16 << 20])
def test_source_audit_plain(llm, chunk, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 3)
    rows = audit_rows()
    got = source_audit.source_audit(table(llm, [(i, *r) for i, r in enumerate(rows)]), min_docs=5, top=3, chunk_bytes=chunk)
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    assert set(out) == audit_plain(rows, 5, 3)


def test_source_audit_tiles(llm, monkeypatch):
    """Sources over several tiles: every pair once, whichever tiles its sides are in."""
    monkeypatch.setattr(source_audit, "TILE_SOURCES", 3)
    rows = [(f"one two {'three ' * (i % 5)}{'four' if i % 2 else ''}", "en", f"s{i % 11:02}") for i in range(80)]
    got = source_audit.source_audit(table(llm, [(i, *r) for i, r in enumerate(rows)]), min_docs=2)
    assert sorted(map(tuple, got.collect())) == sorted(audit_plain(rows, 2, 10))


def test_source_audit_empty(llm):
    assert source_audit.source_audit(table(llm, [])).collect() == []


def test_chunk_prefix_counts():
    """Counts of a chunk's prefixes are distinct documents, up to the threshold."""
    chunk = source_audit._Chunk(3)
    texts = [b"abx aby abz", b"abx abq", b"ab", b"zz abx"]
    for t in texts:
        chunk.add("en", "s", t)
    rows = [r for b in chunk.batches() for r in b.to_pylist()]
    got = {(r["level"], r["term"], r["done"]): r["n"] for r in rows if r["level"]}
    assert len(got) == len(rows) - 1
    for level in (1, 2, 3):
        size = 2 ** (level - 1)
        for key, done in {(w[:size], len(w) <= size) for t in texts for w in t.split()}:
            n = sum(any(w[:size] == key and (len(w) <= size) == done for w in t.split()) for t in texts)
            if (level, key, done) in got:
                assert got[level, key, done] == min(n, 3)
            else:
                assert done and len(key) <= size // 2


def test_share_is_exact(llm):
    cases = [(0, 0, 1), (7, 10**15, 10**6), (5 * 10**14, 9 * 10**14, 10**7), (1, 3, 2)]
    got = llm.createDataFrame(cases, "n long, total long, v long").select(
        "n", "total", "v", source_audit._share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    for n, total, v, p in got.collect():
        assert p == 1 + 10**9 * (n + 2) // (total + 2 * v)


# ---------------------------------------------------------------- filter interaction

def interaction_plain(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            any(c in t for c in "#$%&*|"), i is not None and smallest[t] < i)) if x}
        marks = [m for m in labels if m[0] == i and i is not None]
        docs.append((s or "", fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = []
    for part in {d[0] for d in docs}:
        share = Counter()
        own = [d for d in docs if d[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                share[f] += len(gone)
                steps.append((f, (part, "".join(order), k, len(left), len(gone), sum(f in d[1] for d in own) - len(gone),
                                  sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))))
        out += [(*row, share[f]) for f, row in steps]
    return sorted(out)


def test_filter_audit_plain(llm):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = [f"w{rng.integers(0, rng.choice([20, 2000]))}" for _ in range(rng.choice([3, 49, 50, 80]))]
        text = rng.choice([" ", "\n", " \t\x0b"]).join(words) + rng.choice(["", " #", " A" * 9, "\x1c é"])
        rows += [(i, text, rng.choice(["s", "t", None]))] * rng.choice([1, 1, 2])  # repeated rows, same id
        if i % 4 == 0:
            rows.append((1000 - i, text, "t"))  # copies in another part
        if i % 9 == 0:
            rows.append((None, text, "s"))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, None, None), (5003, "x " * 600_000, "big")]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows]
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.filter_audit(table(llm, [(i, t, "en", s) for i, t, s in rows]),
                                    llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == interaction_plain(rows, labels)


def test_filter_audit_empty(llm):
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table(llm, []), labels).collect() == []
    one = filter_audit.filter_audit(table(llm, [(None, None, None, None)]), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


@pytest.mark.parametrize("m", [2, 3, 5])
def test_least_squares_is_shapley(m):
    """The constrained fit gives the mean marginal contribution over all orders, for any game."""
    rng = np.random.default_rng(m)
    values = [int(x) for x in rng.integers(-50, 1000, 1 << m)]
    got = filter_audit.shapley(values, filter_audit.normal_inverse(m))
    want = [0] * m
    orders = list(permutations(range(m)))
    for order in orders:
        before = 0
        for f in order:
            want[f] += values[before | 1 << f] - values[before]
            before |= 1 << f
    assert [x * len(orders) for x in got] == want


# ---------------------------------------------------------------- best-fit packing

def packed_right(rows, texts):
    """Every piece is there with its ids' digest, sequences are gapless; gives the number of sequences."""
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024
        bounds = ([(0, head)] if head else []) + [(a, 1024) for a in range(head, len(ids), 1024)]
        want.update((i, p, a, n, zlib.crc32(ids[a:a + n].tobytes())) for p, (a, n) in enumerate(bounds))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(n * k[3] for k, n in want.items())


def test_op13(llm):
    from tests.llm.conftest import SF
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    n, total = packed_right(best_fit.op13_best_fit_packing(llm, SF).collect(),
                            [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-total // 1024) * 1.03


def test_packing_odd_texts(llm):
    texts = [(1, None), (2, ""), (3, " "), (4, "a  b\n\n c \t d"), (4, "a  b\n\n c \t d"), (None, "x"), (None, "x"),
             (5, "it's <|endoftext|> 's'll don't,,, (foo) \xa0  x —, naïve! 12ab.34"), (6, "y" * 30_000),
             (7, "the cat, sat. " * 60_000), (8, " lead"), (9, "trail  "), (10, "\x1c!\x1d \x85? z"), (11, "<|endoftext|>"),
             (12, "日本語、テスト。 한국어 ١٢٣ ½²")]
    got = best_fit.best_fit_packing(table(llm, [(i, t, "en", "s") for i, t in texts]), VOCABULARY).collect()
    packed_right(got, texts)
    assert best_fit.best_fit_packing(table(llm, []), VOCABULARY).collect() == []


def test_units_keep_the_librarys_ids():
    """Cut texts have the ids of whole ones, also with a memory that forgets."""
    rng = np.random.default_rng(11)
    library = Tokenizer.from_file(VOCABULARY)
    parts = ["a", "Zé", "'s", "'", "n't", " ", "  ", "\n", "\t", ".", ",,", "—", "1", "²", "<|endoftext|>", "<|", "\xa0",
             " ", "\x1c", "\x85", "日本", "́", "😀", "_", "-", "\r\n"]
    encoder = best_fit.Encoder(VOCABULARY, size=50)
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 30)))
        whole = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder([text]) == [whole], text
        assert b"".join(encoder(list(best_fit.text_slices(text, 5)))) == whole, text


@pytest.mark.parametrize("kind", ["mixed", "long", "halves"])
def test_pack_levels(llm, kind):
    """Many small nodes: places are gapless, no bin is too full, and the tree comes near one best-fit pass."""
    rng = np.random.default_rng(2)
    sizes = {"mixed": rng.integers(1, 1024, 6000), "long": np.full(4000, 600),
             "halves": rng.choice([200, 300, 512], 5000)}[kind].tolist()
    items = llm.createDataFrame([(i * 7, s) for i, s in enumerate(sizes)], "item long, size long")
    rows = best_fit.pack(items, node_items=200).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append((r.offset, sizes[r.item // 7]))
    assert len(rows) == len(sizes) == len({r.item for r in rows})
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 1024
    assert len(bins) <= 1.06 * len(set(best_fit.best_fit(sizes, 1024)[0]))


def test_best_fit_takes_the_tightest_bin():
    assert best_fit.best_fit([6, 5, 4, 5], 10) == ([0, 1, 0, 1], [0, 0, 6, 5])
