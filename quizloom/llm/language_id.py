"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a language, so text that switches languages is labelled piece by
piece.  A word's scores come from its byte n-grams (2 to 4 bytes of the lower-cased word
between two blanks, so those at its ends are its affixes) and, for words of the learned
lexicon, from a row of their own; the scores of a word beside another come from learned
transitions.  Prediction runs forward-backward over the whole text; a text's language is
the one with the largest mean marginal, and that mean is the score.

Fitting uses at most ``DOCS_PER_LANGUAGE`` labelled rows of each language and
``WORDS_PER_DOC`` consecutive words of each, strung together to switching sequences, by
gradient ascent on the regularised likelihood.  The sample is drawn by a hash of the row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.common import Words, free_name, prepare, slabs

#: Bounds of the fitting sample.
DOCS_PER_LANGUAGE = 400
WORDS_PER_DOC = 80
LEXICON_WORDS = 20_000
#: Fitting.
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
ROUNDS = 60
RATE = 0.05
DECAY = 3e-4
SEED = 7
UNKNOWN = "und"
#: Distinct words whose n-grams are held at once.
WORDS_AT_ONCE = 16_384

#: ASCII letters (lower case) and the bytes of non-ASCII characters.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray     # (BUCKETS, K)
    lexicon: np.ndarray   # sorted word hashes
    words: np.ndarray     # (len(lexicon) + 1, K); the last row is for other words
    start: np.ndarray     # (K,)
    moves: np.ndarray     # (K, K)


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) pairs of the n-grams of some words, each word set between blanks."""
    spaced = np.frombuffer(b" " + b" ".join(w.raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())) + b" ", np.uint8)
    size = w.end - w.start
    low = np.cumsum(np.append(0, size[:-1] + 1))
    owner = np.repeat(np.arange(len(size)), size + 1)
    high = (low + size + 2)[owner]
    at = np.arange(len(owner))
    buckets, owners = [], []
    code = spaced.astype(np.uint64)
    value = np.zeros(len(spaced), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value[:len(spaced) - n + 1] * np.uint64(257) + code[n - 1:] + np.uint64(1)
        if n in GRAMS:
            ok = at + n <= high
            ok &= at < len(value)
            h = value[at[ok]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x1234567)
            buckets.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
            owners.append(owner[ok])
    return np.concatenate(buckets), np.concatenate(owners)


def _lexicon_row(model: Crf, hashes: np.ndarray) -> np.ndarray:
    none = len(model.lexicon)
    if not none:
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), none - 1)
    return np.where(model.lexicon[at] == hashes, at, none)


def _distinct(w: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words, their hashes, and for each word the index of its like."""
    hashes, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    one = Words([b" ".join(w.raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist()))], LETTERS)
    return one, hashes, which


class _Some:
    """Some of the words of a ``Words``."""

    def __init__(self, w: Words, lo: int, hi: int):
        self.raw, self.start, self.end = w.raw, w.start[lo:hi], w.end[lo:hi]


def _scores(model: Crf, one: Words, hashes: np.ndarray) -> np.ndarray:
    """Emission scores (distinct words, K), some words at a time."""
    out = model.words[_lexicon_row(model, hashes)]
    for lo in range(0, len(hashes), WORDS_AT_ONCE):
        hi = min(lo + WORDS_AT_ONCE, len(hashes))
        bucket, owner = _features(_Some(one, lo, hi))
        order = np.argsort(owner, kind="stable")
        out[lo:hi] += np.add.reduceat(model.grams[bucket[order]], np.searchsorted(owner[order], np.arange(hi - lo)))
    return out


class _Chains:
    """Sequences laid out by position: at each position the sequences that reach it, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        most = int(lengths.max(initial=0))
        self.alive = np.searchsorted(np.sort(-lengths), -np.arange(most), side="left") if most else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.alive)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.at[position] + rank[doc] if most else np.zeros(0, np.int64)
        self.doc_at = doc


def _forward_backward(chains: _Chains, emission: np.ndarray, model: Crf, expected: bool = False):
    """Word marginals (in the order of the words), and with ``expected`` the log-likelihood's
    normaliser and the expected numbers of moves."""
    K = len(model.labels)
    e = np.empty_like(emission)
    top = emission.max(axis=1, keepdims=True, initial=-np.inf)
    e[chains.place] = np.exp(np.maximum(emission - top, -300.0))
    moves = np.exp(model.moves)
    alpha = np.empty_like(e)
    log_z, counts = float(top.sum()), np.zeros((K, K))
    a = None
    steps = len(chains.alive)
    scale = np.empty(len(e))
    for t in range(steps):
        lo, hi = chains.at[t], chains.at[t + 1]
        a = e[lo:hi] * (np.exp(model.start) if t == 0 else a[:hi - lo] @ moves)
        s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[lo:hi], scale[lo:hi] = a, s
    log_z += float(np.log(scale).sum())
    b = np.ones((int(chains.alive[-1]) if steps else 0, K))
    out = np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        lo, hi = chains.at[t], chains.at[t + 1]
        if t < steps - 1:
            n = chains.at[t + 2] - hi
            right = e[hi:hi + n] * b / scale[hi:hi + n, None]
            if expected:
                counts += moves * (alpha[lo:lo + n].T @ right)
            b = right @ moves.T
            if n < hi - lo:
                b = np.concatenate([b, np.ones((hi - lo - n, K))])
        m = alpha[lo:hi] * b
        out[lo:hi] = m / m.sum(axis=1, keepdims=True)
    return out[chains.place], log_z, counts


def fit_crf(texts: list[bytes], langs: list[str], rounds: int = ROUNDS) -> Crf | None:
    """Fit on (lower-cased text, language) rows; None without a labelled word."""
    labels = sorted(set(langs))
    w = Words(texts, LETTERS)
    own = np.diff(w.first)
    if not own.sum():
        return None
    rng = np.random.Generator(np.random.PCG64(SEED))
    rows = np.flatnonzero(own)
    # pieces of 5 to all words of a row, in random order: neighbours in a sequence are often of two languages
    pieces = []
    for r in rows:
        at, end = int(w.first[r]), int(w.first[r + 1])
        while at < end:
            n = int(rng.integers(5, WORDS_PER_DOC + 1))
            pieces.append((at, min(end, at + n), labels.index(langs[r])))
            at += n
    rng.shuffle(pieces)
    words = np.concatenate([np.arange(a, b) for a, b, _ in pieces])
    truth = np.concatenate([np.full(b - a, k) for a, b, k in pieces])
    per = 4
    lengths = np.array([sum(b - a for a, b, _ in pieces[i:i + per]) for i in range(0, len(pieces), per)])
    one, hashes, which = _distinct(w)
    which = which[words]
    bucket, owner = _features(one)
    times = np.bincount(which, minlength=len(hashes))
    common = np.sort(np.argsort(-times, kind="stable")[:LEXICON_WORDS])
    common = common[times[common] >= 3]
    K = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, K)), hashes[common], np.zeros((len(common) + 1, K)), np.zeros(K), np.zeros((K, K)))
    lex = _lexicon_row(model, hashes)
    chains = _Chains(lengths)
    begin = np.cumsum(lengths) - lengths
    inside = np.ones(len(words), bool)
    inside[begin] = False
    second = np.flatnonzero(inside)
    true_moves = np.zeros((K, K))
    np.add.at(true_moves, (truth[second - 1], truth[second]), 1)
    true_start = np.bincount(truth[begin], minlength=K)
    hot = np.eye(K)[truth]
    n = len(words)
    params = [model.grams, model.words, model.start, model.moves]
    first, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_class = lambda index, size, x: np.stack([np.bincount(index, x[:, k], size) for k in range(K)], axis=1)
    for step in range(1, rounds + 1):
        base = by_class(owner, len(hashes), model.grams[bucket]) + model.words[lex]
        marginal, _, counts = _forward_backward(chains, base[which], model, expected=True)
        g_word = by_class(which, len(hashes), hot - marginal)
        grads = [by_class(bucket, BUCKETS, g_word[owner]), by_class(lex, len(common) + 1, g_word),
                 true_start - marginal[begin].sum(axis=0), true_moves - counts]
        grads[1][-1] = 0
        for p, g, m, v in zip(params, grads, first, second_m):  # Adam
            g = g / n - DECAY / 10 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model.grams = model.grams.astype(np.float32)
    return model


def predict(model: Crf | None, texts: list[bytes], segments: bool = False):
    """For each lower-cased text (language, score[, [(language, words), ...]])."""
    for a, b in slabs(texts):
        w = Words(texts[a:b], LETTERS)
        lengths = np.diff(w.first)
        found: list = [(UNKNOWN, 0.0, [])] * (b - a)
        if model is not None and len(w.start):
            one, hashes, which = _distinct(w)
            marginal, *_ = _forward_backward(_Chains(lengths), _scores(model, one, hashes)[which].astype(np.float64), model)
            some = np.flatnonzero(lengths)
            means = np.add.reduceat(marginal, w.first[:-1][some]) / lengths[some][:, None]
            best = means.argmax(axis=1)
            each = marginal.argmax(axis=1) if segments else None
            for i, k, m in zip(some.tolist(), best.tolist(), means):
                # non-ASCII bytes may be signs: the text has a letter, or it stays unknown
                t = texts[a + i]
                if t.isascii() or any(c.isalpha() for c in t.decode("utf-8", "replace")):
                    runs = []
                    if segments:
                        own = each[w.first[i]:w.first[i + 1]]
                        cut = np.flatnonzero(np.diff(own, prepend=-1))
                        runs = [(model.labels[own[c]], int(d)) for c, d in zip(cut, np.diff(np.append(cut, len(own))))]
                    found[i] = (model.labels[k], float(min(1.0, max(0.0, m[k]))), runs)
        yield from found


def held_out(id: str) -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 modulo 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitting_sample(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
                   docs_per_language: int = DOCS_PER_LANGUAGE, words_per_doc: int = WORDS_PER_DOC) -> DataFrame | None:
    """(l, h, t): language, place in the draw and words of a sample of the rows that aren't held out and have a text
    and a language; None if there are none.

    At most ``docs_per_language`` rows of each language, ``words_per_doc`` words of each from a
    place drawn by hash; languages are counted over all rows.  Rows are drawn by id and text, so
    that rows that share an id aren't drawn together; rows alike in both count once, and the
    bound holds before anything leaves the tasks.
    """
    usable = docs.where(~held_out(id) & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    own = [F.col(f"`{id}`").cast("string"), F.col(f"`{text}`")]
    rows = usable.select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"),
                         F.xxhash64(F.lit(SEED), *own).alias("h"), F.xxhash64(F.lit(SEED + 1), *own).alias("place"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 1.3 * docs_per_language / n))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 53)) < share[F.col("l")] * float(1 << 53))
    words = F.split(F.lower("t"), r"[\x20\x09-\x0D]+")
    at = F.pmod("place", F.greatest(F.lit(1), F.size(words) - words_per_doc + 1)).cast("int") + 1
    cut = drawn.select("l", "h", F.array_join(F.slice(words, at, words_per_doc), " ").alias("t")).distinct()
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    return cut.withColumn("_n", first).where(F.col("_n") <= docs_per_language).drop("_n")


def fit_language_model(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
                       docs_per_language: int = DOCS_PER_LANGUAGE, words_per_doc: int = WORDS_PER_DOC) -> Crf | None:
    """Fit on ``fitting_sample``, the only rows that come to the driver; None if there is nothing to fit on."""
    sample = fitting_sample(docs, id, text, lang, docs_per_language, words_per_doc)
    if sample is None:
        return None
    got = sample.toPandas().sort_values(["l", "h", "t"], kind="stable")
    return fit_crf([t.encode() for t in got["t"]], got["l"].tolist())


_LOADED: dict = {}


def _model(shared) -> Crf | None:
    name, model = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = model
    return _LOADED[name]


def language_id(docs: DataFrame, model: Crf | None, text: str = "text", out: str = "language",
                segments: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned): struct of lang_pred, score and, on
    demand, segments (runs of words of one language).

    Null texts, texts without a letter and any text without a model give ``und`` and score 0.
    Whole texts are read; ties go to the first language in alphabetical order; repeated rows are
    labelled alike; all other columns pass through.
    """
    spark = prepare(docs.sparkSession)
    out = free_name(docs, out)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))
    kind = "lang_pred:string,score:double" + (",segments:array<struct<lang:string,n_words:bigint>>" if segments else "")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(f"struct<{kind}>"))])
    arrow = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())] + (
        [("segments", pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())])))] if segments else []))

    def run(batches):
        m = _model(shared)
        for b in batches:
            column = pc.utf8_lower(b.column(b.schema.get_field_index(text)))
            texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
            rows = [{"lang_pred": l, "score": s} | ({"segments": [{"lang": x, "n_words": n} for x, n in r]} if segments else {})
                    for l, s, r in predict(m, texts, segments)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow)], [*b.schema.names, out])

    return docs.mapInArrow(run, schema), out


def language_filter(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` whose language is told, same columns.

    Rejected: null texts and texts without a letter (and all texts if there is nothing to fit on).
    A text that switches languages is kept, whatever the share of its first one.
    """
    rows, out = language_id(docs, fit_language_model(docs, id, text, lang), text)
    return rows.where(F.col(f"{out}.lang_pred") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, fitted on those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs)
    rows, out = language_id(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col(f"{out}.lang_pred").alias("lang_pred"),
                       F.col(f"{out}.score").alias("score"))
