"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence of the normalised benchmark items.  Document words
are streamed through it and the longest matching length is tracked; where it reaches the
window, the window's last words are a hit.  The items that own a matched window come from
the automaton's states (every item whose text passes through a state).

Two neighbouring words that follow each other in no item bring the automaton back to a
match of one word at most, so only runs of known neighbours are streamed word by word; the
runs are found by numpy over the whole batch, for any number of documents.  Hits found by
word hashes are confirmed on the words themselves.

The benchmark is cut in tasks into segments that overlap by a window less one word, and other
tasks gather segments into parts of at most ``PART_WORDS`` words, build the automaton of each and
write it to the shared folder.  The driver hands on one part after the other, so what it holds
and what is broadcast is bounded whatever the benchmark's or an item's size; documents pass once
for each part and the parts' hits are united.  Documents are never shuffled.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from quizloom.llm.common import ALNUM, Words, free_name, prepare, slabs, stored, text_bytes

WINDOW = 13
PART_WORDS = 100_000
#: Words of an item handled as one; longer items are cut into overlapping segments of that many.
SEGMENT_WORDS = 2_000
#: A document is contaminated if at least one word in ``COVERAGE`` is hit.
COVERAGE = 20


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows each state stands for."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.word_id = {w: i for i, w in enumerate(vocabulary)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []  # (state, item) of every prefix of every item
        shorts: list[tuple[int, int, int]] = []  # (state, length, item) of items below a window
        pairs = set()
        self.names = [name for name, _ in items]
        for k, (_, ws) in enumerate(items):
            ids = [self.word_id[w] for w in ws]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
                ends.append((last, k))
            if 0 < len(ids) < window:
                shorts.append((last, len(ids), k))
        self._finish(ends, shorts)
        spelled = Words([b" ".join(vocabulary)], ALNUM)
        h = spelled.hashes() if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order.astype(np.int64)
        n = max(1, len(vocabulary))
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)
        self.vocabulary = vocabulary
        self.least = min([window] + [m for _, m, _ in shorts])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _finish(self, ends, shorts) -> None:
        """Items of each state that holds a whole window (a state's texts end in the same places)."""
        owners: list[set[int]] = [set() for _ in self.next]
        for state, k in ends:
            owners[state].add(k)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            up = self.link[s]
            if up > 0 and self.length[up] >= self.window:
                owners[up] |= owners[s]
        # the state of a suffix of exactly ``window`` words lies on the link path: the last one long enough
        self.full = list(range(len(self.next)))
        for s in reversed(order):
            up = self.link[s]
            if up > 0 and self.length[up] >= self.window:
                self.full[s] = self.full[up]
        self.owners = [frozenset(o) for o in owners]
        self.short: list[tuple] = [()] * len(self.next)
        for state, m, k in shorts:
            self.short[state] += ((m, k),)
        for s in reversed(order):  # parents come first
            if self.link[s] > 0 and self.short[self.link[s]]:
                self.short[s] = self.short[s] + self.short[self.link[s]]

    def stream(self, ids) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit intervals [from, to) of a run of word ids, and the indices of the items that own them."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        hits, items = [], set()
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= window:
                hits.append((i + 1 - window, i + 1))
                items |= self.owners[self.full[state]]
            for m, k in self.short[state]:
                if m <= matched:
                    hits.append((i + 1 - m, i + 1))
                    items.add(k)
        return hits, items


def item_words(text: bytes) -> list[bytes]:
    w = Words([text], ALNUM, lower=True)
    return [w.raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def scan(texts: list[bytes], au: SuffixAutomaton):
    """For each text: its number of words, hits (words [from, to) with their bytes [from, to)), items' names."""
    for a, b in slabs(texts):
        w = Words(texts[a:b], ALNUM, lower=True)
        hashes = w.hashes()
        found: list[list] = [[] for _ in range(b - a)]
        names: list[set] = [set() for _ in range(b - a)]
        if len(au.hashes) and len(hashes):
            head = np.zeros(len(hashes) + 1, bool)
            head[w.first[:-1]] = True
            base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
            at = np.minimum(np.searchsorted(au.hashes, hashes), len(au.hashes) - 1)
            ids = np.where(au.hashes[at] == hashes, au.ids[at], -1)
            joined = (ids[:-1] >= 0) & (ids[1:] >= 0) & ~head[1:-1]
            pair = ids[:-1] * len(au.vocabulary) + ids[1:]
            joined &= np.isin(pair, au.pairs) if len(au.pairs) else False
            lo = np.flatnonzero((ids >= 0) & ~np.append(False, joined))
            hi = np.flatnonzero((ids >= 0) & ~np.append(joined, False)) + 1
            long = hi - lo >= au.least
            for s, e in zip(lo[long].tolist(), hi[long].tolist()):
                words = [w.raw[x:y] for x, y in zip(w.start[s:e].tolist(), w.end[s:e].tolist())]
                run = [c if au.vocabulary[c] == x else -1 for c, x in zip(ids[s:e].tolist(), words)]  # exact words
                hits, items = au.stream(run)
                if hits:
                    doc = int(np.searchsorted(w.first, s, "right")) - 1
                    first, zero = int(w.first[doc]), int(base[doc])
                    found[doc] += [(s + x - first, s + y - first, int(w.start[s + x]) - zero,
                                    int(w.end[s + y - 1]) - zero) for x, y in hits]
                    names[doc] |= {au.names[k] for k in items}
        for d in range(b - a):
            yield int(w.first[d + 1] - w.first[d]), found[d], names[d]


def _merged(spans) -> list[dict]:
    """Union of intervals, in order; touching ones become one."""
    out: list[list] = []
    for x, y, a, b in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], y), max(out[-1][3], b)
        else:
            out.append([x, y, a, b])
    return [dict(zip(_SPAN, s)) for s in out]


_SPAN = ("from_word", "to_word", "from_byte", "to_byte")
_HITS_DDL = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<" + ",".join(
    f"{k}:bigint" for k in _SPAN) + ">>,items:array<string>>"
_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                   ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in _SPAN]))), ("items", pa.list_(pa.string()))])


def item_segments(bench: DataFrame, id: str, text: str, window: int, part_words: int) -> DataFrame:
    """(item, n, words): the items' words, normalised and joined by a space, each segment once.

    Segments overlap by ``window - 1`` words: each window of an item lies in one, and none but an
    item of fewer words is shorter than a window.
    """
    size = max(window, min(SEGMENT_WORDS, part_words))

    def cut(batches):
        for b in batches:
            rows = []
            for item, body in zip(*(c.to_pylist() for c in b.columns)):
                words = item_words(body)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, size - window + 1):
                    piece = words[at:at + size]
                    rows.append((item, len(piece), b" ".join(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.binary()))], ["item", "n", "words"])

    items = bench.select(F.col(f"`{id}`").cast("string").alias("item"), text_bytes(f"`{text}`").alias("body"))
    return items.where("item IS NOT NULL").mapInArrow(cut, "item string, n long, words binary").distinct()


def automata(segments: DataFrame, window: int, part_words: int) -> DataFrame:
    """(part, n, body): pickled automata of segments of at most ``part_words`` words together, each built in a
    task.  There are at most twice as many as need be, and one a task more."""
    def build(batches):
        def part(held, n, k):
            name = f"{TaskContext.get().partitionId()}-{k}"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([n], pa.int64()), pa.array([pickle.dumps(SuffixAutomaton(held, window))], pa.binary())],
                ["part", "n", "body"])

        held, n, k = [], 0, 0
        for b in batches:
            for item, m, words in zip(*(c.to_pylist() for c in b.columns)):
                if held and n + m > part_words:
                    yield part(held, n, k)
                    held, n, k = [], 0, k + 1
                held.append((item, words.split(b" ")))
                n += m
        if held:
            yield part(held, n, k)

    words = segments.agg(F.sum("n")).first()[0] or 0
    return segments.coalesce(max(1, -(-words // part_words))).mapInArrow(build, "part string, n long, body binary")


def _parts(bench: DataFrame, id: str, text: str, window: int, part_words: int):
    """The benchmark as broadcast automata, one at a time; at least one."""
    def sent(body):
        return bench.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, body))

    parts = stored(automata(stored(item_segments(bench, id, text, window, part_words)), window, part_words))
    names = sorted(r.part for r in parts.select("part").collect())   # a short name for each PART_WORDS words
    for name in names:
        yield sent(bytes(parts.where(F.col("part") == name).select("body").first().body))
    if not names:
        yield sent(pickle.dumps(SuffixAutomaton([], window)))


_LOADED: dict = {}


def _automaton(part) -> SuffixAutomaton:
    name, body = part.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(body)
    return _LOADED[name]


def benchmark_hits(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned): struct of n_words, n_hit, spans, items.

    One pass over the documents for each part of the benchmark; between passes the rows are
    stored, so that no executor holds more than one part.
    """
    prepare(docs.sparkSession)
    out = free_name(docs, "__hits")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(_HITS_DDL))])
    rows, last = docs, None
    for part in _parts(bench, item_id, item_text, window, part_words):
        if last is not None:
            rows = stored(rows)
            last.unpersist()
        last = part

        def run(batches, part=part):
            au = _automaton(part)
            for b in batches:
                texts = [t or b"" for t in b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
                i = b.schema.get_field_index(out)
                before = b.column(i).to_pylist() if i >= 0 else [None] * len(texts)
                hits = []
                for (n, spans, items), old in zip(scan(texts, au), before):
                    if old:
                        spans = spans + [tuple(s[k] for k in _SPAN) for s in old["spans"]]
                        items = items | set(old["items"])
                    spans = _merged(spans)
                    hits.append({"n_words": n, "n_hit": sum(s["to_word"] - s["from_word"] for s in spans),
                                 "spans": spans, "items": sorted(items)})
                columns = [c for j, c in enumerate(b.columns) if j != i]
                names = [f for j, f in enumerate(b.schema.names) if j != i]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, _HITS)], [*names, out])

        rows = rows.mapInArrow(run, schema)
    return rows, out


def contamination(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  coverage: int = COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans (word and byte positions, [from, to)),
    items (ids as strings, sorted), contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text lower-cased in A-Z.  A window is
    ``window`` consecutive words of an item, or a whole item of fewer words.  A word inside an
    occurrence of a window is hit.  contaminated: n_hit > 0 and coverage * n_hit >= n_words.
    Null and empty texts have no words; items without words or id own no window; repeated items
    count once; empty tables give no rows or no hits.  Other columns are not looked at.
    """
    rows, out = benchmark_hits(docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("text")), bench,
                               "text", item_id, item_text, window, part_words)
    got = [F.col(f"{out}.{c}").alias(c) for c in ("n_words", "n_hit", "spans", "items")]
    return rows.select(F.col("__id").alias(id), *got, _contaminated(out, coverage).alias("contaminated"))


def _contaminated(out: str, coverage: int):
    return (F.col(f"{out}.n_hit") > 0) & (F.lit(coverage) * F.col(f"{out}.n_hit") >= F.col(f"{out}.n_words"))


def decontaminate_filter(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW,
                         coverage: int = COVERAGE) -> DataFrame:
    """``docs`` less benchmark text, same columns: documents at or above the coverage limit go;
    from the others the hit spans are cut out of ``text``, the rest of which keeps its bytes.

    Null and empty texts stay; a document without hits keeps its very bytes.
    """
    rows, out = benchmark_hits(docs, bench, text, window=window)
    body, spans = F.col(f"`{text}`").cast("binary"), F.col(f"{out}.spans")
    lows = F.concat(F.array(F.lit(0).cast("long")), spans["to_byte"])
    highs = F.concat(spans["from_byte"], F.array(F.octet_length(F.col(f"`{text}`")).cast("long")))
    piece = lambda z: F.decode(F.substring(body, z["a"].cast("int") + 1, (z["b"] - z["a"]).cast("int")), "UTF-8")
    cut = F.array_join(F.transform(F.arrays_zip(lows.alias("a"), highs.alias("b")), piece), "")
    kept = rows.where(~_contaminated(out, coverage))
    return kept.withColumn(text, F.when(F.col(f"{out}.n_hit") > 0, cut).otherwise(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: hits of every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: DuckDB: windows joined as word strings.
OP9_SQL = r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT DISTINCT item, least(len(ws), 13) AS m, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
occ AS (SELECT doc_id, i, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS k
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, sizes WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i, occ.m, item FROM occ JOIN win ON occ.k = win.k AND occ.m = win.m),
words AS (SELECT doc_id, count(DISTINCT i + d) AS n_hit FROM hit, range(0, 13) t(d) WHERE d < m GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
