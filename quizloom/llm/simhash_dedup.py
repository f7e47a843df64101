"""SimHash near-dedup with pigeonring filtering.

Fingerprints: 64 bits, one XXH64 per shingle.  Two fingerprints within ``distance`` 4 bits
are cut into five segments set in a ring (13, 13, 13, 13 and 12 bits).  The pigeonring
principle (Qin and Xiao, 2018) says that some segment starts a chain in which, for every
length l, the first l segments differ in at most l * 4 / 5 bits together: 0, 1, 2, 3, 4.
So the start is equal and the next segment differs in one bit at most, which leaves one of
its halves equal: each fingerprint gets ten keys (start, its bits, one half of the next).
Pairs that meet under a key are put to the whole chain's budgets, and only those that pass
to the full Hamming distance.

Skew: equal fingerprints are one node with the smallest id, whatever their number.  A key
met by more than ``BLOCK`` fingerprints is dealt as pairs of blocks, so no task holds more
than two blocks of it.  A block pair gives links that span what it found connected, not all
pairs of it, so the links are linear in the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import LOWER, free_name, prepare, stored, text_bytes
from quizloom.llm.graph import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 4096


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 1`` segments that cover 64 bits."""
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """One uint64 per text: bit set if set in over half the shingles' hashes, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        words = t.translate(LOWER).split()
        n = len(words)
        if not n:
            continue
        flat = b" ".join(words)
        if n <= shingle:
            out[i] = digest(flat, SEED)
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = end - size
        h = np.fromiter([digest(flat[a:b], SEED) for a, b in zip(start[:n - shingle + 1].tolist(),
                                                                 end[shingle - 1:].tolist())], np.uint64, n - shingle + 1)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 8192):
            part = np.unpackbits(h[a:a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += part.sum(axis=0, dtype=np.int64)
        out[i] = (weights * (2 * ones > len(h))).sum(dtype=np.uint64)
    return out


def fingerprint_table(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    def run(batches):
        for b in batches:
            f = fingerprints(b.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _ring_budgets(x: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the chain from ``start`` keeps every cumulative budget (x: XOR of the pair)."""
    ring = segments(distance)
    m = len(ring)
    diff = np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in ring]).astype(np.int16)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int16)
    cols = np.arange(len(x))
    for length in range(1, m + 1):
        total = total + diff[(start + length - 1) % m, cols]
        ok &= total * m <= length * distance
    return ok


def _block_links(fp: np.ndarray, start: int, cut: int, distance: int) -> list[tuple[int, int]]:
    """Index links that span what is connected among ``fp``; cut > 0: only pairs across [:cut] and [cut:]."""
    n = len(fp)
    label = np.arange(n)
    links = []
    for i in range(cut or n - 1):
        low = cut or i + 1
        x = fp[low:] ^ fp[i]
        near = np.flatnonzero(_ring_budgets(x, np.full(len(x), start), distance)) + low
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _links_of(key, block, fp, node, distance, n_blocks):
    """Links of whole groups (rows sorted by key and block pair): small groups by offset, large by row."""
    same = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    size = np.diff(np.append(same, len(key)))
    start = (key >> 60) & 15
    u, v = [], []
    small = np.repeat(size <= 64, size) & (n_blocks == 0)
    group = np.repeat(np.arange(len(same)), size)
    for d in range(1, int(size[size <= 64].max(initial=1))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[:-d])
        if not len(i):
            break
        x = fp[i] ^ fp[i + d]
        ok = _ring_budgets(x, start[i], distance)
        ok &= np.bitwise_count(x) <= distance
        u.append(node[i[ok]])
        v.append(node[i[ok] + d])
    for s, n in zip(same[(size > 64) | (n_blocks[same] > 0)].tolist(), size[(size > 64) | (n_blocks[same] > 0)].tolist()):
        rows = slice(s, s + n)
        f, g = fp[rows], node[rows]
        lo, hi = int(block[s]) >> 32, int(block[s]) & 0xFFFFFFFF
        cut = 0
        if lo != hi:
            own = (g % n_blocks[s]) if n_blocks[s] else np.zeros(n, np.int64)
            order = np.argsort(own != lo, kind="stable")
            f, g, cut = f[order], g[order], int((own == lo).sum())
            if cut in (0, n):
                continue
        for i, j in _block_links(f, int(start[s]), cut, distance):
            u.append(g[i:i + 1])
            v.append(g[j:j + 1])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(u), join(v)


def near_links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``nodes`` (fp long, node long; fp distinct) -> (u, v): links whose components are those of
    all pairs of fingerprints within ``distance`` bits."""
    ring = segments(distance)
    m = len(ring)

    def bits(shift, width):
        return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i, (s, w) in enumerate(ring):
        s2, w2 = ring[(i + 1) % m]
        low = w2 // 2
        for half, (hs, hw) in enumerate([(s2, low), (s2 + low, w2 - low)]):
            keys.append(F.lit(i << 60).bitwiseOR(F.lit(half << 56)).bitwiseOR(F.shiftleft(bits(s, w), 28))
                        .bitwiseOR(bits(hs, hw)))
    keyed = nodes.withColumn("key", F.explode(F.array(*keys)))
    crowded = (keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
               .select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks")))
    own = F.pmod("node", "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda b: F.shiftleft(F.least(b, own), 32).bitwiseOR(F.greatest(b, own)))
    dealt = (keyed.join(crowded, "key", "left")
             .withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long")))
                                            .otherwise(pairs)))
             .select("key", "block", "fp", "node", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks")))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches):
        held = None
        def links(t):
            c = [t.column(k).to_numpy() for k in ("key", "block", "fp", "node", "blocks")]
            u, v = _links_of(c[0], c[1], c[2].view(np.uint64), c[3], distance, c[4])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            k, bl = held.column("key").to_numpy(), held.column("block").to_numpy()
            last = np.flatnonzero((k != k[-1]) | (bl != bl[-1]))
            if len(last):
                cut = int(last[-1]) + 1
                yield links(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield links(held)

    return dealt.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, fp (the fingerprint's bits as a long), component_id.

    Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingled; fewer
    words than a shingle give one hash of all of them; null and empty texts give fingerprint
    zero and link like any other.  component_id is the smallest id reachable by links; ids are
    longs, and rows that share an id and a text are alike.  A null id keeps its row: it takes the
    component of its fingerprint (null if no row of that fingerprint has an id).  An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    table = stored(fingerprint_table(docs, id, text, shingle))
    nodes = stored(table.groupBy("fp").agg(F.min("id").alias("node")).where("node IS NOT NULL"))
    links = near_links(nodes, distance)
    found = connected_components(near_links(nodes, distance))
    label = nodes.join(found, nodes.node == found.node, "left").select(
        "fp", F.coalesce("component", nodes.node).alias("component_id"))
    return table.join(label, "fp", "left").select(F.col("id").alias(id), "fp", "component_id")


def simhash_filter(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   distance: int = DISTANCE) -> DataFrame:
    """``docs`` without near copies, same columns: of each group the row with the smallest id stays.

    Repeated rows (same id, same text) are one document.  Rows without an id can't be told from
    others by it and stay.
    """
    groups = simhash_groups(docs, id, text, shingle, distance)
    drop = groups.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("__drop")).distinct()
    kept = docs.join(drop, F.col(f"`{id}`") == F.col("__drop"), "left_anti")
    same, lone = free_name(docs, "__same"), free_name(docs, "__lone")
    kept = kept.withColumn(same, F.xxhash64(F.col(f"`{text}`"))).withColumn(
        lone, F.when(F.col(f"`{id}`").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([id, same, lone]).drop(same, lone)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                       "component_id")
