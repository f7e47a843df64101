"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits recursively: a node projects its vectors on a random direction and sends
the lower part left and the upper part right; vectors in the band of ``SPILL`` of the rows on
either side of the median go to both, so near pairs are seldom parted.  A node's thresholds
come from a sample of at most about ``SAMPLE`` of its vectors (drawn by hash), every vector is
routed.  Vectors are stored once, in the width of their column; rounds write only which key is in
which node.  Rounds go on until no node that may be split holds more than ``LEAF`` vectors; each
round splits every large node by up to ``DEPTH`` levels, so the number of rounds grows with
log(rows).

Of some directions and cuts a node takes the one that parts the fewest near pairs of its sample.
Where at least ``DENSE`` of all the sample's pairs are near and the best cut still parts more
than ``PARTED`` of them, the node is not split: a large group of near vectors stays whole and is
compared in full, at a cost of at most about 1 / ``DENSE`` pairs for each near one.

Leaves compare all their vectors in double precision.  Across trees and through spill a pair
may meet several times; it counts where the first leaf that holds both is met, which the
vectors' lists of leaves tell, so no pairs are shuffled: a leaf gives each vector a number
and links that span what it found connected, both linear in its rows.

Skew: equal vectors are one node with their number.  A large leaf (a dense group, or equal
projections) is compared as pairs of blocks, each vector in about the square root of its size.  Near pairs may be missed, none below the
threshold is linked; tests measure the recall against brute force.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.common import mix, prepare, stored
from quizloom.llm.graph import connected_components

THRESHOLD = 0.95
TREES = 8
LEAF = 400
SPILL = 0.04
SAMPLE = 16_384
DEPTH = 9
ROUNDS = 12
#: Up to this many split nodes, their splits are sent to the vectors; beyond it, vectors go to their nodes.
FEW_NODES = 64
#: Rows of a node that are routed together.
PART = 20_000
#: A node of the sample is split while it has as many vectors.
LEAST_SAMPLE = 16
#: Vectors of a sample whose pairs are looked at, and the directions and cuts tried.
MEASURED = 1024
DIRECTIONS = 4
CUTS = (0.5, 0.4, 0.6, 0.3, 0.7)
#: What a cut off the median costs, as a share of the near pairs for a share of the rows.
UNEVEN = 0.1
#: A node with this share of near pairs isn't split where the best cut parts so many of them.
DENSE = 0.05
PARTED = 0.02
#: Most rows of a block, and rows compared at once in a large leaf.
BLOCK = 4096
ROWS_AT_ONCE = 512
#: Links of a leaf that are looked up one by one.
FEW_LINKS = 1 << 16


def component_type(rows: DataFrame, vector: str) -> str:
    """How vectors are stored: as floats if the column holds floats, else as doubles."""
    kind = rows.select(F.col(f"`{vector}`")).schema[0].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def packed_vectors(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): vectors as their components' bytes; v is null unless all components are finite and one isn't zero."""
    kind = component_type(rows, vector)

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                a = None
                if x and None not in x:
                    a = np.array(x, kind)
                    a = a.tobytes() if np.isfinite(a).all() and a.any() else None
                out.append(a)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "v"])

    array = "array<float>" if kind == "<f4" else "array<double>"
    picked = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(array).alias("v"))
    return picked.mapInArrow(run, "id long, v binary")


def _unit(blobs, kind: str) -> np.ndarray:
    """Rows of length one, in doubles.  Scaled first, so that very large and very small components don't overflow."""
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(node: int, size: int, number: int = 0) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([node & ((1 << 64) - 1), number])).standard_normal(size)


def _child(node: int, side: int) -> int:
    return int(mix(np.array([(node * 2 + side + 0x632BE59B) & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def _best_cut(node: int, x: np.ndarray, spill: float, threshold: float) -> tuple | None:
    """(low, high, direction's number) of the band that parts the fewest near pairs; None if the node is better left whole."""
    some = x[::-(-len(x) // MEASURED)]
    near = (some @ some.T >= threshold).astype(np.float32)
    np.fill_diagonal(near, 0)
    pairs = float(near.sum(dtype=np.float64))
    best = None
    for k in range(DIRECTIONS):
        d = _direction(node, x.shape[1], k)
        p, own = x @ d, some @ d
        bands = np.quantile(p, [c + e for c in CUTS for e in (-spill, spill)]).reshape(-1, 2)
        for c, (low, high) in zip(CUTS, bands):
            if (p <= high).all() or (p >= low).all():  # equal projections: no split
                continue
            parted = 2 * float((own < low) @ near @ (own > high)) / pairs if pairs else 0.0
            cost = parted + UNEVEN * abs(c - 0.5)
            if best is None or cost < best[0]:
                best = cost, parted, (float(low), float(high), k)
        if best and best[0] == 0:
            break
    if best is None or pairs >= DENSE * len(some) * (len(some) - 1) and best[1] > PARTED:
        return None
    return best[2]


def fit_splits(node: int, x: np.ndarray, levels: int, spill: float, threshold: float = THRESHOLD) -> dict[int, tuple[float, float, int]]:
    """(low, high, direction's number) of the band of each split node: under high goes left, over low goes right."""
    splits, level = {}, [(node, x)]
    for _ in range(levels):
        below = []
        for name, own in level:
            cut = _best_cut(name, own, spill, threshold) if len(own) >= LEAST_SAMPLE else None
            if cut is None:
                continue
            splits[name] = cut
            p = own @ _direction(name, own.shape[1], cut[2])
            below += [(_child(name, 0), own[p <= cut[1]]), (_child(name, 1), own[p >= cut[0]])]
        level = below
    return splits


def with_directions(splits: dict[int, tuple[float, float, int]], size: int) -> dict[int, tuple]:
    """(low, high, direction, children) of each split node."""
    return {k: (low, high, _direction(k, size, d), _child(k, 0), _child(k, 1)) for k, (low, high, d) in splits.items()}


def route(node: int, x: np.ndarray, splits: dict[int, tuple]) -> list[tuple[int, np.ndarray]]:
    """(leaf, indices) of the vectors below ``node``; a vector may be in several leaves."""
    out, todo = [], [(node, np.arange(len(x)))]
    while todo:
        name, own = todo.pop()
        if name not in splits:
            out.append((name, own))
            continue
        low, high, direction, left, right = splits[name]
        p = x[own] @ direction
        todo += [(to, part) for to, part in ((left, own[p <= high]), (right, own[p >= low])) if len(part)]
    return out


def _walked(rows: DataFrame, splits: dict[int, bytes], kind: str) -> DataFrame:
    """(node, key, id) below the few nodes of ``splits``: rows (key, id, v, roots) are routed where they lie."""
    def run(batches):
        held = {}
        for b in batches:
            lists = b.column("roots")
            nodes, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            for node in np.unique(nodes).tolist():
                if node not in splits:
                    continue
                own = row[nodes == node]
                x = _unit(b.column("v").take(pa.array(own)).to_pylist(), kind)
                if node not in held:
                    held[node] = with_directions(pickle.loads(splits[node]), x.shape[1])
                found = route(node, x, held[node])
                take = pa.array(own[np.concatenate([part for _, part in found])])
                names = np.concatenate([np.full(len(part), to) for to, part in found])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), b.column("key").take(take), b.column("id").take(take)],
                                                 ["node", "key", "id"])

    return rows.select("key", "id", "v", "roots").mapInArrow(run, "node long, key long, id long")


def _moved(rows: DataFrame, splits: DataFrame, kind: str) -> DataFrame:
    """The same for any number of nodes: rows (node, n, key, id, v) meet their node's splits in parts of about PART rows."""
    parts = splits.select("node", F.ceil(F.col("n") / PART).cast("long").alias("parts"), "splits")
    none = F.lit(None)
    dealt = rows.select("node", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / PART).cast("long")).alias("part"), F.lit(1).alias("kind"),
                        "key", "id", "v", none.cast("binary").alias("splits"))
    heads = parts.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                         none.cast("long").alias("key"), none.cast("long").alias("id"), none.cast("binary").alias("v"), "splits")

    def run(batches):
        raw = held = None
        for b in batches:
            node, which = b.column("node").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (which[1:] != which[:-1]))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(node)]):
                if which[lo] == 0:
                    raw, held = pickle.loads(b.column("splits")[lo].as_py()), None
                    continue
                x = _unit(b.column("v").slice(lo, hi - lo).to_pylist(), kind)
                held = held or with_directions(raw, x.shape[1])
                found = route(int(node[lo]), x, held)
                take = pa.array(np.concatenate([own for _, own in found]) + lo)
                names = np.concatenate([np.full(len(own), to) for to, own in found])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), b.column("key").take(take), b.column("id").take(take)],
                                                 ["node", "key", "id"])

    return heads.unionByName(dealt).repartition("node", "part").sortWithinPartitions("node", "part", "kind").mapInArrow(
        run, "node long, key long, id long")


def _forest(nodes: DataFrame, kind: str, trees: int, leaf: int, spill: float, threshold: float) -> DataFrame:
    """(node, key, id): every vector of ``nodes`` (key, id, v, w, size) in its leaves of every tree.

    Only keys go from round to round.  Vectors come to the sample of a node and to its routing; where few
    nodes are split, the splits (``2 ** DEPTH`` numbers a node at most) go to the vectors instead.
    """
    roots = F.array(*[F.xxhash64(F.lit(t), "size") for t in range(trees)])  # sizes never mix
    at = nodes.select(F.explode(roots).alias("node"), "key", "id")
    vectors = nodes.select("key", "v")
    here = nodes.select("key", "id", "v", roots.alias("roots"))
    shrink = math.log(1 / (0.5 + spill))
    leaves = []
    for _ in range(ROUNDS):
        large = stored(at.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > leaf))
        drawn = at.join(large, "node").where(F.pmod(F.xxhash64("id", "node"), F.lit(1 << 30)) < (1 << 30) * F.least(
            F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))).select("node", "n", "key").join(vectors, "key")

        def fit(key, table):
            node, n = key[0].as_py(), table.column("n")[0].as_py()
            levels = min(DEPTH, max(1, math.ceil(math.log(n / (0.6 * leaf)) / shrink)))
            splits = fit_splits(node, _unit(sorted(table.column("v").to_pylist()), kind), levels, spill, threshold)
            some = [node] if splits else []
            return pa.table({"node": pa.array(some, pa.int64()), "n": pa.array([n] * len(some), pa.int64()),
                             "splits": pa.array([pickle.dumps(splits)] * len(some), pa.binary())})

        splits = stored(drawn.groupBy("node").applyInArrow(fit, "node long, n long, splits binary"))
        number = splits.count()
        if not number:
            break
        leaves.append(stored(at.join(splits, "node", "left_anti")))  # a node that isn't split now never will be
        if number <= FEW_NODES:
            if here is None:
                here = at.join(splits, "node", "left_semi").groupBy("key").agg(
                    F.first("id").alias("id"), F.collect_list("node").alias("roots")).join(vectors, "key")
            moved = _walked(here, {r.node: bytes(r.splits) for r in splits.collect()}, kind)
        else:
            moved = _moved(at.join(splits.select("node", "n"), "node").join(vectors, "key"), splits, kind)
        at, here = stored(moved), None
    for own in leaves:
        at = at.unionByName(own)
    return at


def _spans(near: np.ndarray, cut: int = 0) -> np.ndarray:
    """Smallest index that each row reaches over a symmetric matrix of links (cut > 0: links of [:cut] with [cut:])."""
    n = len(near) + (near.shape[1] if cut else 0)
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, len(near), ROWS_AT_ONCE):
            own = near[a:a + ROWS_AT_ONCE]
            rows = slice(a, a + len(own))
            new[rows] = np.minimum(new[rows], np.where(own, label[None, cut:], n).min(axis=1, initial=n))
            if cut:
                new[cut:] = np.minimum(new[cut:], np.where(own, label[rows, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met_before(leaves: np.ndarray, name: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether i and j share a leaf of a smaller name (rows of ``leaves``: sorted, filled up with ``name``)."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 14):
        p, q = leaves[i[a:a + (1 << 14)]], leaves[j[a:a + (1 << 14)]]
        seen = np.zeros(len(p), bool)
        for k in range(p.shape[1]):
            own = p[:, k]
            if not (own < name).any():
                break
            seen |= (own < name) & (q == own[:, None]).any(axis=1)
        out[a:a + (1 << 14)] = seen
    return out


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are near each other."""
    near = np.empty((len(x), len(y)), bool)
    for a in range(0, len(x), ROWS_AT_ONCE):
        product = x[a:a + ROWS_AT_ONCE] @ y.T
        own = near[a:a + ROWS_AT_ONCE]
        own[:] = product >= threshold
        for i, j in zip(*np.nonzero(np.abs(product - threshold) < 1e-9)):  # too near to call: the sum of products decides
            own[i, j] = float(np.dot(x[a + i], y[j])) >= threshold
    return near


def _classes(leaves: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, classes x leaves): rows in the same smaller leaves are one class."""
    lists, which = np.unique(leaves, axis=0, return_inverse=True)
    known, at = np.unique(lists, return_inverse=True)
    at = at.reshape(lists.shape)
    member = np.zeros((len(lists), len(known)), np.float32)
    np.put_along_axis(member, at, 1, axis=1)
    return which.reshape(-1), member[:, known < name]


def _leaf_links(ids, weights, x, leaves, name, cut, threshold):
    """Weighted numbers of links and spanning links of a leaf (cut > 0: only across [:cut] and [cut:])."""
    n = len(ids)
    one, two = (slice(0, cut), slice(cut, n)) if cut else (slice(0, n), slice(0, n))
    if n > ROWS_AT_ONCE:  # rows that have met all others before have no new links
        which, member = _classes(leaves, name)
        met = lambda a, b: (member[np.unique(which[a])] @ member[np.unique(which[b])].T > 0).all(axis=1)
        fresh = np.zeros(n, bool)
        for a, b in ((one, two), (two, one)):
            fresh[a] |= ~met(a, b)[np.searchsorted(np.unique(which[a]), which[a])]
        keep = np.flatnonzero(fresh)
        if len(keep) < n:
            if not len(keep):
                return np.zeros(n, np.int64), [], []
            inner, a, b = _leaf_links(ids[keep], weights[keep], x[keep], leaves[keep], name,
                                      int((keep < cut).sum()), threshold)
            found = np.zeros(n, np.int64)
            found[keep] = inner
            return found, a, b
    near = _near(x[one], x[two], threshold)
    if not cut:
        np.fill_diagonal(near, False)
    found = np.zeros(n)
    if np.count_nonzero(near) <= FEW_LINKS:
        i, j = np.nonzero(near if cut else np.triu(near))
        j = j + cut
        first = ~_met_before(leaves, name, i, j)
        i, j = i[first], j[first]
        found += np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)
    else:
        which, member = _classes(leaves, name)
        for a in range(0, len(near), ROWS_AT_ONCE):
            rows = slice(a, min(a + ROWS_AT_ONCE, len(near)))
            own, like = np.unique(which[rows], return_inverse=True)
            first = (near[rows] & ~(member[own] @ member.T > 0)[like.reshape(-1)[:, None], which[two]]).astype(np.float64)
            found[rows] += first @ weights[two]
            if cut:
                found[two] += weights[rows] @ first
    label = _spans(near, cut)
    far = np.flatnonzero(label != np.arange(n))
    return np.rint(found).astype(np.int64), ids[far].tolist(), ids[label[far]].tolist()


def leaf_links(forest: DataFrame, nodes: DataFrame, kind: str, leaf: int, threshold: float) -> DataFrame:
    """(u, v, n): rows with v = null say that the vector of key u has n (weighted) links, the others are spanning links of ids."""
    crowded = forest.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 4 * leaf).select(
        "node", F.ceil(F.greatest(F.sqrt(F.col("n") / leaf), F.col("n") / BLOCK)).cast("long").alias("blocks"))
    none = F.lit(0).cast("long")
    # a vector is in at most a few leaves of each tree; it joins its list of them once and goes to each from there
    lists = forest.join(crowded, "node", "left").groupBy("key").agg(
        F.collect_list("node").alias("leaves"), F.collect_list(F.struct("node", F.coalesce("blocks", none).alias("blocks"))).alias("places"))
    own = F.pmod(F.xxhash64("key"), F.greatest("blocks", F.lit(1)))
    pairs = F.transform(F.sequence(none, F.col("blocks") - 1),
                        lambda b: F.shiftleft(F.least(b, own), 32).bitwiseOR(F.greatest(b, own)))
    dealt = (nodes.join(lists, "key").select("key", "id", "w", "v", "leaves", F.inline("places"))
             .withColumn("own", F.when(F.col("blocks") == 0, none).otherwise(own))
             .withColumn("block", F.explode(F.when(F.col("blocks") == 0, F.array(none)).otherwise(pairs)))
             .select("node", "block", "own", "key", "id", "w", "v", "leaves"))

    def run(key, table):
        name, block = key[0].as_py(), key[1].as_py()
        lo = block >> 32
        own = table.column("own").to_numpy()
        order = np.argsort(own != lo, kind="stable")
        table = table.take(pa.array(order))
        cut = int((own == lo).sum()) if lo != (block & 0xFFFFFFFF) else 0
        ids, w = table.column("id").to_numpy(), table.column("w").to_numpy()
        keys, u, v, n = table.column("key").to_numpy(), ids, [None] * len(ids), np.zeros(len(ids), np.int64)
        if cut < len(ids):
            lists = table.column("leaves").combine_chunks()
            size = lists.value_lengths().to_numpy()
            leaves = np.full((len(size), int(size.max())), name, np.int64)
            leaves[np.arange(leaves.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
            leaves = np.sort(np.where(leaves < name, leaves, name), axis=1)
            n, a, b = _leaf_links(ids, w, _unit(table.column("v").to_pylist(), kind), leaves, name, cut, threshold)
            u, v, n = [*keys[n > 0], *a], [None] * int((n > 0).sum()) + b, [*n[n > 0], *[0] * len(a)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("node", "block").applyInArrow(run, "u long, v long, n long")


def vector_groups(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                  trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept.

    n_links: other vectors found at cosine >= ``threshold``; component_id: the smallest id
    reachable by links; kept: it is the row's own.  Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, and neither do vectors of different
    lengths.  Equal vectors link with each other.  Ids are longs; repeated rows are separate
    vectors of one id; a null id keeps its row and counts as a link of others, but names no
    component unless no other id is there.  An empty table gives no rows.
    """
    prepare(rows.sparkSession)
    table = stored(packed_vectors(rows, id, vector))
    kind = component_type(rows, vector)
    nodes = stored(table.where("v IS NOT NULL").groupBy("v").agg(
        F.coalesce(F.min("id"), F.min(F.xxhash64("v"))).alias("id"), F.count("*").alias("w")).select(
        F.monotonically_increasing_id().alias("key"), "id", "v", "w", F.octet_length("v").alias("size")))
    forest = _forest(nodes, kind, trees, leaf, spill, threshold)
    links = stored(leaf_links(forest, nodes, kind, leaf, threshold))
    numbers = links.where("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    found = connected_components(links.where("v IS NOT NULL").select("u", "v"))
    label = nodes.join(numbers, "key", "left").join(
        found, nodes.id == found.node, "left").select(
        "v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return table.join(label, "v", "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links and groups of all embeddings, whatever their labels."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
