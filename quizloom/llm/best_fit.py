"""Best-fit packing: token pieces of documents into as few sequences as they need, merged up a tree.

1. Texts become ids of a byte-level BPE vocabulary and an end id; documents over the capacity
   are cut into full pieces, the first of which takes the rest.  The pieces are written, with
   a number each, so that later rounds agree on them whatever task is run again.
2. Full pieces are sequences.  The others are dealt over nodes of about ``NODE_ITEMS`` by
   their numbers; a node packs them best-fit, longest first.
3. Bins that lack ``SLACK`` tokens or fewer are done.  The underfull bins of neighbouring nodes
   meet in one node of the next level, where each bin is an item, and are packed again, up
   to the root.
4. The levels are joined from the root down: an item's place is its bin's place and its own.

In a best-fit packing at most one bin of a node is at most half full, and only such a bin can
move into another one.  Where the underfull bins of two nodes are more than a node takes, those
over half full are done too, and the others go up alone: one for each node at most.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import prepare, slabs, stored, text_bytes

CAPACITY = 1024
END_ID = 2
#: Items packed in one task, and the most tokens that a finished bin may lack.
NODE_ITEMS = 131072
SLACK = 16
#: Keys that a worker remembers, for each of two generations.
REMEMBERED = 900_000

# A pre-token of the vocabulary ends where white space begins, and where a letter meets an ASCII
# mark, whatever follows: texts may be cut there and encoded unit by unit.
_RISKY = re.compile(r"\s | \s|<\|")
_AT_SPACE = re.compile(r"(?<=\S)(?= )")
#: Letters and then marks: one pre-token each.
_SHAPE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by a vocabulary file of the ``tokenizers`` library, as little-endian 32-bit bytes.

    The ids are the library's for the whole text.  Texts are cut where no pre-token crosses.  The
    library's model gets new words of many texts at once (each begins with the vocabulary's sign for a
    space, which tells them apart in the answer), the whole library gets every unit of another
    kind.  Answers are remembered in two generations of a bounded number.  A special token's
    string gives its id, as the library has it by default.
    """

    def __init__(self, path: str, size: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split
        self.tokenizer, self.size = Tokenizer.from_file(path), size
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Split(" ", "removed")
        letters = byte_letters()
        self.spell = letters | {0x0A: " "}
        ids = range(self.tokenizer.get_vocab_size())
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(letters[0x20]) for i in ids])
        self.young: dict[str, bytes] = {}  # by the word that follows a space
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _spelt(self, words: list[str]) -> Iterator[bytes]:
        """Ids of a space and a word, for words of one pre-token each."""
        spelt = "\n".join([" " + w for w in words]).encode().decode("latin-1").translate(self.spell)
        ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
        at = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
        data, at = ids.tobytes(), at.tolist()
        return (data[x:y] for x, y in zip(at, at[1:]))

    def _run(self, marks: str) -> bytes:
        """Ids of a run of ASCII marks after a letter."""
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]

    def _learn(self, words: set[str]) -> None:
        """Makes ``young`` hold these words too."""
        young, old, single, ended = self.young, self.old, {}, []
        for w in words:
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
            elif w.isascii() and w.isalpha():
                single[w] = None
            elif not (shape := _SHAPE.fullmatch(w)):
                young[w] = self.whole(" " + w)
            elif shape[1] and shape[2]:
                ended.append((w, *shape.groups()))
                if shape[1] not in young:
                    single[shape[1]] = None
            else:
                single[w] = None
        if single:
            young.update(zip(single, self._spelt(list(single))))
        for w, letters, marks in ended:
            young[w] = young[letters] + self._run(marks)

    def __call__(self, texts: list[str]) -> list[bytes]:
        heads, words, odd = [], [], {}
        for i, t in enumerate(texts):
            if _RISKY.search(t):
                head, *rest = _AT_SPACE.split(t)
                odd[i] = [_RISKY.search(w) or w[-1].isspace() for w in rest]
                rest = [w if o else w[1:] for w, o in zip(rest, odd[i])]
            else:
                head, *rest = t.split(" ")
            heads.append(head)
            words.append(rest)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        plain = (([w for w, o in zip(ws, odd[i]) if not o] if i in odd else ws) for i, ws in enumerate(words))
        self._learn(set(chain.from_iterable(plain)).difference(self.young))
        get, out = self.young.__getitem__, []
        for i, (head, ws) in enumerate(zip(heads, words)):
            ids = [self.whole(w) if o else get(w) for w, o in zip(ws, odd[i])] if i in odd else map(get, ws)
            out.append(self.whole(head) + b"".join(ids))
        return out


def text_slices(text: str, size: int = 1 << 18) -> Iterator[str]:
    """``text`` in slices of about ``size`` characters, cut where a unit begins."""
    at = 0
    while len(text) - at > size:
        cut = _AT_SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


_ENCODERS: dict[str, Encoder] = {}


def encode(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of texts of any length, one after the other."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    encoder = _ENCODERS[path]
    for a, b in slabs(texts):
        if b - a > 1:
            yield from encoder(texts[a:b])
        else:
            yield b"".join([encoder([s])[0] for s in text_slices(texts[a])])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full, but for the first."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32 (of the little-endian 32-bit ids)."""
    prepare(docs.sparkSession)
    names = ["doc", "piece", "start", "length", "ids_crc32"]
    docs = docs.select(F.col(f"`{id}`").alias("doc"), text_bytes(f"`{text}`").alias("body"))
    kind = docs.schema["doc"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which = [], []
            texts = [str(body.as_py(), "utf-8", "replace") for body in batch.column("body")]
            for i, ids in enumerate(encode(tokenizer, texts)):
                ids += end
                for p, (a, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((p, a, n, zlib.crc32(ids[4 * a:4 * (a + n)])))
                    which.append(i)
            piece, start, length, crc = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return docs.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: longest first, each into the bin that it leaves least room in."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    any_with, made = 0, 0  # bit r: a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = any_with >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                any_with ^= 1 << r
        else:
            r, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - r
        room[r - s].append(b)
        any_with |= 1 << r - s
    return bins, offsets


def _packed(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """(item, size, node) packed node by node: item, bin, offset, node, fill (the bin's), first (one row a bin)."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        sizes = table.column("size").to_pylist()
        node = table.column("node")[0].as_py()
        bins, offsets = best_fit(sizes, capacity)
        b = np.array(bins)
        fill = np.bincount(b, weights=sizes).astype(np.int64)
        first = np.zeros(len(b), bool)
        first[np.unique(b, return_index=True)[1]] = True
        return pa.table({"item": table.column("item"), "bin": pa.array((level << 56) + (node << 24) + b),
                         "offset": pa.array(offsets, pa.int64()), "node": table.column("node"),
                         "fill": pa.array(fill[b]), "first": pa.array(first)})

    return items.groupBy("node").applyInArrow(
        pack, "item long, bin long, offset long, node long, fill long, first boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, node_items: int = NODE_ITEMS, slack: int = SLACK) -> DataFrame:
    """(item, size) with distinct items and sizes under ``capacity``: item, bin, offset."""
    count = items.count()
    nodes = -(-count // node_items)
    if not count:
        return items.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    items = items.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes)))
    levels = []
    while True:
        levels.append(stored(_packed(items, len(levels), capacity)))
        if nodes == 1:
            break
        open_ = levels[-1].where(F.col("first") & (F.col("fill") < capacity - slack))
        half = F.col("fill") <= capacity // 2
        under, low = open_.agg(F.count("*"), F.count(F.when(half, 1))).first()
        if low < 1:
            break
        hosts = 2 * under <= node_items * nodes
        fan = max(2, node_items * nodes // (under if hosts else low))
        items = open_.where(F.lit(hosts) | half).select(
            F.col("bin").alias("item"), F.col("fill").alias("size"), F.floor(F.col("node") / fan).alias("node"))
        nodes = -(-nodes // fan)
    place = levels[-1].select("item", "bin", "offset")
    for level in reversed(levels[:-1]):
        up = place.select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("offset").alias("shift"))
        place = level.select("item", "bin", "offset").join(up, "bin", "left").select(
            "item", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return place


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     id: str = "doc_id", text: str = "text", node_items: int = NODE_ITEMS, slack: int = SLACK) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; a null or empty text is the end id
    alone.  A document of ``capacity`` ids or fewer is one piece; of a longer one all pieces are
    full but the first.  Pieces fill a sequence from 0 without gaps.  Repeated rows and rows without
    an id are documents of their own; of pieces of one length, any may come first.  Texts of any
    length are encoded whole.  An empty table gives no rows; other columns are not looked at.
    ``tokenizer`` is a vocabulary file that every executor can read.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, id, text)
                    .withColumn("item", F.monotonically_increasing_id()))
    short = F.col("length") < capacity
    places = pack(pieces.where(short).select("item", F.col("length").alias("size")), capacity, node_items, slack)
    whole = pieces.where(~short).withColumn("bin", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    columns = [F.col("doc").alias(id), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return pieces.where(short).join(places, "item").select(*columns).unionByName(whole.select(*columns))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ``best_fit_packing`` of all documents with the public byte-level vocabulary."""
    import public_tokenizers
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                            public_tokenizers.path("byte_bpe_50k.json"))
