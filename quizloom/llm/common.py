"""Helpers shared by the operators of this subpackage.

Batches reach Python as Arrow tables holding texts as UTF-8 ``binary``, so nothing
is decoded that need not be, and word tables are built by numpy on the byte
buffer of a whole batch.  Every helper is a pure function of its input: a task
that is run again gives the same rows.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.session import checkpoint_dir

#: Rows and bytes in one Arrow batch: bounds a Python worker's memory when texts are long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Bytes of text hashed at once (a longer single text is hashed whole).
SLAB_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_B = 0x9E3779B97F4A7C15 | 1
_W = 0xC2B2AE3D27D4EB4F | 1

#: Bytes that separate words: space and \t \n \v \f \r (none is part of a longer UTF-8 character).
SPACE = np.ones(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes after lower-casing A-Z: digits, a-z, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Translation that lower-cases A-Z only.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the Python operators: bounded Arrow batches, a checkpoint folder."""
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but the files carry sizes and columns, so
    later plans prune them and choose joins by their real size.  The folder is removed
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "stored")
    df.write.parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A name for a new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's Python ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the cluster's own cleaning remains
        pass


def text_bytes(column: str = "text"):
    """The column as UTF-8 bytes; null gives empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def grown(b):
                a = np.full(max(n, 1 << 16), b, np.uint64)
                a[0] = 1
                return np.cumprod(a, dtype=np.uint64)
            self.up, self.down = grown(self.base), grown(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_B), Powers(_W)


class Words:
    """The words of some texts: ``buf`` (bytes), ``start``/``end`` into it, ``first`` (index of
    each text's first word; one longer than the texts)."""

    def __init__(self, texts: list[bytes], keep: np.ndarray = SPACE, lower: bool = False):
        self.raw = b"\n".join(texts) + b"\n"
        if lower:
            self.raw = self.raw.translate(LOWER)
        self.buf = np.frombuffer(self.raw, np.uint8)
        inside = keep[self.buf].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def hashes(self) -> np.ndarray:
        """64-bit polynomial hash of each word's bytes (through a table of random values)."""
        up, down = _BYTES.to(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def rolling(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of the ``size`` words from each position (``len - size + 1`` of them)."""
    n = len(word_hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def slabs(texts: list[bytes], size: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) ranges of ``texts`` of about ``size`` bytes, whole texts only."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def text_pieces(text: bytes, keep: np.ndarray = SPACE, size: int = SLAB_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut before a byte that ``keep`` has as no word byte."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and keep[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text
