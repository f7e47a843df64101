"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

1. Rows are dealt over chunks of about ``CHUNK_BYTES`` of text by a hash of the row.
2. Each chunk hashes every window of ``size`` words and sends its distinct hashes, sorted
   and delta-coded, to buckets (the leading bits of the hash), with a mark on those that
   start more than once within the chunk.
3. Each bucket counts: a hash is repeated if it is marked or arrives from two chunks.  The
   answer goes back as one bit for each hash sent.
4. Each chunk hashes its windows again (the text exchange is reused), marks the words that
   repeated windows cover and merges them into maximal intervals.

A bucket holds each hash once per chunk, whatever the skew of the texts: a passage in a
third of all documents costs one entry per chunk.  The text is shuffled once, hashes once
at five to six bytes each.  Equal 64-bit hashes count as equal windows: among n windows a
unique one is taken for repeated with probability n / 2**64 (5e-7 at 1e13 words).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.common import SPACE, Words, free_name, prepare, rolling, slabs, text_bytes

WINDOW = 35
CHUNK_BYTES = 4 << 20


def _packed(h: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences: the empty upper planes compress away."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def window_hashes(texts: list[bytes], size: int):
    """For each text its window hashes, as one array, and the number of words and windows of each text."""
    hashes, n_words, n_windows = [], [], []
    for a, b in slabs(texts):
        w = Words(texts[a:b], SPACE)
        count = np.diff(w.first)
        roll = rolling(w.hashes(), size)
        own = np.maximum(count - size + 1, 0)
        if len(roll):
            at = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            hashes.append(roll[at])
        n_words.append(count)
        n_windows.append(own)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hashes, np.uint64), join(n_words, np.int64), join(n_windows, np.int64)


def _edges(distinct: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in sorted hashes and the bounds of each."""
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
    names, at = np.unique(bucket, return_index=True)
    return names, np.append(at, len(distinct))


def _text_list(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def repeated_spans(docs: DataFrame, size: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   text: str = "text") -> tuple[DataFrame, str]:
    """Internal: ``docs`` with a struct column (its name is returned) of n_words, n_removed,
    ``spans`` (kept-out word intervals [from, to)) and ``kept_text``."""
    spark = prepare(docs.sparkSession)
    chunk, body, out = free_name(docs, "__chunk"), free_name(docs, "__bytes"), free_name(docs, "__dedup")
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    bits = max(1, math.ceil(math.log2(max(2, total / chunk_bytes))) + 1)
    names = docs.columns
    dealt = (docs.withColumn(chunk, F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names]),
                                           F.lit(chunks)))
             .withColumn(body, text_bytes(text)))
    dealt = dealt.select(*[F.col(f"`{c}`") for c in names if c != text], chunk, body)

    def send(key, table):
        found, *_ = window_hashes(_text_list(table, body), size)
        distinct, times = np.unique(found, return_counts=True)
        names, at = _edges(distinct, bits)
        return pa.table({
            "bucket": pa.array(names, pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(names), pa.int64()),
            "hashes": pa.array([_packed(distinct[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
            "twice": pa.array([np.packbits(times[a:b] > 1).tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    def count(key, table):
        sent = [_unpacked(x) for x in table.column("hashes").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool)
                 for x, s in zip(table.column("twice").to_pylist(), sent)]
        every, which, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        again = times > 1
        again[which[np.concatenate(twice)]] = True
        bounds = np.cumsum([0] + [len(s) for s in sent])
        marks = [np.packbits(again[which[a:b]]).tobytes() for a, b in zip(bounds, bounds[1:])]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"),
                         "marks": pa.array(marks, pa.binary())})

    extra = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                          T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                          T.StructField("kept_text", T.StringType())])

    def remove(key, table, marks):
        texts = _text_list(table, body)
        found, n_words, n_windows = window_hashes(texts, size)
        distinct, which = np.unique(found, return_inverse=True)
        again = np.zeros(len(distinct), bool)
        names, at = _edges(distinct, bits)
        by = dict(zip(marks.column("bucket").to_pylist(), marks.column("marks").to_pylist()))
        for name, a, b in zip(names.tolist(), at, at[1:]):
            again[a:b] = np.unpackbits(np.frombuffer(by[name], np.uint8), count=b - a)
        again = again[which]
        rows, start = [], np.concatenate([[0], np.cumsum(n_windows)])
        for i, t in enumerate(texts):
            hit = np.flatnonzero(again[start[i]:start[i + 1]])
            words = t.split()
            spans = []
            if len(hit):
                gap = np.flatnonzero(np.diff(hit) > size)
                lows, highs = hit[np.append(0, gap + 1)], hit[np.append(gap, len(hit) - 1)] + size
                spans = [[int(a), int(b)] for a, b in zip(lows, highs)]
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
            else:
                kept = words
            rows.append({"n_words": len(words), "n_removed": len(words) - len(kept), "spans": spans,
                         "kept_text": b" ".join(kept).decode("utf-8", "replace")})
        kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()),
                          ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())])
        return table.drop_columns([chunk, body]).append_column(out, pa.array(rows, kind))

    sent = dealt.groupBy(chunk).applyInArrow(send, "bucket long, chunk long, hashes binary, twice binary")
    marks = sent.groupBy("bucket").applyInArrow(count, "bucket long, chunk long, marks binary")
    schema = T.StructType([f for f in dealt.schema.fields if f.name not in (chunk, body)]
                          + [T.StructField(out, extra)])
    return dealt.groupBy(chunk).cogroup(marks.groupBy("chunk")).applyInArrow(remove, schema), out


def substring_dedup(docs: DataFrame, size: int = WINDOW, text: str = "text", id: str = "doc_id",
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans, kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``size``
    words that covers it has a word sequence that starts anywhere else as well, judged on
    the input.  Null and empty texts have no words (0, 0, [], '').  Texts under ``size`` words
    have no window and are kept.  Repeated rows count as separate texts, so both lose what
    they share.  Kept words are joined by one space.  An empty table gives no rows; other
    columns are not looked at.
    """
    found, out = repeated_spans(docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("text")),
                                size, chunk_bytes)
    return found.select(F.col("__id").alias(id), *[F.col(f"{out}.{c}").alias(c)
                                                   for c in ("n_words", "n_removed", "spans", "kept_text")])


def substring_dedup_filter(docs: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with every repeated window's words taken out of ``text``, same columns and order.

    A text that loses nothing keeps its very bytes; one that loses words keeps the rest
    joined by one space; one that loses all its words goes.  Null and empty texts stay.
    """
    found, out = repeated_spans(docs.withColumn(raw := free_name(docs, "__raw"), F.col(text)), size, text=raw)
    keep = found.where((F.col(f"{out}.n_removed") == 0) | (F.col(f"{out}.n_removed") < F.col(f"{out}.n_words")))
    return keep.withColumn(text, F.when(F.col(f"{out}.n_removed") > 0, F.col(f"{out}.kept_text"))
                           .otherwise(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of what ``substring_dedup`` keeps of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
        F.size("spans").cast("long").alias("n_spans"))


#: DuckDB: windows as word lists, counted over the whole table.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM win SEMI JOIN rep USING (k)),
gone AS (SELECT DISTINCT doc_id, i + d AS p FROM hit, range(0, 35) t(d)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
runs AS (
  SELECT doc_id, count(*) AS n_spans FROM (
    SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone)
  WHERE q IS NULL OR p <> q + 1 GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE
    coalesce((SELECT string_agg(x.word, ' ' ORDER BY x.pos) FROM (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS pos) x
     WHERE NOT list_contains(ps, x.pos)), '') END) AS kept_sha256,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
