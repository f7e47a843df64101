"""Filter interaction audit: what each of five filters removes, in every order, and its Shapley share.

1. Every text is judged by the four filters that look at one text only, and digested; a row
   is from here on a few dozen bytes.
2. Rows with equal digests, part and labels are counted before they meet (a copied text is a
   few rows, however many documents hold it), which settles the fifth filter: identical to
   the text of a smaller id.
3. Documents are counted by part and by the set of filters that they fail; from that follows
   what each of the 32 coalitions of filters removes.
4. Per part, the kernel-weighted least-squares fit of an additive game to the 32 values, with
   its sum fixed to what all filters remove, is solved in rationals: its coefficients are the
   Shapley values.  Step counts of an order are differences of coalitions.

Texts are held against each other by SHA-256: equal digests count as equal texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.llm.common import prepare, text_bytes, text_pieces

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = b"#$%&*|"
_FULL = (1 << len(FILTERS)) - 1
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_CONTINUED = bytes(range(0x80, 0xC0))


def failed(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D.  Words lie between bytes \\x20 and \\x09-\\x0D."""
    n, seen = 0, set()
    for piece in text_pieces(text):
        words = piece.split()
        n += len(words)
        seen.update(words)
    upper = len(text.translate(None, _NOT_UPPER))
    points = len(text.translate(None, _CONTINUED))
    return ((n < MIN_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * n) << 1
            | (100 * upper > UPPER_PERCENT * points) << 2 | any(m in text for m in MARKS) << 3)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column("body")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("part"), pa.array([failed(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            ["doc", "part", "mask", "digest"])


def failure_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                   part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters in ``mask``."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(f"`{id}`").alias("doc"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       text_bytes(f"`{text}`").alias("body"))
    kind = docs.schema["doc"].dataType.simpleString()
    judged = docs.mapInArrow(_judge, f"doc {kind}, part string, mask int, digest binary")
    marks = labels.groupBy(F.col(f"`{id}`").alias("doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = judged.join(marks, "doc", "left").fillna(0, ["good", "toxic"])
    alike = ["digest", "mask", "part", "good", "toxic"]
    each = rows.groupBy("doc", *alike).agg(F.count("*").alias("n"))  # keyed by the document: no hot key
    known = F.col("doc").isNotNull()
    groups = each.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(known, F.struct("doc", "n"))).alias("first"))
    least = F.min("first.doc").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("first.doc") == least, F.col("first.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", fresh.alias("fresh")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct("mask", F.col("fresh").alias("n")),
            F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("m"))
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"),
        F.sum(F.col("m.n") * F.col("toxic")).alias("toxic"))


def coalition_removals(counts: DataFrame) -> DataFrame:
    """(part, coalitions): per coalition of filters, in order of its bits, what it removes, of which good
    and toxic, and the part's documents."""
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    wide = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(_FULL))))
    per = wide.groupBy("part", "coalition").agg(
        F.sum("n").alias("all"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"{c}_out") for c in ("n", "good", "toxic")])
    return per.groupBy("part").agg(F.sort_array(F.collect_list(
        F.struct("coalition", "n_out", "good_out", "toxic_out", "all"))).alias("coalitions"))


def normal_inverse(m: int) -> list[list[Fraction]]:
    """Inverse of the normal equations of the kernel-weighted fit, bordered by the constraint on the sum.

    Weight of a coalition of s out of m: (m - 1) / (C(m, s) s (m - s)); none for the empty and
    the full one, which the constraint fixes.
    """
    def weight(s):
        return Fraction(m - 1, math.comb(m, s) * s * (m - s))

    rows = [[Fraction(0)] * (m + 1) + [Fraction(int(i == j)) for j in range(m + 1)] for i in range(m + 1)]
    for bits in range(1, (1 << m) - 1):
        inside = [i for i in range(m) if bits >> i & 1]
        for i in inside:
            for j in inside:
                rows[i][j] += weight(len(inside))
    for i in range(m):
        rows[i][m] = rows[m][i] = Fraction(1)
    for c in range(m + 1):
        p = next(r for r in range(c, m + 1) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(m + 1):
            if r != c and rows[r][c]:
                f = rows[r][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c])]
    return [r[m + 1:] for r in rows]


def shapley(values: list[int], inverse: list[list[Fraction]]) -> list[Fraction]:
    """Shapley values of a game given by its 2**m coalition values, by constrained least squares."""
    m = len(inverse) - 1
    right = [Fraction(0)] * m + [Fraction(values[-1] - values[0])]
    for bits in range(1, (1 << m) - 1):
        s = bits.bit_count()
        w = Fraction(m - 1, math.comb(m, s) * s * (m - s))
        for i in range(m):
            if bits >> i & 1:
                right[i] += w * (values[bits] - values[0])
    return [sum((a * b for a, b in zip(row, right)), Fraction(0)) for row in inverse[:m]]


_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m, inverse = len(FILTERS), normal_inverse(len(FILTERS))
    names = [f.strip().split()[0] for f in _SCHEMA.split(",")]
    for batch in batches:
        for row in batch.to_pylist():
            out, good, toxic = ([c[k] for c in row["coalitions"]] for k in ("n_out", "good_out", "toxic_out"))
            total = row["coalitions"][0]["all"]
            share = [x * math.factorial(m) for x in shapley(out, inverse)]
            if any(x.denominator != 1 for x in share):
                raise ValueError("a Shapley value is not a multiple of 1/m!")
            rows = []
            for order in permutations(range(m)):
                before = 0
                for step, f in enumerate(order, 1):
                    now = before | 1 << f
                    removed = out[now] - out[before]
                    rows.append((row["part"], "".join(FILTERS[i] for i in order), step, total - out[now], removed,
                                 out[1 << f] - removed, out[_FULL] - out[_FULL ^ 1 << f], good[now] - good[before],
                                 toxic[now] - toxic[before], int(share[f])))
                    before = now
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i < 2 else pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names)


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (all longs but step; shapley is summed over the 120 orders).

    A document fails A with under 50 words, B with under 65 % distinct words, C with over 5 % of
    A-Z among its code points, D with any of ``#$%&*|``, E if a row with a smaller id has the same
    text.  A null text is the empty text, a null part the empty string.  A row without an id is
    never a later copy and makes no other row one.  Rows with the same id and text are both
    counted and neither is a copy of the other.  A document is good or toxic if any of its label
    rows says so; label rows of other ids count nowhere.  Texts of any length are read whole.  An
    empty table gives no rows; other columns are not looked at.
    """
    return coalition_removals(failure_counts(docs, labels, id, text, part)).mapInArrow(_orders, _SCHEMA)


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ``filter_audit`` of all documents by source."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"),
                        spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: DuckDB: every order walked step by step over the counts by failed set.
OP12_SQL = r"""
WITH f AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
j AS (
  SELECT doc_id, part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM f),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM j LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(p, lambda v: chr(CAST(65 + v AS INT))), '') AS filter_order, k AS step,
    1 << p[k] AS bit, list_sum(list_transform(list_slice(p, 1, k - 1), lambda v: 1 << v)) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
