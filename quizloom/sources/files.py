"""Delimited registry reads with an explicit NA policy, and
split-partitioned question-set writes/reads.  Paths live under the shared
checkpoint folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.functions.missing import DEFAULT_NA_TOKENS, null_if_tokens
from quizloom.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.  Later plans see
    its size and columns, and a lost executor costs one file read, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_delimited(spark: SparkSession, path: str, columns: list[str], na_policy: str = "default") -> DataFrame:
    """S1 (``default``: pandas' NA tokens -> null) / S2 (``literal``: blanks and
    "NA" kept as values).  Every column is read as text with a declared schema."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = spark.read.schema(schema).option("header", True)
    if na_policy == "literal":
        r = r.option("nullValue", "\u0000").option("emptyValue", "")
    df = r.csv(path)
    if na_policy == "default":
        df = df.select(*[null_if_tokens(c, DEFAULT_NA_TOKENS).alias(c) for c in columns])
    return df


def write_delimited(df: DataFrame, path: str, null_token: str = "NA") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", null_token).csv(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Question set written as Parquet partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """S5 + F5: one split, pruned to its partition directory at planning time."""
    return spark.read.parquet(path).where(F.col(split_col) == split)


def write_dictionary(words: DataFrame, path: str) -> None:
    """S3: (source, target) as JSON objects of one entry a line."""
    words.select(F.to_json(F.map_from_arrays(F.array("source"), F.array("target"))).alias("value")).write.text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S3: (source, target) from JSON files whose lines are objects of any number of entries.  Of a word that
    comes twice the smallest translation counts; a line that is no such object is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    entries = lines.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("source", "target"))
    return entries.groupBy("source").agg(F.min("target").alias("target"))
