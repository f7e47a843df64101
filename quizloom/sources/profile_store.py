"""Profiles that are kept, read and merged.

A batch's profile is three Parquet tables: value counts (var, value, n), contingency counts of its
discrete columns by value (var_a, var_b, a, b, n), and the column dictionary.  Counts of several
batches add up, so a new batch is profiled alone and the old records are never read again;
everything else (vocabularies, weights, shapes, mixtures, MI) derives from the sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions.missing import is_missing
from quizloom.operators.mutual_info import MAX_DISCRETE, mi_from_counts
from quizloom.sources.files import stored

_COUNTS = "var string, value string, n long"
_PAIRS = "var_a string, var_b string, a string, b string, n long"
_DICTIONARY = "var string, ord int, display_name string, section string"


@dataclass
class StoredProfile:
    values: DataFrame
    pairs: DataFrame
    dictionary: DataFrame


def few_values(values: DataFrame, most: int = MAX_DISCRETE) -> list[str]:
    """Columns with at most ``most`` distinct values (one row a column comes to the driver)."""
    rows = values.where("value IS NOT NULL").groupBy("var").agg(F.count("*").alias("k")).where(F.col("k") <= most)
    return sorted(r["var"] for r in rows.collect())


def value_pairs(df: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(var_a, var_b, a, b, n) of the discrete columns, var_a < var_b, missing values null.

    A column that is discrete in the union of batches is so in each, so its counts are in all of them.
    Equal rows are counted before they are paired.
    """
    names = [c for c in few_values(values) if c in columns]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    rows = df.select(*[F.when(~is_missing(c), F.col(c).cast("string")).alias(c) for c in names]).groupBy(*names).agg(
        F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(x).alias("var_a"), F.lit(y).alias("var_b"), F.col(x).alias("a"), F.col(y).alias("b"))
                      for i, x in enumerate(names) for y in names[i + 1:]])
    return rows.select("n", F.inline(pairs)).groupBy("var_a", "var_b", "a", "b").agg(F.sum("n").cast("long").alias("n"))


def write_profile(path: str, values: DataFrame, pairs: DataFrame, dictionary: DataFrame) -> None:
    values.select("var", "value", F.col("n").cast("long").alias("n")).write.parquet(f"{path}/values")
    pairs.write.parquet(f"{path}/pairs")
    dictionary.write.parquet(f"{path}/dictionary")


def read_merged(spark: SparkSession, paths: list[str]) -> StoredProfile:
    """The sum of stored profiles.  The dictionary has each column once, as the last batch that knows it has it."""
    read = lambda kind, schema: [spark.read.schema(schema).parquet(f"{p}/{kind}") for p in paths]
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    values = stored(union(read("values", _COUNTS)).groupBy("var", "value").agg(F.sum("n").alias("n")), "values")
    pairs = union(read("pairs", _PAIRS)).groupBy("var_a", "var_b", "a", "b").agg(F.sum("n").alias("n"))
    entries = union([d.withColumn("_batch", F.lit(i)) for i, d in enumerate(read("dictionary", _DICTIONARY))])
    dictionary = entries.groupBy("var").agg(F.max_by(F.struct("ord", "display_name", "section"), "_batch").alias("d")).select("var", "d.*")
    return StoredProfile(values, pairs, dictionary)


def mi_of_pairs(pairs: DataFrame, values: DataFrame, min_class: int = 0) -> DataFrame:
    """(target, feature, mi, n_rows) of the columns that are discrete in the merged counts."""
    names = few_values(values)
    order = F.array(*[F.lit(v) for v in names])
    code = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.col(f"{c}_code"))
    codes = values.where(F.col("var").isin(names) & F.col("value").isNotNull()).groupBy("var").agg(
        F.sort_array(F.collect_set("value")).alias("all"))                          # at most MAX_DISCRETE values a column
    at = lambda side: F.broadcast(codes.select(F.col("var").alias(f"var_{side}"), F.col("all").alias(f"all_{side}")))
    coded = pairs.where(F.col("var_a").isin(names) & F.col("var_b").isin(names)).join(at("a"), "var_a").join(at("b"), "var_b")
    coded = coded.withColumns({f"{c}_code": F.array_position(f"all_{c}", F.col(c)) for c in "ab"})
    counts = coded.select((F.array_position(order, F.col("var_a")) - 1).cast("int").alias("vi"),
                          (F.array_position(order, F.col("var_b")) - 1).cast("int").alias("vj"),
                          code("a").cast("int").alias("ci"), code("b").cast("int").alias("cj"), "n")
    return mi_from_counts(counts, names, names, min_class)
