"""The wide "registry" view: one row per record, every attribute as text.

Built from orders ⋈ customer ⋈ nation plus per-order lineitem aggregates; it
stands in for a coded clinical registry.  Missingness is injected where a hash
uniform of (var, record_id) falls below ``missing_rate``.

``COL_DICT`` is the column dictionary: (var, display name, section) in the
order the serialisers walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions.hashing import sql_u, u_at_least
from quizloom.sources.tables import table

# Column dictionary of the fixture registry (var, display name, section).
COL_DICT = [
    ("status", "Order status", "[Order/Status]"),
    ("priority", "Order priority", "[Order/Status]"),
    ("order_date", "Order date", "[Order/Status]"),
    ("total_price", "Total price", "[Order/Amounts]"),
    ("line_count", "Number of lines", "[Order/Amounts]"),
    ("ship_days", "Days to first shipment", "[Order/Amounts]"),
    ("quantity", "Total quantity", "[Order/Amounts]"),
    ("discount", "Total discount", "[Order/Amounts]"),
    ("segment", "Market segment", "[Customer/Profile]"),
    ("nation", "Nation", "[Customer/Profile]"),
    ("acct_bal", "Account balance", "[Customer/Profile]"),
]
VARS = [v for v, _, _ in COL_DICT]
MISSING_RATE = 0.1


def col_dict(spark: SparkSession) -> DataFrame:
    rows = [(v, i, n, s) for i, (v, n, s) in enumerate(COL_DICT)]
    return spark.createDataFrame(rows, "var string, ord int, display_name string, section string")


def _fmt2(c: str):
    # format_string renders null as "null": keep missing as null
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", c))


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry before missingness (every column text, key ``record_id``)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_orderpriority", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_shipdate").alias("first_ship"),
               F.sum("l_quantity").alias("sum_qty"), F.sum("l_discount").alias("sum_disc")))
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)   # nation: 25 rows, fixed
         .join(li, o.o_orderkey == li.l_orderkey, "left"))
    return j.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        _fmt2("o_totalprice").alias("total_price"),
        F.col("n_lines").cast("string").alias("line_count"),
        F.datediff(F.col("first_ship").cast("date"), F.col("o_orderdate").cast("date")).cast("string").alias("ship_days"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
         .when(~u_at_least(0.05, "qty", F.col("o_orderkey")), F.lit("unknown"))
         .otherwise(F.col("sum_qty").cast("long").cast("string")).alias("quantity"),
        _fmt2("sum_disc").alias("discount"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        _fmt2("c_acctbal").alias("acct_bal"),
    )


def registry(spark: SparkSession, sf_dir: str, missing_rate: float = MISSING_RATE) -> DataFrame:
    """Registry with hash-injected missing values (null)."""
    raw = registry_raw(spark, sf_dir)
    return raw.select("record_id", *[
        F.when(u_at_least(missing_rate, "mask", F.lit(v), F.col("record_id")), F.col(v)).alias(v) for v in VARS
    ])


def registry_sql(missing_rate: float = MISSING_RATE) -> str:
    """The same registry as a DuckDB CTE body named ``registry``."""
    masked = ",\n".join(
        f"CASE WHEN {sql_u('mask', repr(v), 'record_id')} >= {missing_rate} THEN {v} END AS {v}" for v in VARS)
    return f"""registry_raw AS (
  SELECT o.o_orderkey AS record_id, o.o_orderstatus AS status, o.o_orderpriority AS priority,
         strftime(o.o_orderdate, '%Y-%m-%d') AS order_date, printf('%.2f', o.o_totalprice) AS total_price,
         CAST(li.n_lines AS VARCHAR) AS line_count,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.first_ship AS DATE)) AS VARCHAR) AS ship_days,
         CASE WHEN o.o_orderstatus = 'P' THEN 'pending' WHEN {sql_u('qty', 'o.o_orderkey')} < 0.05 THEN 'unknown'
              ELSE CAST(CAST(li.sum_qty AS BIGINT) AS VARCHAR) END AS quantity,
         printf('%.2f', li.sum_disc) AS discount,
         c.c_mktsegment AS segment, n.n_name AS nation, printf('%.2f', c.c_acctbal) AS acct_bal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_shipdate) AS first_ship,
         sum(l_quantity) AS sum_qty, sum(l_discount) AS sum_disc FROM lineitem GROUP BY l_orderkey) li
    ON o.o_orderkey = li.l_orderkey),
registry AS (SELECT record_id,
{masked}
  FROM registry_raw)"""
