"""DuckDB SQL for the smaller cleaning, filter and source plans."""

from __future__ import annotations

from quizloom.plans.oracle.codebook_sql import CB
from quizloom.plans.oracle.mcq_sql import long_sql, missing
from quizloom.plans.oracle.stats_sql import HEAD
from quizloom.sources.registry import COL_DICT, VARS, registry_sql

H = f"WITH {registry_sql()}"

WRONG_CODES = "WITH " + CB + """
SELECT var, CASE sheet WHEN 'Brand#11' THEN 'brand_11' WHEN 'Brand#23' THEN 'brand_23' ELSE sheet END AS sheet FROM cb"""

DROP_IDENTIFYING = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"

ROW_SECTIONS = "WITH " + CB + """
SELECT var, ord, CASE WHEN ord < 50 THEN 'Intake' WHEN ord < 120 THEN 'Course' ELSE 'Outcome' END AS section FROM cb"""

FILL_BLANK = H + "\nSELECT record_id, " + ", ".join(f"coalesce({v}, '') AS {v}" for v in VARS) + " FROM registry"

TOKENS_TO_NULL = H + ",\n" + long_sql() + f"""
SELECT var, CASE WHEN NOT {missing('value')} AND value NOT IN ('NA', 'Not measurable', 'Unknown', 'Not necessary', 'N/A', '') THEN value END AS value,
  count(*) AS n FROM long GROUP BY ALL"""

_DICT = "(VALUES " + ", ".join(f"('{v}', '{n}', '{s}')" for v, n, s in COL_DICT) + ") d(var, display_name, section)"
PATCHED_DICT = """WITH e AS (SELECT 'v' || p_partkey AS var, p_name AS n, '[' || p_brand || ']' AS s FROM part WHERE p_partkey % 10 > 0),
c AS (SELECT 'v' || p_partkey AS var, CASE WHEN p_size < 48 THEN upper(p_name) END AS n,
    CASE WHEN p_size % 2 = 0 THEN '[Patched]' WHEN p_size BETWEEN 6 AND 10 THEN '[Added]' END AS s,
    CASE WHEN p_size <= 5 THEN 'replace' WHEN p_size <= 10 THEN 'add' ELSE 'remove' END AS a FROM part WHERE p_size <= 10 OR p_size >= 48)
SELECT var, coalesce(c.n, e.n) AS display_name, coalesce(c.s, e.s) AS section, e.n IS NULL AS added
FROM e FULL JOIN c USING (var)
WHERE coalesce(a, '') <> 'remove' AND (e.n IS NOT NULL OR a = 'add') AND var NOT IN ('v1', 'v3', 'v20', 'v33')"""

CLASS_MINIMUM = HEAD + """
SELECT var, CAST(min(n) AS BIGINT) AS min_class, count(*) AS n_classes, min(n) >= 3 AS usable FROM vals WHERE value IS NOT NULL GROUP BY var"""

FLEXIBLE_DATES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M')
    WHEN 2 THEN strftime(ts, '%Y%m%d') ELSE 'at ' || strftime(ts, '%H:%M') END AS raw,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS dt FROM events"""

PARALLEL_EXPLODE = "SELECT l_orderkey, l_linenumber AS line, l_partkey AS part, l_quantity AS qty FROM lineitem"

MAP_OF_PAIRS = """SELECT l_orderkey, nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS n_a,
  nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS n_n, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS n_r
FROM lineitem GROUP BY l_orderkey"""

DEBUG_SUBSET = H + "\nSELECT record_id, status FROM registry ORDER BY record_id LIMIT 50"

CSV_LITERAL = H + "\nSELECT CAST(record_id AS VARCHAR) AS record_id, coalesce(status, '') AS status, coalesce(segment, 'NA') AS segment FROM registry"

STORED_PROFILE = HEAD + "\nSELECT var, n_keys, n_vocab, round(float_ratio, 6) AS float_ratio, is_numeric FROM summary"
