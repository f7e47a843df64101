"""DuckDB SQL for the plans of column rules."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import u_
from quizloom.plans.oracle.sampling_sql import TEMPORAL_COHORT
from quizloom.sources.registry import registry_sql

RESIDUAL_COLUMNS = """WITH c AS (SELECT c_custkey, CAST(c_custkey % 13 AS VARCHAR) AS code,
  CASE WHEN c_custkey % 5 = 0 THEN 'not known' ELSE CAST(c_custkey % 13 AS VARCHAR) END AS st FROM customer)
SELECT c_custkey, CASE code WHEN '1' THEN 'Yes' WHEN '0' THEN 'no' WHEN '9' THEN 'NA' END AS medium, code NOT IN ('0', '1', '2', '9') AS bad,
  CASE code WHEN '3' THEN 'three' WHEN '4' THEN 'four or more' WHEN '5' THEN 'four or more' WHEN '9' THEN 'NA' END AS count,
  CASE st WHEN '1' THEN 'alive' WHEN '2' THEN 'moved' WHEN 'not known' THEN 'Unconfirmed' WHEN '9' THEN 'NA' END AS state,
  CASE code WHEN '8' THEN 'NA' ELSE code END AS kept FROM c"""

_NONE = ", ".join(f"CASE WHEN {c} IS NULL AND record_id % 2 = 0 THEN 'None' ELSE {c} END AS {c}" for c in ("status", "priority", "segment", "nation"))
FILL_RULES = f"""WITH {registry_sql()}, r AS (SELECT record_id, {_NONE} FROM registry)
SELECT record_id, coalesce(nullif(status, 'None'), 'no') AS status,
  CASE WHEN coalesce(priority, 'None') = 'None' AND segment = 'BUILDING' THEN 'no' ELSE priority END AS priority, segment,
  CASE WHEN coalesce(nation, 'None') = 'None' AND segment = 'None' THEN 'unknown' ELSE nation END AS nation FROM r"""

EDUCATION_MERGE = """WITH c AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 5 THEN '' WHEN 6 THEN CASE WHEN c_nationkey % 2 = 0 THEN '999' ELSE '' END
    ELSE CAST(c_custkey % 7 AS VARCHAR) END AS a,
  CASE c_nationkey % 6 WHEN 5 THEN '999' WHEN 0 THEN '' ELSE CAST(c_nationkey % 6 AS VARCHAR) END AS b FROM customer),
l AS (SELECT *, CASE WHEN a IN ('0', '1') THEN 'none' WHEN a = '2' THEN 'no school' WHEN a = '3' AND b = '1' THEN '0-3 years'
  WHEN a = '3' AND b = '2' THEN '4-6 years' WHEN a = '3' AND b = '3' THEN '7 years or more' END AS t,
  a = '' OR a = '999' OR b = '999' OR (a = '3' AND b = '') AS done FROM c)
SELECT c_custkey, CASE WHEN a = '' THEN NULL WHEN done THEN 'NA' ELSE t END AS edu, NOT done AND t IS NULL AS bad FROM l"""

KNOWN_COHORT = f"""WITH t AS ({TEMPORAL_COHORT}),
o AS (SELECT o_orderkey, CASE WHEN {u_('grade', 'o_orderkey')} < 0.1 THEN '9' WHEN {u_('grade', 'o_orderkey')} < 0.2 THEN ''
    ELSE substr(o_orderpriority, 1, 1) END AS grade, CASE WHEN {u_('event', 'o_orderkey')} < 0.15 THEN '' ELSE 'seen' END AS event FROM orders)
SELECT o.* FROM t JOIN o USING (o_orderkey) WHERE grade NOT IN ('', '9') AND event <> ''"""

DICTIONARY_FILE = """WITH w AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 3 > 0)
SELECT p_partkey, CASE WHEN w.p_type IS NOT NULL THEN lower(p.p_type) ELSE p.p_type END AS type FROM part p LEFT JOIN w USING (p_type)"""
