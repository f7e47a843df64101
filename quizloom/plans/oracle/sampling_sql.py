"""DuckDB SQL for sampling, sets, filters and joins."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import u_
from quizloom.plans.oracle.text_sql import tok_count
from quizloom.plans.oracle.timeseries_sql import HORIZON_QUESTION, OUTCOME_QUESTION
from quizloom.sources.registry import registry_sql

HOLDOUT_SPLIT = f"""WITH {registry_sql()},
v AS (SELECT record_id FROM registry ORDER BY {u_('ids', 'record_id')}, record_id LIMIT 1000)
SELECT record_id, CASE WHEN record_id IN (SELECT record_id FROM v) THEN 'valid' ELSE 'train' END AS split FROM registry"""

SAMPLE_GROUPS = f"""WITH v AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY {u_('ids', 'user_id')}, user_id LIMIT 20)
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM v)"""

ONE_PER_GROUP = f"""SELECT o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {u_('one', 'o_orderkey')}) = 1"""

OVERSAMPLE_DEDUPE = f"""WITH r AS (SELECT doc_id, text, CAST(unnest(range(0, 2)) AS INTEGER) AS replica FROM documents),
m AS (SELECT doc_id, replica, chr(CAST(65 + floor({u_('rep', 'doc_id', 'replica')} * 2) AS INTEGER)) || ': ' || text AS message FROM r)
SELECT md5(message) AS msg_md5, arg_min(doc_id, (doc_id, replica)) AS doc_id, arg_min(replica, (doc_id, replica)) AS replica
FROM m GROUP BY md5(message)"""

WEIGHTED_DRAW = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    -ln({u_('wd', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}) / l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS rank
  FROM lineitem) WHERE rank <= 3"""

SHUFFLE_HEAD = f"SELECT o_orderkey FROM orders ORDER BY {u_('shuf', 'o_orderkey')}, o_orderkey LIMIT 100"

UNION_TASKS = ("WITH h AS (" + HORIZON_QUESTION.replace("SELECT * FROM hq2", "SELECT *, 'horizon' AS task FROM hq2")
               + "), o AS (" + OUTCOME_QUESTION + ")\nSELECT * FROM h UNION ALL BY NAME SELECT * FROM o")

SET_DIFF = """SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""

COHORT_FILTER = f"""WITH {registry_sql()}
SELECT record_id FROM registry WHERE status IS DISTINCT FROM 'P' AND priority = '1-URGENT'"""

TEMPORAL_COHORT = f"""WITH li AS (SELECT l_orderkey, min(l_shipdate) AS fu, max(l_shipdate) AS ev0 FROM lineitem GROUP BY 1)
SELECT o.o_orderkey FROM orders o JOIN li ON o.o_orderkey = li.l_orderkey
WHERE o.o_orderdate < li.fu AND (CASE WHEN {u_('ev', 'o.o_orderkey')} < 0.3 THEN NULL ELSE li.ev0 END IS NULL
  OR li.fu < CASE WHEN {u_('ev', 'o.o_orderkey')} < 0.3 THEN NULL ELSE li.ev0 END)"""

TOKEN_LEN_FILTER = f"""SELECT doc_id FROM documents WHERE {tok_count('text')} < 2000
ORDER BY {u_('tl', 'doc_id')}, doc_id LIMIT 100"""

LEFT_LOOKUP = "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"

POSITIONAL_ZIP = """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_name FROM part),
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_name FROM supplier)
SELECT CAST(p.position AS BIGINT) AS position, p.p_name, s.s_name FROM p JOIN s ON p.position = s.position"""

DROP_NULL_COLS = f"WITH {registry_sql()}\nSELECT * FROM registry"


def _two_limits(want: int) -> str:
    return f"""WITH d AS (SELECT doc_id, text, 'Read the note.' || chr(10) || split_part(text, chr(10), 1) AS prompt, {u_('two', 'doc_id')} AS u
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n FROM d),
f AS (SELECT * FROM d ORDER BY u, doc_id LIMIT {4 * want}),
k AS (SELECT doc_id, text, u FROM f, n WHERE n > {want} AND {tok_count('prompt')} < 120 AND {tok_count('text')} < 900
  UNION ALL SELECT doc_id, text, u FROM d, n WHERE n <= {want})
SELECT doc_id, CAST({tok_count('text')} AS BIGINT) AS n_tokens FROM k ORDER BY u, doc_id LIMIT {want}"""


TWO_LIMITS, TWO_LIMITS_SHORT = _two_limits(60), _two_limits(100_000_000)
