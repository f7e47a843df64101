"""DuckDB SQL for the cleaning / recoding operators."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import long_sql, u_
from quizloom.sources.registry import VARS, registry_sql

H = f"WITH {registry_sql()}"


def U(tag, *parts):
    key = "concat_ws('|', '" + tag + "'" + "".join(f", CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"((CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


REGISTRY_VIEW = H + "\nSELECT record_id, " + ", ".join(VARS) + ", 'valid' AS split_2020 FROM registry"

UNPIVOT = H + ",\n" + long_sql() + "\nSELECT record_id, var, value FROM long"

RECODE_CODES = H + ",\n" + long_sql() + """,
codes(var, code, label) AS (VALUES ('status', 'F', 'Finished'), ('status', 'O', 'Open'), ('status', 'P', 'Pending'))
SELECT l.record_id, l.var, coalesce(c.label, l.value) AS value FROM long l LEFT JOIN codes c ON l.var = c.var AND l.value = c.code"""

_MC = ("CASE WHEN priority = '1-URGENT' THEN concat_ws(',', line_count, substr(priority, 1, 1)) WHEN priority = '2-HIGH' THEN line_count || ',,' "
       "WHEN priority = '3-MEDIUM' THEN line_count WHEN status = 'F' THEN 'No' WHEN status = 'O' THEN 'NA,' ELSE '' END")
MULTI_CODE = H + f""", m AS (SELECT record_id, {_MC} AS raw FROM registry),
s AS (SELECT record_id, raw, regexp_replace(raw, ',+$', '') AS s FROM m),
p AS (SELECT *, list_transform(list_sort(string_split(s, ',')),
    lambda c: CASE trim(c) WHEN '1' THEN 'Alpha' WHEN '2' THEN 'Beta' WHEN '3' THEN 'Gamma' END) AS mp FROM s),
r AS (SELECT record_id, raw, s, CASE WHEN s = '' THEN NULL WHEN s IN ('NA', 'No') THEN s
    WHEN list_bool_or(list_transform(mp, lambda x: x IS NULL)) THEN NULL ELSE array_to_string(mp, ', ') END AS mapped FROM p)
SELECT record_id, raw, mapped, coalesce(mapped IS NULL AND s <> '', false) AS unknown FROM r"""

_SRAW = (f"CASE WHEN {U('sent', 'record_id')} < 0.05 THEN '999' WHEN {U('sent', 'record_id')} < 0.08 THEN '9999.0' "
         f"WHEN {U('sent', 'record_id')} < 0.1 THEN ' ' ELSE line_count END")
_SC = ("CASE WHEN raw IS NULL OR trim(raw) = '' THEN NULL WHEN TRY_CAST(trim(raw) AS DOUBLE) IN (999, 9999) THEN 'NA' ELSE raw END")
SENTINEL_NA = H + f""", s AS (SELECT record_id, raw, {_SC} AS cleaned FROM (SELECT record_id, {_SRAW} AS raw FROM registry))
SELECT record_id, raw, cleaned, CASE WHEN cleaned IN ('NA', 'Not measurable', 'Unknown', 'Not necessary', 'N/A', '') THEN NULL
  WHEN cleaned = 'Yes' THEN 'yes' WHEN cleaned = 'No' THEN 'no' ELSE cleaned END AS normalized FROM s"""

GATE_FILL = H + """
SELECT record_id, CASE WHEN status = 'F' THEN 'yes' ELSE 'no' END AS gate,
  CASE WHEN segment IS NULL AND (CASE WHEN status = 'F' THEN 'yes' ELSE 'no' END) = 'yes' THEN 'no' ELSE segment END AS segment FROM registry"""

MASK_OVERLAY = H + ",\n" + long_sql() + f"""
SELECT record_id, var, CASE WHEN {U('obs', 'var', 'record_id')} < 0.2 THEN 'N/A' ELSE value END AS value FROM long"""

CASE_COLLISION = H + f""", r AS (SELECT record_id, CASE WHEN {U('case', 'record_id')} < 0.2 THEN lower(segment) ELSE segment END AS segment FROM registry),
g AS (SELECT lower(segment) AS lk FROM r WHERE segment IS NOT NULL GROUP BY 1 HAVING count(DISTINCT segment) > 1)
SELECT record_id, CASE WHEN lower(segment) IN (SELECT lk FROM g) THEN lower(segment) ELSE segment END AS segment FROM r"""

_T = (f"CASE WHEN {U('tm', 'record_id')} < 0.05 THEN '' ELSE printf('%02d:%02d', CAST(floor({U('hh', 'record_id')} * 24) AS INTEGER), "
      f"record_id % 60) END")
DATE_MINUTES = H + f""", r AS (SELECT r.*, {_T} AS t, li.anchor FROM registry r LEFT JOIN
  (SELECT l_orderkey, min(l_shipdate) AS anchor FROM lineitem GROUP BY 1) li ON r.record_id = li.l_orderkey),
d AS (SELECT *, CASE WHEN order_date IS NULL OR t IS NULL OR trim(order_date) = '' OR trim(t) = '' THEN NULL
    ELSE try_strptime(order_date || ' ' || t, '%Y-%m-%d %H:%M') END AS dt FROM r)
SELECT record_id, strftime(dt, '%Y-%m-%d %H:%M') AS dt, CAST(floor((epoch(dt) - epoch(anchor)) / 60) AS BIGINT) AS minutes,
  round_even(TRY_CAST(ship_days AS DOUBLE) / 365.25, 0) AS years FROM d"""

FAMILY_RESET = H + f""", r AS (SELECT record_id, discount AS disc, line_count AS disc_c,
    CASE WHEN {U('fam', 'record_id')} < 0.3 THEN 0 ELSE 1 END AS disc_s FROM registry)
SELECT record_id, CASE WHEN disc_s = 0 THEN '0' ELSE disc END AS disc, CASE WHEN disc_s = 0 THEN NULL ELSE disc_c END AS disc_c,
  CASE WHEN disc_s = 0 THEN NULL ELSE disc_s END AS disc_s FROM r"""

BINARY_LABELS = f"""WITH o AS (SELECT o_orderkey, CASE WHEN {U('bl', 'o_orderkey')} < 0.1 THEN NULL
    ELSE CAST(o_orderstatus = 'F' AS INTEGER) END AS flag FROM orders)
SELECT o_orderkey, CASE WHEN flag = 1 THEN 'Yes' WHEN flag = 0 THEN 'No' ELSE CAST(flag AS VARCHAR) END AS yes_no,
  CASE WHEN flag IS NULL OR flag <> 0 THEN 'Female' ELSE 'Male' END AS truthy,
  CASE WHEN flag IS NULL THEN 'No' WHEN CAST(flag AS VARCHAR) IN ('yes', '1', 'True', '1.0') THEN 'Yes' ELSE 'No' END AS present FROM o"""

ORDINAL_CODES = H + """
SELECT record_id, coalesce(CASE priority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END, -1) AS priority_code FROM registry"""

LEAKAGE_GUARD = H + "\nSELECT " + ", ".join(["record_id"] + [v for v in VARS if not (("ship" in v or "quantity" in v) and v != "ship_days")]) + " FROM registry"


CSV_ROUNDTRIP = H + "\nSELECT record_id, " + ", ".join(VARS) + " FROM registry"

READ_SPLIT = H + f""",
v AS (SELECT record_id FROM registry ORDER BY {u_('ids', 'record_id')}, record_id LIMIT 1000)
SELECT *, 'valid' AS split FROM registry WHERE record_id IN (SELECT record_id FROM v)"""


def _blocks(target=None):
    from itertools import groupby
    from quizloom.sources.registry import COL_DICT
    out = []
    for sec, items in groupby(COL_DICT, key=lambda t: t[2]):
        items = list(items)
        lines = [f"CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN '{n}: ' || "
                 + (f"CASE WHEN {target} = '{c}' THEN '[MASK]' ELSE {c} END" if target else c) + " END" for c, n, _ in items]
        anyp = " OR ".join(f"({c} IS NOT NULL AND {c} <> '')" for c, _, _ in items)
        out.append((sec, f"CASE WHEN {anyp} THEN concat_ws(chr(10), '{sec}', {', '.join(lines)}) END", lines))
    return out


def _hoist():
    b = _blocks()
    h = [x for x in b if x[0] == "[Customer/Profile]"][0]
    rest = [x[1] for x in b if x[0] != "[Customer/Profile]"]
    hl = f"concat_ws(chr(10), {', '.join(h[2])})"
    body = f"concat_ws(chr(10) || chr(10), {', '.join(rest)})"
    return f"CASE WHEN {hl} <> '' THEN '[Baseline/Customer Information]' || chr(10) || {hl} || chr(10) || chr(10) || {body} ELSE {body} END"


SECTION_HOIST = H + f"\nSELECT record_id, {_hoist()} AS text FROM registry"


def _until_gap():
    b = _blocks("'nation'")
    b1, b2, b3 = b[0][1], b[1][1], b[2][1]
    return (f"CASE WHEN ({b1}) IS NULL THEN '' WHEN ({b2}) IS NULL THEN CASE WHEN contains({b1}, '[MASK]') THEN {b1} ELSE '' END "
            f"ELSE concat_ws(chr(10) || chr(10), {b1}, {b2}, coalesce({b3}, '{b[2][0]}')) END")


SERIALIZE_UNTIL_GAP = H + f"\nSELECT record_id, {_until_gap()} AS text FROM registry WHERE nation IS NOT NULL"


def _flat():
    from quizloom.sources.registry import COL_DICT
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN '{n}: ' || trim({c}) END"
                                              for c, n, _ in COL_DICT) + ")"


SERIALIZE_FLAT = H + f"\nSELECT record_id, {_flat()} AS text FROM registry"


MV_RECONCILE = H + """, m AS (SELECT record_id, line_count AS a, substr(priority, 1, 1) AS b FROM registry)
SELECT *, CASE WHEN a IN ('3', '4') THEN 'NA' WHEN a IN ('1', '2') THEN a WHEN b IN ('3', '4') THEN 'NA' WHEN b IN ('1', '2') THEN b ELSE a END AS mv_a,
  CASE WHEN a IN ('3', '4') THEN a WHEN a IN ('1', '2') THEN 'NA' WHEN b IN ('3', '4') THEN b WHEN b IN ('1', '2') THEN 'NA' ELSE b END AS mv_b FROM m"""

EDU_MERGE = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'None' WHEN c_custkey % 5 = 1 AND c_nationkey % 2 = 0 THEN 'Primary'
  WHEN c_custkey % 5 = 1 AND c_nationkey % 2 = 1 THEN 'Middle' WHEN c_custkey % 5 = 2 AND c_nationkey % 2 = 0 THEN 'High'
  WHEN c_custkey % 5 = 2 AND c_nationkey % 2 = 1 THEN 'College' WHEN c_custkey % 5 = 3 THEN 'Graduate' END AS edu FROM customer"""

SCRIPT_TRANSLATE = """WITH d AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[À-ÿ]') THEN 'tr:' || lower(line) ELSE line END AS line FROM d"""


RESIDUAL_CODES = """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code,
  CASE WHEN c_nationkey = 1 THEN 'Yes' WHEN c_nationkey = 0 THEN 'no' WHEN c_nationkey = 9 THEN 'NA' END AS yes_label,
  c_nationkey NOT IN (0, 1, 9) AS bad,
  CASE c_nationkey WHEN 1 THEN 'One' WHEN 2 THEN 'Two' WHEN 10 THEN 'Ten' WHEN 11 THEN 'Ten' WHEN 9 THEN 'NA' END AS num_label
FROM customer"""

SINGLE_VALUE = H + f""", d AS (SELECT record_id,
    CASE WHEN status = 'F' THEN 'Yes' WHEN {U('sv', 'record_id')} < 0.3 THEN 'NA' ELSE '' END AS d1_icud1,
    CASE WHEN {U('piv', 'record_id')} < 0.2 THEN 'NA' ELSE 'Y' END AS na_icud1 FROM registry)
SELECT record_id, CASE WHEN d1_icud1 = 'Yes' THEN d1_icud1 WHEN na_icud1 = 'NA' THEN '' ELSE 'No' END AS d1_icud1, na_icud1 FROM d"""

UNIT_NAMES = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN trim(p_name) || ' (kg)' WHEN 1 THEN trim(p_name) || ' (kg/m^2)'
  WHEN 2 THEN trim(p_name) WHEN 3 THEN trim(p_name) || ' (10^3/uL)' END AS display FROM part"""
