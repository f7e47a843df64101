"""DuckDB SQL for the time-series and outcome operators."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import distractor_ctes, profile_ctes, u_

EVS = """evs AS (SELECT *, CAST(floor(epoch_us(ts) / 28800000000) AS INTEGER)
    - CAST(floor(min(epoch_us(ts)) OVER (PARTITION BY user_id) / 28800000000) AS INTEGER) AS slot FROM events)"""

FLAGS = f"""{EVS},
flags AS (
  SELECT g.user_id, g.slot_idx, f.flag FROM
    (SELECT DISTINCT user_id, CAST(unnest(range(0, 24)) AS INTEGER) AS slot_idx FROM events) g
  LEFT JOIN (SELECT user_id, slot AS slot_idx, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS flag
             FROM evs WHERE slot BETWEEN 0 AND 23 GROUP BY ALL) f
  ON g.user_id = f.user_id AND g.slot_idx = f.slot_idx),
labels AS (
  SELECT user_id, slot_idx,
    (count(*) OVER w - count(flag) OVER w = 0 AND sum(flag) OVER w >= 1) AS label_strict,
    coalesce(sum(flag) OVER w >= 1, false) AS label_ignore
  FROM flags WINDOW w AS (PARTITION BY user_id ORDER BY slot_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"""

HORIZON_LABEL = f"WITH {FLAGS}\nSELECT * FROM labels"

SECTIONS = f"""ev AS (SELECT user_id, slot AS slot_idx, event_type, value FROM evs
  WHERE slot BETWEEN 0 AND 20 AND event_type <> 'error'),
sl AS (SELECT user_id, CAST(floor(slot_idx / 3) * 4 + slot_idx % 3 AS INTEGER) AS sec_ord,
         string_agg(printf('%s: %.2f', event_type, v), chr(10) ORDER BY event_type) AS body
  FROM (SELECT user_id, slot_idx, event_type, sum(value) AS v FROM ev GROUP BY ALL) GROUP BY ALL),
dl AS (SELECT user_id, CAST((day - 1) * 4 + 3 AS INTEGER) AS sec_ord,
         string_agg(printf('%s count: %d', event_type, n), chr(10) ORDER BY event_type) AS body
  FROM (SELECT user_id, CAST(floor(slot_idx / 3) + 1 AS INTEGER) AS day, event_type, count(*) AS n FROM ev GROUP BY ALL)
  GROUP BY ALL),
grid AS (SELECT DISTINCT user_id, CAST(unnest(range(0, 28)) AS INTEGER) AS sec_ord FROM events),
secs AS (SELECT g.user_id, g.sec_ord,
    CASE WHEN g.sec_ord % 4 = 3 THEN printf('[Day %d]', g.sec_ord // 4 + 1)
         ELSE printf('[Day %d %02d:00 - %02d:00]', g.sec_ord // 4 + 1, (g.sec_ord % 4) * 8, (g.sec_ord % 4 + 1) * 8) END AS header,
    b.body
  FROM grid g LEFT JOIN (SELECT * FROM sl UNION ALL SELECT * FROM dl) b ON g.user_id = b.user_id AND g.sec_ord = b.sec_ord),
okq AS (SELECT *, min(CASE WHEN body IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sec_ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM secs),
qsec AS (SELECT user_id, sec_ord,
    CAST(CASE WHEN sec_ord % 4 = 3 THEN (sec_ord // 4) * 3 + 2 ELSE (sec_ord // 4) * 3 + sec_ord % 4 END AS INTEGER) AS slot_idx
  FROM okq WHERE ok = 1 AND (sec_ord % 4 = 3 OR (sec_ord % 4 < 2 AND sec_ord <> 0))),
prefix AS (SELECT q.user_id, q.slot_idx,
    string_agg(chr(10) || s.header || chr(10) || s.body || chr(10), '' ORDER BY s.sec_ord) AS prefix
  FROM qsec q JOIN secs s ON q.user_id = s.user_id AND s.sec_ord <= q.sec_ord GROUP BY q.user_id, q.slot_idx)"""

PREFIX_PROMPTS = f"WITH {EVS},\n{SECTIONS}\nSELECT user_id, slot_idx, prefix FROM prefix"

_HQ = f"""hq AS (SELECT p.user_id, p.slot_idx, {u_('coin', 'p.user_id', 'p.slot_idx')} > 0.5 AS yes_first, l.label_strict AS lab, p.prefix
  FROM prefix p JOIN labels l ON p.user_id = l.user_id AND p.slot_idx = l.slot_idx),
hq2 AS (SELECT user_id, slot_idx,
    regexp_replace(prefix || chr(10) || 'Q. Would an error occur in the next 48 hours?' ||
      CASE WHEN yes_first THEN chr(10) || 'A.yes' || chr(10) || 'B.no' ELSE chr(10) || 'A.no' || chr(10) || 'B.yes' END,
      '^\\s+|\\s+$', '', 'g') AS user_message,
    CASE WHEN yes_first THEN CASE WHEN lab THEN 'A' ELSE 'B' END ELSE CASE WHEN lab THEN 'B' ELSE 'A' END END AS label_0,
    CASE WHEN yes_first THEN ['yes', 'no'] ELSE ['no', 'yes'] END AS choices_0 FROM hq)"""

HORIZON_QUESTION = f"WITH {FLAGS},\n{SECTIONS},\n{_HQ}\nSELECT * FROM hq2"

HORIZON_SAMPLE = f"""WITH {FLAGS},\n{SECTIONS},\n{_HQ},
ids AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM hq2) ORDER BY {u_('ids', 'user_id')}, user_id LIMIT 1000)
SELECT * FROM hq2 WHERE user_id IN (SELECT user_id FROM ids)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {u_('one', 'user_id', 'slot_idx')}) = 1"""


def fmt_num(x: str) -> str:
    return (f"CASE WHEN TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) IS NULL THEN CAST({x} AS VARCHAR) "
            f"WHEN floor(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)) = TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) "
            f"THEN printf('%d', CAST(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) AS BIGINT)) "
            f"ELSE printf('%.3f', TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)) END")


FEATS = [("events", "Events"), ("errors", "Errors"), ("purchases", "Purchases"), ("total_value", "Total value"),
         ("max_value", "Max value")]

TRAJ = """hev AS (SELECT user_id, ts, event_type, value, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events),
hrows AS (SELECT user_id, hour, CAST(count(*) AS DOUBLE) AS events,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS errors,
    CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS purchases,
    round(sum(value), 2) AS total_value, max(value) AS max_value FROM hev GROUP BY user_id, hour),
husers AS (SELECT user_id, coalesce(min(hour) FILTER (WHERE event_type = 'error'), min(hour)) AS onset_hour,
    arg_min(event_type, ts) AS first_event, arg_min(value, ts) AS first_value FROM hev GROUP BY user_id),
traj AS (SELECT r.user_id, r.hour * 3600 AS charttime, u.onset_hour * 3600 AS onset, u.first_event, u.first_value,
    r.events, r.errors, r.purchases, r.total_value, r.max_value FROM hrows r JOIN husers u ON r.user_id = u.user_id)"""


def _block(alias="t"):
    h = f"CAST(floor(({alias}.charttime - {alias}.onset) / 3600) AS BIGINT)"
    lines = " || ".join(f"CASE WHEN {alias}.{v} IS NOT NULL THEN '{n}: ' || {fmt_num(alias + '.' + v)} || chr(10) ELSE '' END"
                        for v, n in FEATS)
    return (f"chr(10) || '[Time: Onset' || CASE WHEN {h} < 0 THEN CAST({h} AS VARCHAR) ELSE '+' || CAST({h} AS VARCHAR) END "
            f"|| 'h]' || chr(10) || {lines}")


def _head(alias="t"):
    return (f"'[Patient Information]' || chr(10) || 'First event: ' || {fmt_num(alias + '.first_event')} || chr(10) || "
            f"'First value: ' || {fmt_num(alias + '.first_value')} || chr(10)")


TRAJECTORY_TEXT = f"""WITH {TRAJ}
SELECT user_id, any_value({_head()}) || string_agg({_block()}, '' ORDER BY t.charttime) AS text FROM traj t GROUP BY user_id"""

STAY = """stay AS (SELECT user_id, max(charttime) AS last_time, min(charttime) AS first_time,
    max(CASE WHEN charttime = mx - 86400 THEN 1 ELSE 0 END) AS has24
  FROM (SELECT *, max(charttime) OVER (PARTITION BY user_id) AS mx FROM traj) GROUP BY user_id
  HAVING max(charttime) - min(charttime) >= 172800 AND max(CASE WHEN charttime = mx - 86400 THEN 1 ELSE 0 END) = 1)"""

STAY_HAVING = f"WITH {TRAJ},\n{STAY}\nSELECT user_id, last_time, first_time FROM stay"

_TLONG = "long AS (" + " UNION ALL ".join(
    f"SELECT CAST(user_id AS VARCHAR) || '|' || CAST(charttime AS VARCHAR) AS record_id, '{v}' AS var, "
    f"CAST({v} AS VARCHAR) AS value FROM traj" for v, _ in FEATS) + ")"

_LAST = "last AS (SELECT t.user_id, " + ", ".join(f"arg_max(t.{v}, t.charttime) AS {v}" for v, _ in FEATS) + \
    " FROM traj t JOIN stay s ON t.user_id = s.user_id GROUP BY t.user_id)"

_NAMES = "CASE q.var " + " ".join(f"WHEN '{v}' THEN '{n}'" for v, n in FEATS) + " END"

FORECAST_QUESTION = f"""WITH {TRAJ},
{STAY},
{profile_ctes(_TLONG)},
{_LAST},
q0 AS (SELECT user_id AS record_id, var, label_raw, CAST(user_id AS VARCHAR) || '|' || var AS qid FROM (
  {" UNION ALL ".join(f"SELECT user_id, '{v}' AS var, CAST({v} AS VARCHAR) AS label_raw FROM last" for v, _ in FEATS)})
  WHERE label_raw IS NOT NULL),
{distractor_ctes()},
fq AS (SELECT *, CAST(floor({u_('pos', 'qid')} * (len(choices) + 1)) AS INTEGER) AS label_idx FROM ch),
fq2 AS (SELECT *, list_concat(list_slice(choices, 1, label_idx), [label], list_slice(choices, label_idx + 1, len(choices))) AS options FROM fq),
txt AS (SELECT t.user_id, any_value({_head()}) || coalesce(string_agg({_block()}, '' ORDER BY t.charttime)
    FILTER (WHERE t.mx - t.charttime >= 86400), '') AS text
  FROM (SELECT *, max(charttime) OVER (PARTITION BY user_id) AS mx FROM traj) t JOIN stay s ON t.user_id = s.user_id
  GROUP BY t.user_id)
SELECT q.record_id AS user_id,
  x.text || printf(chr(10) || 'Q. What will the %s value likely be 24 hours after the last records?', {_NAMES})
    || array_to_string(list_transform(q.options, lambda c, i: chr(10) || chr(CAST(64 + i AS INTEGER)) || '. ' || c), '') AS user_message,
  chr(65 + q.label_idx) AS label_0, {_NAMES} AS task, q.options AS choices_0
FROM fq2 q JOIN txt x ON q.record_id = x.user_id WHERE len(q.options) >= 2"""

CHAIN = """chain AS (SELECT o.o_orderkey, o.o_orderdate, c.c_mktsegment, n.n_name,
    coalesce(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.first_ship AS DATE)) <= 30, false) AS label
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey)"""

OUTCOME_CHAIN = f"WITH {CHAIN}\nSELECT * FROM chain"

_OF = [("l_quantity", "Quantity"), ("l_extendedprice", "Extended price"), ("l_discount", "Discount"), ("l_tax", "Tax")]
_OBLOCK = ("chr(10) || '[Time: Onset+0h]' || chr(10) || " + " || ".join(f"'{n}: ' || {fmt_num('l.' + v)} || chr(10)" for v, n in _OF))

OUTCOME_QUESTION = f"""WITH {CHAIN}
SELECT c.o_orderkey AS record_id,
  '[Patient Information]' || chr(10) || 'Segment: ' || any_value(c.c_mktsegment) || chr(10) || 'Nation: ' || any_value(c.n_name) || chr(10)
   || string_agg({_OBLOCK}, '' ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice)
   || 'Q. Is the order likely to ship within 30 days?' || chr(10) || 'A. Yes' || chr(10) || 'B. No' AS user_message,
  CASE WHEN any_value(c.label) THEN 'A' ELSE 'B' END AS label_0, 'ship30' AS task, ['Yes', 'No'] AS choices_0
FROM chain c JOIN lineitem l ON l.l_orderkey = c.o_orderkey GROUP BY c.o_orderkey"""


def _slot_wide() -> str:
    cells = []
    for d in (1, 2, 3):
        cells.append(f"nullif(count(*) FILTER (d = {d - 1}), 0) AS d{d}_events")
        for t in (1, 2, 3):
            here = f"FILTER (d = {d - 1} AND t = {t - 1})"
            cells += [f"max(event_id) {here} AS d{d}_{t}_last_event", f"round(max(value) {here}, 4) AS d{d}_{t}_top"]
    return f"""SELECT user_id, {", ".join(cells)}
FROM (SELECT *, day(ts) % 3 AS d, hour(ts) // 8 AS t FROM events) GROUP BY user_id"""


SLOT_ROUND_TRIP = _slot_wide()
SLOT_ROWS = f"""WITH w AS ({_slot_wide()}),
u AS (""" + " UNION ALL ".join(
    [f"SELECT user_id, {d} AS day, NULL::INT AS slot, 'events' AS variable, CAST(d{d}_events AS VARCHAR) AS value FROM w" for d in (1, 2, 3)]
    + [f"SELECT user_id, {d}, {t}, '{v}', CAST(d{d}_{t}_{v} AS VARCHAR) FROM w" for d in (1, 2, 3) for t in (1, 2, 3) for v in ("last_event", "top")]
) + ") SELECT * FROM u WHERE value IS NOT NULL"
