"""DuckDB SQL for profiling outputs and mutual information."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import PROFILE_CTES
from quizloom.sources.registry import COL_DICT, registry_sql

HEAD = f"WITH {registry_sql()},\n{PROFILE_CTES}"

COL_VALUES = HEAD + """
SELECT var, value, CAST(n AS BIGINT) AS n FROM vals"""

COL_PROFILE = HEAD + """
SELECT s.var, v.value, CAST(v.n AS BIGINT) AS n, round(v.weight, 6) AS weight, s.n_keys, s.n_vocab,
       round(s.float_ratio, 6) AS float_ratio, s.is_numeric
FROM summary s LEFT JOIN vocab v ON s.var = v.var"""

NUMERIC_SHAPE = HEAD + """
SELECT var, n_keys, num_min, num_max, drop_negative, round_int FROM summary WHERE is_numeric"""

GM_TERCILES = HEAD + """
SELECT var, list_transform(gm_means, lambda x: round(x, 6)) AS gm_means,
       list_transform(gm_stds, lambda x: round(x, 6)) AS gm_stds,
       list_transform(gm_weights, lambda x: round(x, 6)) AS gm_weights FROM gm"""


def _mi_body(only_discrete: bool = False) -> str:
    cont = "FALSE" if only_discrete else "(s.is_numeric AND s.n_vocab = 0 AND s.n_keys > 30)"
    return HEAD + f""",
kinds AS (SELECT var, n_keys <= 30 AS disc, {cont.replace('s.', '')} AS cont, num_min, num_max FROM stats WHERE keep),
usable AS (SELECT * FROM kinds WHERE disc OR cont),
dcodes AS (SELECT v.var, v.value, CAST(dense_rank() OVER (PARTITION BY v.var ORDER BY v.value) - 1 AS INTEGER) AS code
  FROM vals v JOIN usable k ON v.var = k.var WHERE k.disc AND v.value IS NOT NULL),
coded AS (
  SELECT l.record_id, l.var,
    CASE WHEN k.disc THEN CASE WHEN {missing_sql('l.value')} THEN -1 ELSE coalesce(d.code, -1) END
         WHEN TRY_CAST(l.value AS DOUBLE) IS NULL THEN -1
         WHEN NOT (k.num_max > k.num_min) THEN 0
         ELSE least(CAST(floor((TRY_CAST(l.value AS DOUBLE) - k.num_min) / (k.num_max - k.num_min) * 16) AS INTEGER), 15) END AS c
  FROM long l JOIN usable k ON l.var = k.var LEFT JOIN dcodes d ON d.var = l.var AND d.value = l.value),
dir AS (SELECT a.var AS target, b.var AS feature, a.c AS ct, b.c AS cf, count(*) AS n
  FROM coded a JOIN coded b ON a.record_id = b.record_id AND a.var <> b.var WHERE a.c <> -1 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY target, feature) AS n_tf,
    sum(n) OVER (PARTITION BY target, feature, ct) AS nt, sum(n) OVER (PARTITION BY target, feature, cf) AS nf FROM dir),
mi AS (SELECT target, feature, greatest(sum(n / n_tf * ln(n * n_tf / (nt * nf))), 0.0) AS mi, CAST(any_value(n_tf) AS BIGINT) AS n_rows
  FROM w GROUP BY target, feature HAVING any_value(n_tf) >= 3)"""


def missing_sql(x):
    return f"({x} IS NULL OR {x} IN ('', 'NA', 'N/A') OR lower({x}) = 'nan')"


def dated_head() -> str:
    """The profile CTEs over the registry with its date in minutes since the beginning of the record's year."""
    base = registry_sql().replace("\nregistry AS (", "\nregistry0 AS (")
    return f"""WITH {base},
registry AS (SELECT * REPLACE (CAST(date_diff('minute', date_trunc('year', CAST(order_date AS DATE)), CAST(order_date AS DATE)) AS VARCHAR)
  AS order_date) FROM registry0),
{PROFILE_CTES}"""


def mi_quantile_sql() -> str:
    body = _mi_body(False).replace(HEAD, dated_head() + """,
shares AS (SELECT var, x, CAST(dense_rank() OVER (PARTITION BY var ORDER BY floor(lo * 16 / n_tot)) - 1 AS INTEGER) AS code FROM hcum)""")
    begin, end = body.index("         WHEN NOT (k.num_max"), body.index(" END AS c\n")
    body = body[:begin] + "         ELSE q.code" + body[end:]
    body = body.replace("AND d.value = l.value)", "AND d.value = l.value\n"
                        "  LEFT JOIN shares q ON q.var = l.var AND q.x = TRY_CAST(l.value AS DOUBLE))")
    body = body.replace("HAVING any_value(n_tf) >= 3", """HAVING any_value(n_tf) >= 3
    AND coalesce(min(CASE WHEN target IN (SELECT var FROM usable WHERE disc) THEN nt END), 3) >= 3
    AND coalesce(min(CASE WHEN feature IN (SELECT var FROM usable WHERE disc) THEN nf END), 3) >= 3""")
    return body + "\nSELECT target, feature, round(mi, 6) AS mi, n_rows FROM mi"


def mi_knn_sql(rows: int, k: int = 3, jitter: float = 1e-10) -> str:
    from quizloom.plans.oracle.mcq_sql import u_
    return dated_head() + f""",
usable AS (SELECT var, n_keys <= 30 AS disc FROM stats WHERE keep AND (n_keys <= 30 OR is_numeric AND n_vocab = 0)),
ids AS (SELECT record_id FROM registry ORDER BY {u_('ids', 'record_id')}, record_id LIMIT {rows}),
dcodes AS (SELECT v.var, v.value, CAST(dense_rank() OVER (PARTITION BY v.var ORDER BY v.value) - 1 AS DOUBLE) AS code
  FROM vals v JOIN usable k ON v.var = k.var WHERE k.disc AND v.value IS NOT NULL),
cells AS (SELECT l.record_id, l.var, k.disc, CASE WHEN {missing_sql('l.value')} THEN NULL WHEN k.disc THEN d.code
    ELSE TRY_CAST(l.value AS DOUBLE) END AS x, {u_('knn', 'l.record_id', 'l.var')} AS u
  FROM long l JOIN ids USING (record_id) JOIN usable k ON k.var = l.var LEFT JOIN dcodes d ON d.var = l.var AND d.value = l.value),
raw AS (SELECT t.var AS target, f.var AS feature, t.record_id, t.disc AS td, f.disc AS fd, t.x AS tx, coalesce(f.x, -1) AS fx, t.u AS tu, f.u AS fu
  FROM cells t JOIN cells f ON t.record_id = f.record_id AND t.var <> f.var WHERE t.x IS NOT NULL AND NOT (t.disc AND f.disc)),
sizes AS (SELECT *, count(*) OVER p AS n, count(*) OVER (PARTITION BY target, feature, tx) AS nt, count(*) OVER (PARTITION BY target, feature, fx) AS nf,
    coalesce(nullif(stddev_pop(tx) OVER p, 0), 1) AS ts, coalesce(nullif(stddev_pop(fx) OVER p, 0), 1) AS fs FROM raw WINDOW p AS (PARTITION BY target, feature)),
means AS (SELECT *, avg(abs(tx / ts)) OVER p AS tm, avg(abs(fx / fs)) OVER p AS fm, min(CASE WHEN td THEN nt WHEN fd THEN nf END) OVER p AS rarest
  FROM sizes WINDOW p AS (PARTITION BY target, feature)),
pts AS MATERIALIZED (SELECT target, feature, record_id, n, td OR fd AS mixed, CASE WHEN td THEN tx ELSE fx END AS cls, CASE WHEN td THEN nt ELSE nf END AS size,
    CASE WHEN td THEN 0 ELSE tx / ts + {jitter} * greatest(1, tm) * (tu - CAST(0.5 AS DOUBLE)) END AS a,
    CASE WHEN fd THEN 0 ELSE fx / fs + {jitter} * greatest(1, fm) * (fu - CAST(0.5 AS DOUBLE)) END AS b
  FROM means WHERE n >= 3 AND coalesce(rarest, 3) >= 3),
kept AS MATERIALIZED (SELECT * FROM pts WHERE NOT mixed OR size > 1),
near AS (SELECT x.target, x.feature, x.record_id,
    list_sort(list(greatest(abs(x.a - y.a), abs(x.b - y.b))))[1 + least({k}, min(CASE WHEN x.mixed THEN x.size ELSE x.n END) - 1)] AS r
  FROM kept x JOIN kept y ON x.target = y.target AND x.feature = y.feature AND (NOT x.mixed OR x.cls = y.cls) GROUP BY ALL),
counted AS (SELECT x.target, x.feature, x.record_id, any_value(x.mixed) AS mixed, any_value(x.size) AS size, any_value(x.n) AS n,
    CAST(count(*) FILTER (abs(x.a - y.a) < r) AS BIGINT) AS na, CAST(count(*) FILTER (abs(x.b - y.b) < r) AS BIGINT) AS nb,
    CAST(count(*) FILTER (greatest(abs(x.a - y.a), abs(x.b - y.b)) < r) AS BIGINT) AS nm
  FROM kept x JOIN near USING (target, feature, record_id) JOIN kept y ON x.target = y.target AND x.feature = y.feature
  GROUP BY x.target, x.feature, x.record_id),
psi AS (SELECT n, -0.5772156649015329::DOUBLE + coalesce(sum(CASE WHEN n > 1 THEN CAST(1 AS DOUBLE) / (n - 1) END) OVER (ORDER BY n), 0) AS v
  FROM range(1, {rows} + 2) t(n)),
total AS (SELECT target, feature, count(*) AS kept_n, any_value(n) AS n, any_value(mixed) AS mixed FROM counted GROUP BY ALL)
SELECT target, feature, round(greatest(0.0, any_value(pn.v) + CASE WHEN any_value(t.mixed)
    THEN avg(pk.v) - avg(ps.v) - avg(pm.v) ELSE any_value(pk.v) - avg(pa.v) - avg(pb.v) END), 6) AS mi, CAST(any_value(t.n) AS BIGINT) AS n_rows
FROM counted c JOIN total t USING (target, feature) JOIN psi pn ON pn.n = t.kept_n
  JOIN psi pk ON pk.n = least({k}, CASE WHEN c.mixed THEN c.size ELSE c.n END - 1) JOIN psi ps ON ps.n = c.size
  JOIN psi pm ON pm.n = greatest(1, c.nm) JOIN psi pa ON pa.n = greatest(1, c.na) JOIN psi pb ON pb.n = greatest(1, c.nb)
GROUP BY target, feature"""


MI_DISCRETE = _mi_body(True) + "\nSELECT target, feature, round(mi, 6) AS mi, n_rows FROM mi"
MI_BINNED = _mi_body(False) + "\nSELECT target, feature, round(mi, 6) AS mi, n_rows FROM mi"
CORRELATED = _mi_body(False) + """
SELECT target, list_sort(list(feature)) AS correlated FROM mi WHERE mi > {cutoff} GROUP BY target"""



def mcq_multi_sql(cutoff: float = 0.5, k: int = 2) -> str:
    from itertools import groupby
    from quizloom.plans.oracle.mcq_sql import distractor_ctes, u_
    from quizloom.sources.registry import COL_DICT, VARS
    qrows = " UNION ALL ".join(f"SELECT record_id, '{v}' AS var, CAST({v} AS VARCHAR) AS label_raw FROM registry" for v in VARS)
    blocks = []
    for sec, items in groupby(COL_DICT, key=lambda t: t[2]):
        items = list(items)
        pres = {c: f"(r.{c} IS NOT NULL AND r.{c} <> '' AND NOT list_contains(x.drop_, '{c}'))" for c, _, _ in items}
        lines = [f"CASE WHEN {pres[c]} THEN '{n}: ' || CASE WHEN list_contains(x.victims, '{c}') THEN '[MASK]' ELSE r.{c} END END"
                 for c, n, _ in items]
        blocks.append(f"CASE WHEN {' OR '.join(pres.values())} THEN concat_ws(chr(10), '{sec}', {', '.join(lines)}) END")
    text = f"concat_ws(chr(10) || chr(10), {', '.join(blocks)})"
    names = lambda v: "CASE " + v + " " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n, _ in COL_DICT) + " END"
    secs = lambda v: "CASE " + v + " " + " ".join(f"WHEN '{a}' THEN '{s}'" for a, _, s in COL_DICT) + " END"

    def shuf(ch, qid):
        return (f"list_transform(list_sort(list_transform({ch}, lambda c: {{'k': {u_('shuffle', qid, 'c')}, 'v': c}})), "
                f"lambda s: s.v)")

    def render(o):
        return f"array_to_string(list_transform({o}, lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || c), chr(10))"

    pick = "QUALIFY row_number() OVER (PARTITION BY d.record_id ORDER BY d.u_) = 1"
    own = "d.var AS var{0}, d.qid AS qid{0}, d.label AS label{0}, d.choices AS choices{0}"
    picks = [f"p0 AS (SELECT d.record_id, {own.format(0)}, [d.var] AS victims, coalesce(f.f, []::VARCHAR[]) AS drop_ "
             f"FROM d LEFT JOIN feats f ON f.target = d.var {pick})"]
    for i in range(1, k):
        picks.append(f"p{i} AS (SELECT p.* EXCLUDE (victims, drop_), {own.format(i)}, list_append(p.victims, d.var) AS victims, "
                     f"list_concat(p.drop_, coalesce(f.f, []::VARCHAR[])) AS drop_ FROM d JOIN p{i - 1} p ON p.record_id = d.record_id "
                     f"LEFT JOIN feats f ON f.target = d.var "
                     f"WHERE NOT list_contains(p.victims, d.var) AND NOT list_contains(p.drop_, d.var) {pick})")
    mixed = ", ".join(f"{shuf(f'choices{i}', f'qid{i}')} AS sh{i}, CAST(floor({u_('pos', f'qid{i}')} * (len(choices{i}) + 1)) AS INTEGER) AS i{i}"
                      for i in range(k))
    options = ", ".join(f"list_concat(list_slice(sh{i}, 1, i{i}), [label{i}], list_slice(sh{i}, i{i} + 1, len(sh{i}))) AS choices_{i}" for i in range(k))
    questions = " || chr(10) || ".join(
        f"printf('Q{i + 1}. What would be the masked value of ''%s'' in section %s?', {names(f'x.var{i}')}, {secs(f'x.var{i}')})"
        f" || chr(10) || {render(f'x.choices_{i}')}" for i in range(k))
    return _mi_body(False) + f""",
q0 AS (SELECT record_id, var, label_raw, CAST(record_id AS VARCHAR) || '|' || var AS qid FROM ({qrows})
  WHERE label_raw IS NOT NULL AND label_raw NOT IN ('', 'NA') AND var IN (SELECT var FROM summary)),
{distractor_ctes()},
d AS (SELECT record_id, var, qid, label, choices, {u_('pick', 'record_id', 'var')} AS u_ FROM ch1),
feats AS (SELECT target, list(feature) AS f FROM mi WHERE mi > {cutoff} GROUP BY target),
{", ".join(picks)},
qq AS (SELECT *, {mixed} FROM p{k - 1}),
x AS (SELECT *, {options} FROM qq)
SELECT x.record_id, {text} || chr(10) || {questions} AS user_message,
  {", ".join(f"chr(65 + x.i{i}) AS label_{i}" for i in range(k))}, {", ".join(f"x.choices_{i}" for i in range(k))}, x.victims
FROM x JOIN registry r ON x.record_id = r.record_id"""


MERGED_PROFILE = HEAD + """
SELECT s.var, d.display_name, d.section, s.n_keys, s.n_rows, s.n_vocab, s.vocab_total, round(s.float_ratio, 6) AS float_ratio,
  s.is_numeric, s.drop_negative, s.round_int
FROM summary s JOIN (VALUES """ + ", ".join(f"('{v}', '{n}', '{x}')" for v, n, x in COL_DICT) + """) d(var, display_name, section) ON d.var = s.var"""
