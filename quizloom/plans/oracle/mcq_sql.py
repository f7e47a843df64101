"""DuckDB SQL for profiling and the multiple-choice question builder."""

from __future__ import annotations

from quizloom.functions.hashing import sql_u
from quizloom.sources.registry import COL_DICT, VARS, registry_sql

SEED = 42


def U(tag: str, *parts: str) -> str:
    return sql_u(SEED, f"'{tag}'", *parts).replace("CAST('", "CAST('", 1)


def u_(tag, *parts):
    # hash key = seed|tag|parts...
    key = "concat_ws('|', '42', '" + tag + "'" + "".join(f", CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"((CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def bucket(x: str, b: int = 64) -> str:
    return f"(CAST('0x' || substr(md5(coalesce({x}, '')), 1, 7) AS BIGINT) % {b})"


def missing(x: str) -> str:
    return f"({x} IS NULL OR {x} IN ('', 'NA', 'N/A') OR lower({x}) = 'nan')"


def long_sql(vars_=VARS) -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT record_id, '{v}' AS var, CAST({v} AS VARCHAR) AS value FROM registry" for v in vars_) + ")"


def profile_ctes(long_cte: str) -> str:
    return long_cte + ",\n" + _PROFILE_BODY


_PROFILE_BODY = f"""vals AS (SELECT var, CASE WHEN NOT {missing('value')} THEN value END AS value, count(*) AS n FROM long GROUP BY ALL),
st0 AS (SELECT var,
    CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_keys,
    max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS has_missing,
    CAST(count(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS n_float_keys,
    CAST(count(DISTINCT TRY_CAST(value AS DOUBLE)) AS BIGINT) AS n_float_distinct,
    CAST(sum(CASE WHEN TRY_CAST(value AS DOUBLE) >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos_keys,
    CAST(sum(CASE WHEN floor(TRY_CAST(value AS DOUBLE)) = TRY_CAST(value AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_int_keys,
    CAST(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_rows,
    min(TRY_CAST(value AS DOUBLE)) AS num_min, max(TRY_CAST(value AS DOUBLE)) AS num_max
  FROM vals GROUP BY var),
stats AS (SELECT var, n_keys, n_rows, num_min, num_max,
    n_float_distinct > 20 AS is_numeric,
    CAST(n_keys - CASE WHEN n_float_distinct > 20 THEN n_float_keys ELSE 0 END AS BIGINT) AS n_vocab,
    CASE WHEN n_float_distinct > 20 THEN n_float_keys / n_keys ELSE 0.0 END AS float_ratio,
    (n_float_distinct > 20 AND n_pos_keys > n_float_keys * 0.95) AS drop_negative,
    (n_float_distinct > 20 AND n_int_keys > n_float_keys * 0.9) AS round_int,
    (n_keys + has_missing > 1) AND NOT ((n_keys - CASE WHEN n_float_distinct > 20 THEN n_float_keys ELSE 0 END) > 20
       AND (regexp_matches(var, 'date|time|dat_ou') OR var = 'tzdt' OR suffix(var, 'desc')
            OR var IN ('Unique ID', 'record_id', 'sepsisinkcd', 'othernonsurgprocedure', 'operationname',
                       'gramposot', 'gramnegot', 'bacposspecot', 'fugusot'))) AS keep
  FROM st0),
vocab AS (SELECT v.var, v.value, v.n, v.n / sum(v.n) OVER (PARTITION BY v.var) AS weight,
    CAST(coalesce(sum(v.n) OVER (PARTITION BY v.var ORDER BY {bucket('v.value')}, v.value
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo
  FROM vals v JOIN stats s ON v.var = s.var
  WHERE s.keep AND v.value IS NOT NULL AND (NOT s.is_numeric OR TRY_CAST(v.value AS DOUBLE) IS NULL)),
all_vocab AS (SELECT v.var, v.value,
    CAST(row_number() OVER (PARTITION BY v.var ORDER BY {bucket('v.value')}, v.value) - 1 AS BIGINT) AS idx
  FROM vals v JOIN stats s ON v.var = s.var WHERE s.keep AND v.value IS NOT NULL),
summary AS (SELECT s.var, s.n_keys, s.n_rows, s.num_min, s.num_max, s.is_numeric, s.n_vocab, s.float_ratio,
    s.drop_negative, s.round_int,
    coalesce((SELECT CAST(sum(n) AS BIGINT) FROM vocab x WHERE x.var = s.var), 0) AS vocab_total,
    coalesce((SELECT CAST(count(*) AS BIGINT) FROM all_vocab x WHERE x.var = s.var), 0) AS n_all
  FROM stats s WHERE s.keep),
hist AS (SELECT v.var, TRY_CAST(v.value AS DOUBLE) AS x, sum(v.n) AS n FROM vals v JOIN stats s ON v.var = s.var
  WHERE s.keep AND s.is_numeric AND TRY_CAST(v.value AS DOUBLE) IS NOT NULL GROUP BY ALL),
hcum AS (SELECT var, x, n, coalesce(sum(n) OVER (PARTITION BY var ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
    sum(n) OVER (PARTITION BY var) AS n_tot FROM hist),
hb AS (SELECT *, floor(n_tot / 3) + CASE WHEN n_tot % 3 >= 1 THEN 1 ELSE 0 END AS b1,
    floor(n_tot / 3) * 2 + CASE WHEN n_tot % 3 >= 1 THEN 1 ELSE 0 END + CASE WHEN n_tot % 3 >= 2 THEN 1 ELSE 0 END AS b2 FROM hcum),
hp AS (
  SELECT var, n_tot, x, 0 AS k, greatest(0, least(lo + n, b1) - greatest(lo, 0)) AS c FROM hb
  UNION ALL SELECT var, n_tot, x, 1, greatest(0, least(lo + n, b2) - greatest(lo, b1)) FROM hb
  UNION ALL SELECT var, n_tot, x, 2, greatest(0, least(lo + n, n_tot) - greatest(lo, b2)) FROM hb),
hm AS (SELECT var, k, sum(c) AS cnt, sum(c * x) / sum(c) AS mean, any_value(n_tot) AS n_tot FROM hp WHERE c > 0 GROUP BY var, k),
hs AS (SELECT p.var, p.k, sum(p.c * (p.x - m.mean) * (p.x - m.mean)) AS ss FROM hp p JOIN hm m ON p.var = m.var AND p.k = m.k
  WHERE p.c > 0 GROUP BY p.var, p.k),
comp AS (SELECT m.var, m.k, m.mean, sqrt(s.ss / m.cnt + 1e-6) AS std, m.cnt / m.n_tot AS w FROM hm m JOIN hs s ON m.var = s.var AND m.k = s.k),
gm AS (SELECT s.var,
    [coalesce((SELECT mean FROM comp c WHERE c.var = s.var AND c.k = 0), 0.0), coalesce((SELECT mean FROM comp c WHERE c.var = s.var AND c.k = 1), 0.0), coalesce((SELECT mean FROM comp c WHERE c.var = s.var AND c.k = 2), 0.0)] AS gm_means,
    [coalesce((SELECT std FROM comp c WHERE c.var = s.var AND c.k = 0), 0.0), coalesce((SELECT std FROM comp c WHERE c.var = s.var AND c.k = 1), 0.0), coalesce((SELECT std FROM comp c WHERE c.var = s.var AND c.k = 2), 0.0)] AS gm_stds,
    [coalesce((SELECT w FROM comp c WHERE c.var = s.var AND c.k = 0), 0.0), coalesce((SELECT w FROM comp c WHERE c.var = s.var AND c.k = 1), 0.0), coalesce((SELECT w FROM comp c WHERE c.var = s.var AND c.k = 2), 0.0)] AS gm_weights
  FROM stats s WHERE s.keep)"""

PROFILE_CTES = profile_ctes(long_sql())


def em_ctes(rounds: int = 30, bins: int = 2048) -> str:
    """``gm`` by EM: every step a CTE over the histogram of equal shares."""
    ks = range(3)
    steps = []
    for i in range(1, rounds + 1):
        logs = ", ".join(f"-0.5::DOUBLE * (z - m{k}) * (z - m{k}) / v{k} - 0.5::DOUBLE * ln(2 * pi() * v{k}) + ln(greatest(w{k}, 1e-300::DOUBLE)) AS l{k}" for k in ks)
        sums = ", ".join(f"sum(r{k}) AS a{k}, sum(r{k} * z) AS b{k}, sum(r{k} * z * z) AS c{k}, sum(r{k}) + pow(2::DOUBLE, -49) AS k{k}, "
                         f"sum(r{k} * z) / (sum(r{k}) + pow(2::DOUBLE, -49)) AS m{k}" for k in ks)
        steps.append(f"""em{i} AS MATERIALIZED (SELECT var, center, spread, reg, m0, m1, m2,
    {", ".join(f"greatest((c{k} - 2 * m{k} * b{k} + m{k} * m{k} * a{k}) / k{k}, 0) + reg AS v{k}" for k in ks)},
    {", ".join(f"k{k} / (k0 + k1 + k2) AS w{k}" for k in ks)}
  FROM (SELECT var, any_value(center) AS center, any_value(spread) AS spread, any_value(reg) AS reg, {sums}
    FROM (SELECT var, center, spread, reg, z, {", ".join(f"exp(l{k} - lse) * n AS r{k}" for k in ks)}
      FROM (SELECT *, top + ln({" + ".join(f"exp(l{k} - top)" for k in ks)}) AS lse
        FROM (SELECT *, greatest(l0, l1, l2) AS top FROM (SELECT h.var, center, spread, reg, z, n, {logs} FROM emh h JOIN em{i - 1} USING (var))))) GROUP BY var))""")
    return f"""emx AS (SELECT var, sum(x * n) / sum(n) AS x, CAST(sum(n) AS DOUBLE) AS n FROM hcum
  GROUP BY var, floor(lo * {bins} / n_tot)),
emt AS (SELECT var, sum(x * n) / sum(n) AS center, sum(n) AS tot FROM emx GROUP BY var),
ems AS (SELECT x.var, any_value(center) AS center, any_value(tot) AS tot,
    coalesce(nullif(sqrt(sum(n * (x - center) * (x - center)) / sum(n)), 0), 1) AS spread FROM emx x JOIN emt USING (var) GROUP BY x.var),
emh AS MATERIALIZED (SELECT x.var, (x - center) / spread AS z, n FROM emx x JOIN ems USING (var)),
emq AS (SELECT var, z, sum(n) OVER (PARTITION BY var ORDER BY z) / tot AS share FROM emh JOIN ems USING (var)),
em0 AS MATERIALIZED (SELECT s.var, any_value(center) AS center, any_value(spread) AS spread, any_value(1e-6::DOUBLE / spread / spread) AS reg,
    {", ".join(f"coalesce(min(CASE WHEN share >= {2 * k + 1}::DOUBLE / 6 THEN z END), max(z)) AS m{k}" for k in ks)},
    {", ".join(f"1 + any_value(1e-6::DOUBLE / spread / spread) AS v{k}" for k in ks)}, {", ".join(f"1::DOUBLE / 3 AS w{k}" for k in ks)}
  FROM ems s JOIN emq USING (var) GROUP BY s.var),
{(","+chr(10)).join(steps)},
gm AS (SELECT s.var, CASE WHEN e.var IS NULL THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [{", ".join(f"center + spread * round(m{k}, 7)" for k in ks)}] END AS gm_means,
    CASE WHEN e.var IS NULL THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [{", ".join(f"spread * round(sqrt(v{k}), 7)" for k in ks)}] END AS gm_stds,
    CASE WHEN e.var IS NULL THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [round(w0, 7), round(w1, 7), round(1 - (round(w0, 7) + round(w1, 7)), 7)] END AS gm_weights
  FROM stats s LEFT JOIN em{rounds} e ON e.var = s.var WHERE s.keep)"""


def with_em(sql: str, rounds: int = 30) -> str:
    """A query over the profile CTEs with the EM mixture in place of the terciles'."""
    begin = sql.index("hb AS (")
    end = sql.index("FROM stats s WHERE s.keep)", begin) + len("FROM stats s WHERE s.keep)")
    return sql[:begin] + em_ctes(rounds) + sql[end:]


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\d)\\.0+$', '\\1'), '(\\.\\d*?[1-9])0+$', '\\1')"


def _section_text(target: str = "q.var", drop: str = "q.drop_") -> str:
    """T2 sectioned serialiser over the registry columns (r.*): target masked, columns in ``drop`` left out."""
    from itertools import groupby
    blocks = []
    for sec, items in groupby(COL_DICT, key=lambda t: t[2]):
        items = list(items)
        shown = {c: f"(r.{c} IS NOT NULL AND r.{c} <> '' AND NOT list_contains({drop}, '{c}'))" for c, _, _ in items}
        lines = [f"CASE WHEN {shown[c]} THEN '{n}: ' || CASE WHEN {target} = '{c}' THEN '[MASK]' ELSE r.{c} END END"
                 for c, n, _ in items]
        anyp = " OR ".join(shown.values())
        blocks.append(f"CASE WHEN {anyp} THEN concat_ws(chr(10), '{sec}', {', '.join(lines)}) END")
    return f"concat_ws(chr(10) || chr(10), {', '.join(blocks)})"


def _flat_text(target: str = "q.var") -> str:
    lines = [f"CASE WHEN r.{c} IS NOT NULL AND r.{c} <> '' THEN '{n}: ' || CASE WHEN {target} = '{c}' THEN '[MASK]' ELSE trim(r.{c}) END END"
             for c, n, _ in COL_DICT]
    return f"concat_ws(chr(10), {', '.join(lines)})"


def distractor_ctes(n_choices: int = 5, difficulty: float = 2.0, pick_one: bool = False) -> str:
    """CTEs from a ``q0(record_id, var, label_raw, qid)`` to ``ch2(record_id, var, qid, label, choices)``."""
    nm1 = n_choices - 1
    binom = " + ".join(f"CASE WHEN {u_('binom', 'qid', str(j))} < 1 - float_ratio THEN 1 ELSE 0 END" for j in range(nm1))
    rounds = []
    prev = "q3"
    for j in range(nm1):
        r = f"CAST(floor({u_('cat', 'p.qid', str(j))} * (p.vocab_total - p.excl_tot)) AS BIGINT)"
        rp = f"list_reduce(list_sort(p.excl), lambda acc, e: CASE WHEN e.lo <= acc THEN acc + e.n ELSE acc END, {r})"
        rounds.append(f"""
r{j}a AS (SELECT p.*, CASE WHEN p.k_cat > {j} THEN {rp} END AS rp FROM {prev} p),
r{j} AS (SELECT a.* EXCLUDE (rp, excl, excl_tot, cat_vals, cat_idx),
    CASE WHEN b.lo IS NOT NULL THEN list_append(a.excl, {{'lo': b.lo, 'n': b.n}}) ELSE a.excl END AS excl,
    a.excl_tot + coalesce(b.n, 0) AS excl_tot,
    CASE WHEN b.lo IS NOT NULL THEN list_append(a.cat_vals, b.value) ELSE a.cat_vals END AS cat_vals,
    CASE WHEN b.lo IS NOT NULL THEN list_append(a.cat_idx, b.idx) ELSE a.cat_idx END AS cat_idx
  FROM r{j}a a LEFT JOIN lk b ON a.var = b.var AND b.lo IS NOT NULL AND b.lo <= a.rp AND a.rp < b.lo + b.n)""")
        prev = f"r{j}"
    ux, uc, uo = u_("gmx", "qid"), u_("comp", "qid"), u_("order", "qid")
    pdf = ("CASE WHEN gm_stds[{i}] > 0 THEN exp(-pow((x - gm_means[{i}]) / gm_stds[{i}], 2) / 2) "
           "/ (gm_stds[{i}] * sqrt(2 * pi())) * gm_weights[{i}] ELSE 0.0 END")
    nums = f"list_transform(list_filter(range(0, k_num + 1), lambda i: i != ord_), lambda i: x + {float(difficulty)} * (i - ord_) * gm_stds[comp + 1])"
    ufb = u_("fb", "qid", "j")
    draw = (f"list_reduce(range(0, kfb), lambda acc, j: list_append(acc, "
            f"list_reduce(list_sort(list_concat(eidx, acc)), lambda a, e: CASE WHEN e <= a THEN a + 1 ELSE a END, "
            f"CAST(floor({ufb} * (n_all - len(eidx) - j)) AS BIGINT))), []::BIGINT[])")
    fbj = "\n".join(
        f"LEFT JOIN all_vocab f{j} ON f{j}.var = n.var AND len(n.fb_idx) > {j} AND f{j}.idx = n.fb_idx[{j + 1}]"
        for j in range(nm1))
    fbv = "list_filter([" + ", ".join(f"f{j}.value" for j in range(nm1)) + "], lambda v: v IS NOT NULL)"
    return f"""lk AS (SELECT a.var, a.value, a.idx, v.lo, v.n FROM all_vocab a LEFT JOIN vocab v ON a.var = v.var AND a.value = v.value),
q1 AS (SELECT q0.*, CASE WHEN TRY_CAST(label_raw AS DOUBLE) IS NOT NULL THEN CAST(TRY_CAST(label_raw AS DOUBLE) AS VARCHAR) ELSE label_raw END AS label_c,
    TRY_CAST(label_raw AS DOUBLE) AS label_d, s.float_ratio, s.n_vocab, s.vocab_total, s.n_all, s.drop_negative, s.round_int,
    g.gm_means, g.gm_stds, g.gm_weights
  FROM q0 JOIN summary s ON q0.var = s.var JOIN gm g ON q0.var = g.var),
q2 AS (SELECT q1.*, l.idx AS lab_idx, l.lo AS lab_lo, l.n AS lab_n,
    (float_ratio = 0 AND n_vocab <= {n_choices}) AS b1, CASE WHEN l.lo IS NULL THEN 0 ELSE 1 END AS in_vocab,
    ({binom}) AS binom
  FROM q1 LEFT JOIN lk l ON q1.var = l.var AND q1.label_raw = l.value),
q3a AS (SELECT *, CASE WHEN b1 THEN n_vocab - in_vocab ELSE least(binom, n_vocab - CASE WHEN label_d IS NULL THEN 1 ELSE 0 END) END AS kref FROM q2),
q3 AS (SELECT *, greatest(least(kref, n_vocab - in_vocab), 0) AS k_cat, CASE WHEN b1 THEN 0 ELSE {nm1} - kref END AS k_num,
    CASE WHEN lab_lo IS NULL THEN []::STRUCT(lo BIGINT, n BIGINT)[] ELSE [{{'lo': lab_lo, 'n': lab_n}}] END AS excl,
    coalesce(lab_n, 0) AS excl_tot, []::VARCHAR[] AS cat_vals, []::BIGINT[] AS cat_idx FROM q3a),
{",".join(rounds)},
nx AS (SELECT *, CASE WHEN label_d IS NOT NULL THEN label_d ELSE gm_means[CASE WHEN {ux} < gm_weights[1] THEN 1 WHEN {ux} < gm_weights[1] + gm_weights[2] THEN 2 ELSE 3 END] END AS x FROM {prev}),
ns AS (SELECT *, {pdf.format(i=1)} AS s0, {pdf.format(i=2)} AS s1, {pdf.format(i=3)} AS s2 FROM nx),
nc AS (SELECT *, CASE WHEN {uc} * (s0 + s1 + s2) < s0 THEN 0 WHEN {uc} * (s0 + s1 + s2) < s0 + s1 THEN 1 ELSE 2 END AS comp, s0 + s1 + s2 AS ssum FROM ns),
nf AS (SELECT *, (k_num > 0 AND (ssum = 0 OR gm_stds[comp + 1] < 0.1)) AS fb, CAST(floor({uo} * (k_num + 1)) AS INTEGER) AS ord_ FROM nc),
nn AS (SELECT *, CASE WHEN k_num > 0 AND NOT fb THEN
      CASE WHEN drop_negative THEN list_filter({nums}, lambda v: v >= 0) ELSE {nums} END ELSE []::DOUBLE[] END AS nums,
    list_concat(CASE WHEN lab_idx IS NULL THEN []::BIGINT[] ELSE [lab_idx] END, cat_idx) AS eidx FROM nf),
nk AS (SELECT *, CASE WHEN fb THEN greatest(least(k_num, n_all - len(eidx)), 0) ELSE 0 END AS kfb,
    CASE WHEN round_int THEN list_transform(nums, lambda v: CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR))
         ELSE list_transform(nums, lambda v: CAST(CAST(round_even(v, 1) AS DECIMAL(38, 1)) AS VARCHAR)) END AS num_vals FROM nn),
nd AS (SELECT *, CASE WHEN kfb > 0 THEN {draw} ELSE []::BIGINT[] END AS fb_idx FROM nk),
fin AS (SELECT n.*, CASE WHEN len(n.fb_idx) > 0 THEN {fbv} END AS fb_vals FROM nd n {fbj}),
ch AS (SELECT record_id, var, qid, {strip_sql('label_c')} AS label,
    list_sort(list_distinct(list_filter(list_transform(list_filter(list_concat(cat_vals, coalesce(fb_vals, num_vals)), lambda c: c != 'nan'),
      lambda c: {strip_sql('c')}), lambda c: c != {strip_sql('label_c')}))) AS choices FROM fin),
ch1 AS (SELECT * FROM ch WHERE len(choices) > 0),
ch2 AS ({"SELECT * FROM ch1 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY " + u_('pick', 'record_id', 'var') + ") = 1" if pick_one else "SELECT * FROM ch1"})"""


def mcq_sql(n_choices: int = 5, difficulty: float = 2.0, targets=None, extra_where: str = "TRUE",
            pick_one: bool = False, sectioned: bool = True) -> str:
    nm1 = n_choices - 1
    targets = targets or VARS
    qrows = " UNION ALL ".join(f"SELECT record_id, '{v}' AS var, CAST({v} AS VARCHAR) AS label_raw FROM registry"
                               for v in targets)
    shuffle = f"list_transform(list_sort(list_transform(choices, lambda c: {{'k': {u_('shuffle', 'qid', 'c')}, 'v': c}})), lambda s: s.v)"
    names = "CASE q.var " + " ".join(f"WHEN '{v}' THEN '{n}'" for v, n, _ in COL_DICT) + " END"
    secs = "CASE q.var " + " ".join(f"WHEN '{v}' THEN '{s}'" for v, _, s in COL_DICT) + " END"
    head = f"WITH {registry_sql()},\n{PROFILE_CTES}"
    feats = "feats AS (SELECT NULL::VARCHAR AS target, NULL::VARCHAR[] AS f WHERE false)"
    if sectioned:
        from quizloom.plans.oracle.stats_sql import _mi_body
        head, feats = _mi_body(False), "feats AS (SELECT target, list(feature) AS f FROM mi WHERE mi > 0.5 GROUP BY target)"
    return f"""{head},
{feats},
q0 AS (SELECT record_id, var, label_raw, CAST(record_id AS VARCHAR) || '|' || var AS qid FROM ({qrows})
  WHERE label_raw IS NOT NULL AND label_raw NOT IN ('', 'NA') AND var IN (SELECT var FROM summary) AND {extra_where}),
{distractor_ctes(n_choices, difficulty, pick_one)},
sh AS (SELECT z.*, coalesce(f.f, []::VARCHAR[]) AS drop_, {shuffle} AS shuf,
    CAST(floor({u_('pos', 'qid')} * (len(choices) + 1)) AS INTEGER) AS label_idx FROM ch2 z LEFT JOIN feats f ON f.target = z.var),
q AS (SELECT *, list_concat(list_slice(shuf, 1, label_idx), [label], list_slice(shuf, label_idx + 1, len(shuf))) AS options FROM sh)
SELECT q.record_id, q.var AS task,
  {_section_text() if sectioned else _flat_text()} || chr(10) || {"printf('Q1. What would be the masked value of ''%s'' in section %s?', " + names + ", " + secs + ")" if sectioned else "printf('Q1. What would be the masked value of ''%s''?', " + names + ")"}
    || chr(10) || array_to_string(list_transform(options, lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || c), chr(10)) AS user_message,
  chr(65 + q.label_idx) AS label_0, q.options AS choices_0
FROM q JOIN registry r ON q.record_id = r.record_id"""


def outcome_union_sql() -> str:
    targets = [("status", "Q. What will the order status be?"), ("priority", "Q. What will the order priority be?")]
    kept = [c for c in COL_DICT if c[0] not in ("status", "priority")]
    text = "concat_ws(chr(10), " + ", ".join(
        f"CASE WHEN r.{c} IS NOT NULL AND r.{c} <> '' THEN '{n}: ' || trim(r.{c}) END" for c, n, _ in kept) + ")"
    qrows = " UNION ALL ".join(f"SELECT record_id, '{v}' AS var, CAST({v} AS VARCHAR) AS label_raw FROM registry" for v, _ in targets)
    qcase = "CASE q.var " + " ".join(f"WHEN '{v}' THEN '{t}'" for v, t in targets) + " END"
    return f"""WITH {registry_sql()},
{PROFILE_CTES},
q0 AS (SELECT record_id, var, label_raw, CAST(record_id AS VARCHAR) || '|' || var AS qid FROM ({qrows})
  WHERE label_raw IS NOT NULL AND label_raw NOT IN ('', 'NA') AND var IN (SELECT var FROM summary)),
{distractor_ctes()},
fq AS (SELECT *, CAST(floor({u_('pos', 'qid')} * (len(choices) + 1)) AS INTEGER) AS label_idx FROM ch),
q AS (SELECT *, list_concat(list_slice(choices, 1, label_idx), [label], list_slice(choices, label_idx + 1, len(choices))) AS options FROM fq)
SELECT q.record_id, {text} || chr(10) || {qcase}
    || array_to_string(list_transform(q.options, lambda c, i: chr(10) || chr(CAST(64 + i AS INTEGER)) || '. ' || c), '') AS user_message,
  chr(65 + q.label_idx) AS label_0, q.var AS task, q.options AS choices_0
FROM q JOIN registry r ON q.record_id = r.record_id"""
