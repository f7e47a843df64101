"""DuckDB SQL for the codebook operators."""

CB = """cb AS (SELECT p_brand AS sheet, p_partkey AS ord, 'v' || CAST(p_partkey AS VARCHAR) AS var,
  CASE WHEN p_partkey % 7 = 0 THEN 'Section ' || p_type END AS heading,
  CASE p_size % 4 WHEN 0 THEN '[1]' || p_type || chr(10) || '[2]' || p_name
                  WHEN 1 THEN 'Codes' || chr(10) || '1 = ' || p_type || chr(10) || '2 = ' || p_name
                  WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '[1] ' ELSE '1 = ' END || p_name
                  ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Title' || chr(10) || '[A]' ELSE '[01]' END || p_type || chr(10) || 'passed over'
                    || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '[x] void' ELSE chr(10) || '[2] two' || chr(10) || '[2] last' END END AS range_text,
  CASE p_partkey % 4 WHEN 0 THEN '1=' || p_type || ',2=' || p_brand WHEN 1 THEN '1.' || p_type || ',2.' || p_name
                     WHEN 2 THEN '1-' || p_type || ',02-x'
    ELSE CASE WHEN p_size > 25 THEN '1=x=y,2=' || p_type ELSE p_name END END AS coding_text FROM part)"""

_NUM = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN CAST(CAST({0} AS HUGEINT) AS VARCHAR) ELSE {0} END"

CODEBOOK_RANGES = "WITH " + CB + r""",
l AS (SELECT var, generate_subscripts(string_split(range_text, chr(10)), 1) AS pos, unnest(string_split(range_text, chr(10))) AS line
  FROM cb WHERE contains(range_text, chr(10))),
p AS (SELECT var, pos, starts_with(line, '[') OR regexp_matches(line, '^\d') AS like_code,
    CASE WHEN starts_with(line, '[') THEN nullif(regexp_extract(line, '\[([A-Z0-9]+)\](.*)', 1), '')
         WHEN regexp_matches(line, '^\d') THEN nullif(regexp_extract(line, '(\d+)\s?=\s?(.*)', 1), '') END AS code,
    trim(CASE WHEN starts_with(line, '[') THEN regexp_extract(line, '\[([A-Z0-9]+)\](.*)', 2)
         ELSE regexp_extract(line, '(\d+)\s?=\s?(.*)', 2) END) AS label FROM l),
bad AS (SELECT DISTINCT var FROM p WHERE like_code AND code IS NULL AND pos > 1),
several AS (SELECT var, """ + _NUM.format("code") + r""" AS code, label, pos FROM p WHERE code IS NOT NULL AND var NOT IN (SELECT var FROM bad)),
single AS (SELECT var, regexp_extract(range_text, '\[(\d)\] (.*)', 1) AS k FROM cb WHERE NOT contains(range_text, chr(10)))
SELECT var, code, arg_max(label, pos) AS label FROM several GROUP BY var, code
UNION ALL SELECT var, k, 'Yes' FROM single WHERE k NOT IN ('', '0')
UNION ALL SELECT var, '0', 'No' FROM single WHERE k <> ''"""

CODEBOOK_LIST = "WITH " + CB + """,
c AS (SELECT var, string_split(coding_text, ',') AS parts FROM cb WHERE contains(coding_text, ',')),
s AS (SELECT var, parts, CASE WHEN list_bool_and(list_transform(parts, lambda x: len(string_split(x, '=')) = 2)) THEN '='
    WHEN list_bool_and(list_transform(parts, lambda x: len(string_split(x, '.')) = 2)) THEN '.'
    WHEN list_bool_and(list_transform(parts, lambda x: len(string_split(x, '-')) = 2)) THEN '-' END AS sep FROM c),
e AS (SELECT var, sep, generate_subscripts(parts, 1) AS pos, unnest(parts) AS p FROM s WHERE sep IS NOT NULL),
f AS (SELECT var, pos, trim(split_part(p, sep, 1)) AS c, trim(split_part(p, sep, 2)) AS label FROM e)
SELECT var, """ + _NUM.format("c") + """ AS code, arg_max(label, pos) AS label FROM f GROUP BY 1, 2"""

HEADER_FFILL = "WITH " + CB + """
SELECT var, CASE WHEN h IS NOT NULL THEN '[' || sheet || '/' || h || ']' END AS header FROM (
  SELECT var, sheet, last_value(heading IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM cb)"""

BLOCK_SEGMENTS = "WITH " + CB + """
SELECT sheet, var, min(block) AS block FROM (
  SELECT sheet, var, sum(CASE WHEN heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM cb) GROUP BY sheet, var"""

NAME_ALIGN = """WITH a AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 25),
b AS (SELECT DISTINCT replace(p_brand, 'Brand#', 'brand-') AS name FROM part WHERE p_size >= 25),
oa AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM a WHERE name NOT IN (SELECT name FROM b)),
ob AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM b WHERE name NOT IN (SELECT name FROM a))
SELECT oa.name AS name_a, ob.name AS name_b FROM oa JOIN ob ON oa.pos = ob.pos"""

METADATA_OVERRIDE = "WITH " + CB + """
SELECT var, CASE WHEN ord >= 100 THEN coding_text ELSE range_text END AS range_text FROM cb"""

HEADER_LEVELS = r"""
WITH r AS (SELECT 'S' || (p_partkey // 500) AS sheet, p_partkey AS ord,
    CASE WHEN p_partkey % 37 = 5 THEN 'Domain ' || ((p_partkey // 37) % 4) END AS domain,
    CASE WHEN p_partkey % 11 = 3 THEN '  Part ' || ((p_partkey // 11) % 3) || chr(10) || ' '
         WHEN p_partkey % 11 = 8 THEN 'Part' || chr(10) || 'of ' || p_brand END AS section FROM part),
t AS (SELECT sheet, ord, CASE domain WHEN 'Domain 2' THEN 'Second domain' ELSE domain END AS d,
    CASE section WHEN '  Part 1' || chr(10) || ' ' THEN 'First part' ELSE section END AS s FROM r),
c AS (SELECT sheet, ord, replace(regexp_replace(d, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS d,
    replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS s FROM t)
SELECT sheet, ord, '[' || coalesce(last_value(d IGNORE NULLS) OVER w, 'None') || '/' || coalesce(last_value(s IGNORE NULLS) OVER w, 'None') || ']' AS header
FROM c WINDOW w AS (PARTITION BY sheet ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _cell(title: str, head: str, odd_head: str, value: str) -> str:
    return (f"CASE WHEN p_partkey % 10 = 0 THEN {title} WHEN p_partkey % 10 = 8 AND (p_partkey // 10) % 5 <> 4 THEN NULL "
            f"WHEN p_partkey % 10 = 1 THEN CASE WHEN (p_partkey // 10) % 2 = 1 THEN {odd_head} ELSE {head} END ELSE {value} END")


SHEET_BLOCKS = f"""
WITH r AS (SELECT 'S' || (p_partkey // 400) AS sheet, p_partkey AS ord,
    {_cell("'Block ' || ((p_partkey // 10) % 7)", "'name'", "'code'", "p_name")} AS c0,
    {_cell("NULL", "'size'", "'label'", "CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS VARCHAR) END")} AS c1,
    {_cell("NULL", "'type'", "'name'", "p_type")} AS c2,
    {_cell("NULL", "'size'", "NULL", "CASE WHEN p_partkey % 4 > 0 THEN p_brand END")} AS c3 FROM part),
k AS (SELECT *, c0 IS NOT NULL AND c1 IS NULL AND c2 IS NULL AND c3 IS NULL AS title,
    c0 IS NULL AND c1 IS NULL AND c2 IS NULL AND c3 IS NULL AS blank FROM r),
t AS (SELECT *, max(CASE WHEN title THEN ord END) OVER w AS t0, max(CASE WHEN blank THEN ord END) OVER w AS gap FROM k
  WINDOW w AS (PARTITION BY sheet ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
body AS (SELECT *, min(ord) OVER (PARTITION BY sheet, t0) AS head FROM t WHERE ord > t0 AND (gap IS NULL OR gap < t0)),
ok AS (SELECT sheet, t0, max(CASE WHEN title THEN c0 END) AS section FROM t WHERE t0 IS NOT NULL GROUP BY sheet, t0
  HAVING bool_or(blank) OR t0 = (SELECT max(z.t0) FROM t z WHERE z.sheet = t.sheet)),
one AS (SELECT sheet, section, min(t0) AS t0 FROM ok GROUP BY sheet, section),
names AS (SELECT sheet, t0, i, [c0, c1, c2, c3][i] AS name FROM body, range(1, 5) g(i) WHERE ord = head),
cells AS (SELECT sheet, t0, ord, i, [c0, c1, c2, c3][i] AS value FROM body, range(1, 5) g(i) WHERE ord > head),
j AS (SELECT sheet, section, ord, name, arg_max(coalesce(value, chr(0)), i) AS value
  FROM cells JOIN names USING (sheet, t0, i) JOIN one USING (sheet, t0) WHERE name IS NOT NULL GROUP BY ALL)
SELECT * FROM j WHERE value <> chr(0)"""

APPEARANCE_CODES = """
SELECT value, row_number() OVER (ORDER BY first, value) - 1 AS code FROM (
  SELECT l_partkey || '-' || l_suppkey AS value, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1)"""
