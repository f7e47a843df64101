"""DuckDB SQL for notes, chat and scoring operators."""

from __future__ import annotations

from quizloom.plans.oracle.mcq_sql import u_
from quizloom.plans.oracle.timeseries_sql import FLAGS, SECTIONS, _HQ

NL = "chr(10)"
EMAIL = "([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+"
EMAIL_FULL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
SYS = ("'Do not add a disclaimer or any other unnecessary sentences after the prediction.' || chr(10) || "
       "'Put your final answer (letter choice only) within \\boxed{}.'")
PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"

GEN = f"""gen AS (SELECT d.doc_id, d.source,
    CASE WHEN {u_('box', 'd.doc_id')} >= 0.1 THEN d.text || ' \\boxed{{' || chr(CAST(65 + floor({u_('gen', 'd.doc_id')} * 5) AS INTEGER)) || '}}' ELSE d.text END AS generated,
    CASE WHEN l.quality = 1 THEN 'A' WHEN l.quality IS NOT NULL THEN 'B' END AS label_0,
    CASE WHEN l.toxic = 1 THEN 'A' WHEN l.toxic IS NOT NULL THEN 'B' END AS label_1,
    chr(CAST(65 + floor({u_('gen1', 'd.doc_id')} * 2) AS INTEGER)) AS value_1
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT *, regexp_extract(generated, '\\\\boxed\\{{([A-E])\\}}', 1) AS value_0 FROM gen)"""


TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\x0B\f\r]"


def tok_count(x):
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def cut(x):
    pos = ", ".join(f"CASE WHEN strpos({x}, {d}) > 0 THEN strpos({x}, {d}) ELSE length({x}) + 1 END"
                    for d in ["'Q:'", "chr(10) || chr(10)", "'</s>'", "'.'"])
    return f"substr({x}, 1, least({pos}) - 1)"


def norm(x):
    return f"translate(lower(replace({x}, ' ', '')), {PUNCT}, '')"


NOTE_CATEGORY = """SELECT doc_id, CASE WHEN contains(text, 'http') THEN 'web' WHEN contains(text, '@') THEN 'contact'
  WHEN contains(text, '***') THEN 'formatted' ELSE 'regular' END AS category FROM documents"""

NOTE_TOKENS = f"SELECT doc_id, CAST({tok_count('text')} AS BIGINT) AS n_tokens FROM documents"

REDACT_REGEX = f"""SELECT doc_id, list_reduce(list_transform(list_sort(list_transform(
    list_distinct(list_filter(regexp_extract_all(text, '{EMAIL}', 1), lambda n: n <> '')),
    lambda n: {{'k': -length(n), 'n': n}})), lambda x: x.n),
  lambda t, n: replace(t, n, '[NAME]'), text) AS redacted FROM documents"""

REDACT_LIST = f"""WITH d AS (SELECT doc_id, text, array_to_string(list_transform(regexp_extract_all(text, '{EMAIL_FULL}'),
    lambda e, i: CAST(i AS VARCHAR) || '. ' || e), chr(10)) AS name_list FROM documents)
SELECT doc_id, name_list, list_reduce(
  list_filter(list_transform(string_split(regexp_replace(name_list, '^\\s+|\\s+$', '', 'g'), chr(10)),
    lambda x: string_split(x, '. ')[-1]), lambda n: n <> ''),
  lambda t, n: replace(t, n, '[NAME]'), text) AS redacted FROM d"""


def _cnt(t, h):
    return f"len(string_split({t}, {h})) - 1"


def _split(t, h):
    sep = "'" + "*" * 50 + "' || chr(10)"
    p = f"string_split({t}, {h})"
    return (f"CASE WHEN {_cnt(t, h)} = 1 THEN {p}[1] || {sep} || {h} || chr(10) || {p}[2] "
            f"WHEN {_cnt(t, h)} = 2 THEN {p}[1] || chr(10) || {h} || chr(10) || {p}[2] || {sep} || {h} || chr(10) || {p}[3] END")


_CLEAN = "regexp_replace(replace(header, '*', ''), '^\\s+|\\s+$', '', 'g')"
_SPLIT = (f"CASE WHEN header <> '' AND {_cnt('text', 'header')} IN (1, 2) THEN {_split('text', 'header')} "
          f"WHEN {_CLEAN} <> '' AND {_cnt('text', _CLEAN)} IN (1, 2) THEN {_split('text', _CLEAN)} END")
_HEADERED = "h AS (SELECT doc_id, text, regexp_extract(text, '\\n([^ \\n]+)', 1) AS header FROM documents)"

SPLIT_HEADER = f"WITH {_HEADERED} SELECT doc_id, header, {_SPLIT} AS split_text FROM h"

STRIP_AFTER_SEP = (f"WITH {_HEADERED} SELECT doc_id, 'Given the note, continue the response.' || chr(10) || chr(10) || "
                   f"split_part(coalesce({_SPLIT}, text), '{'*' * 50}', 1) AS model_input FROM h")

CHAT_MESSAGES = """SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS contents,
  string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id"""

_FIRST = "f AS (SELECT conv_id, turn, text AS user_message FROM conversations WHERE role = 'user')"
_TAIL = "chr(10) || '<|assistant|>' || chr(10) || 'Let''s think step by step.'"

CHAT_PROMPTS = (f"WITH {_FIRST} SELECT conv_id, turn, '<|system|>' || chr(10) || {SYS} || chr(10) || '<|user|>' || chr(10) || "
                f"user_message || {_TAIL} AS prompt FROM f")

SYS_FOLD = (f"WITH {_FIRST} SELECT conv_id, turn, '<|user|>' || chr(10) || {SYS} || chr(10) || user_message || {_TAIL} AS prompt FROM f")

BOXED_ANSWER = f"WITH {GEN} SELECT doc_id, value_0 FROM g"

CUT_DELIMS = f"WITH {GEN} SELECT doc_id, {cut('generated')} AS cut FROM g"

_TOK = f"regexp_extract_all(generated, '{TOKEN}')"
BUDGET_TRIM = f"""WITH {GEN} SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens,
  CAST(CASE WHEN len({_TOK}) + 5 + 1 >= 11000 THEN least(len({_TOK}), 11000 - 5 - 1) ELSE len({_TOK}) END AS BIGINT) AS n_kept FROM g"""

_SPACED = f"regexp_extract_all(whole, '[ \\t\\n\\x0B\\f\\r]*(?:{TOKEN})')"
ANSWER_INPUTS = f"""WITH {GEN}, w AS (SELECT doc_id, {SYS} || chr(10) || coalesce(source || chr(10), '') || coalesce(generated, '') AS whole FROM g),
t AS (SELECT doc_id, whole, {_SPACED} AS sp FROM w),
q(question_idx, phrase, room) AS (VALUES (0, 'Therefore, the answer to Q1 is ', 52), (1, 'Therefore, the answer to Q2 is ', 52))
SELECT doc_id, question_idx, CAST(len(sp) AS BIGINT) AS n_tokens, len(sp) >= room AS was_cut,
  CASE WHEN len(sp) >= room THEN array_to_string(sp[1:room], '') ELSE whole END || phrase AS answer_input FROM t, q"""

PROMPT_PARTS = f"""WITH {FLAGS},
{SECTIONS},
{_HQ},
p AS (SELECT user_id, slot_idx, label_0, len(choices_0) AS k,
    '<|system|>' || chr(10) || {SYS} || chr(10) || '<|user|>' || chr(10) || user_message AS body FROM hq2),
l AS (SELECT *, string_split(body, chr(10)) AS lines FROM p)
SELECT user_id, slot_idx,
  string_split(string_split(array_to_string(lines[1:len(lines) - k - 1], chr(10)), '<|user|>' || chr(10))[2], chr(10) || 'Q.')[1] AS context,
  array_to_string(lines[len(lines) - k:], chr(10)) || chr(10) || chr(10) || 'Correct Answer: ' || label_0 AS question
FROM l"""

EXACT_MATCH = (f"WITH {GEN} SELECT count(*) AS n, round(avg(CASE WHEN {norm(cut('value_0'))} = {norm('label_0')} "
               f"THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g WHERE label_0 IS NOT NULL")

ACCURACY_REPORT = f"""WITH {GEN}, x AS (SELECT source, 0 AS question_idx, value_0 AS v, label_0 AS l FROM g WHERE label_0 IS NOT NULL
  UNION ALL SELECT source, 1, value_1, label_1 FROM g WHERE label_0 IS NOT NULL)
SELECT source, question_idx, count(*) AS n, round(avg(CASE WHEN {norm(cut('v'))} = {norm('l')} THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM x GROUP BY ALL"""

REWARD_MEAN = (f"WITH {GEN} SELECT source, count(*) AS n, round(avg(CASE WHEN value_0 = label_0 THEN 1.0 ELSE 0.0 END), 6) "
               f"AS mean_reward FROM g WHERE label_0 IS NOT NULL GROUP BY source")

TRUNCATION_RATE = (f"WITH {GEN} SELECT source, count(*) AS n, round(avg(CASE WHEN {tok_count('generated')} >= 2000 "
                   f"THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate FROM g GROUP BY source")

FINISH_RATE = f"""WITH {GEN}, r AS (SELECT source, value_0, coalesce({u_('fin', 'doc_id')} < 0.15, false) AS tr FROM g)
SELECT source, count(*) AS n, count(*) FILTER (tr) AS n_truncated, round(avg(CASE WHEN tr THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate,
  count(*) FILTER (tr AND value_0 <> '') AS answered_truncated, count(*) FILTER (NOT tr AND value_0 <> '') AS answered_finished
FROM r GROUP BY source"""

BLIND_PAIRS = f"""WITH {GEN}
SELECT g.doc_id, {u_('ab', 'g.doc_id')} < 0.5 AS shuffle,
  CASE WHEN {u_('ab', 'g.doc_id')} < 0.5 THEN d.text ELSE g.generated END AS option_a,
  CASE WHEN {u_('ab', 'g.doc_id')} < 0.5 THEN g.generated ELSE d.text END AS option_b,
  CAST(floor((row_number() OVER (ORDER BY {u_('page', 'g.doc_id')}, g.doc_id) - 1) / 20) AS BIGINT) AS page
FROM g JOIN documents d ON g.doc_id = d.doc_id"""

_REDACTED = REDACT_REGEX[len("SELECT doc_id, "):REDACT_REGEX.index(" AS redacted FROM")]
NOTE_PIPELINE = f"""WITH c AS ({NOTE_CATEGORY.replace("SELECT doc_id,", "SELECT doc_id, text,")} WHERE text IS NOT NULL),
t AS (SELECT *, CAST({tok_count('text')} AS BIGINT) AS n_tokens FROM c WHERE category <> 'web' AND {tok_count('text')} >= 20),
r AS (SELECT doc_id, category, n_tokens, {_REDACTED} AS text FROM t),
h AS (SELECT *, regexp_extract(text, '\\n([^ \\n]+)', 1) AS header FROM r)
SELECT doc_id, category, n_tokens, header, {_SPLIT} AS split_text FROM h"""
