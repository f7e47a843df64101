"""Chat formatting by schema fingerprints, with built-in functions only.

A raw record is a JSON text.  The fingerprint of its schema (the hash of its nested field
paths, whatever the types of the values) selects one of the declared layouts, whose mapping
gives canonical turns: an array of (role, text).  A layout nobody declared is reported, not
guessed.  Records beyond a variant's bounds (a text of 20 M characters, 128 MiB in all) are told
by their skeleton, without the texts, and read under their layout's schema.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles and
texts ``\\`` becomes ``\\s`` and ``<|`` becomes ``\\l`` (and a line end in a role ``\\n``), so no
text can hold a control string, and reading back is exact.  The loss mask is a run for each
turn: so many code points to skip, so many to take.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import free_name

START, END = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: the schema's objects and arrays with their fields in alphabetical order;
    ``turns``: the mapping, SQL over the parsed record ``v``."""
    name: str
    paths: str
    turns: str


def _field(name: str) -> str:
    return f"coalesce(variant_get(v, '$.{name}', 'string'), '')"


def _list(path: str, role: str, text: str, role_value: str = "coalesce(t.{role}, '')") -> str:
    rows = f"variant_get(v, '$.{path}', 'array<struct<{role}:string,{text}:string>>')".replace("from:", "`from`:")
    value = role_value.format(role=f"`{role}`")
    return f"transform({rows}, t -> named_struct('role', {value}, 'text', coalesce(t.`{text}`, '')))"


_ASK = f"if({_field('input')} = '', {_field('instruction')}, concat({_field('instruction')}, '\n\n', {_field('input')}))"
_NAMES = "CASE t.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(t.{role}, '') END"


def _pairs(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {t})" for r, t in turns) + ")"


#: Declared layouts.  A list without rows has no fields below it and is declared on its own.
LAYOUTS = [
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _list("messages", "role", "content")),
    Layout("messages_empty", "OBJECT<messages: ARRAY<>>", f"cast(array() AS {_TURNS})"),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
           _list("conversations", "from", "value", _NAMES)),
    Layout("conversations_empty", "OBJECT<conversations: ARRAY<>>", f"cast(array() AS {_TURNS})"),
    Layout("prompt", "OBJECT<completion, prompt>", _pairs(("user", _field("prompt")), ("assistant", _field("completion")))),
    Layout("prompt_response", "OBJECT<prompt, response>", _pairs(("user", _field("prompt")), ("assistant", _field("response")))),
    Layout("instruction", "OBJECT<input, instruction, output>", _pairs(("user", _ASK), ("assistant", _field("output")))),
    Layout("system_instruction", "OBJECT<input, instruction, output, system>",
           _pairs(("system", _field("system")), ("user", _ASK), ("assistant", _field("output")))),
]


def schema_paths(record: Column) -> Column:
    """Nested field paths of a JSON text's schema, scalar types left out; null if it can't be parsed."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    bare = F.regexp_replace(schema, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?", "")
    return F.regexp_replace(bare, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?>", "ARRAY<>")


def skeleton(record: Column) -> Column:
    """A JSON text with empty strings as values, and one of neighbouring equal objects without inner ones: the same schema, but short."""
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    bare = F.regexp_replace(record, rf'(?s)\G([^"]*+(?:{string}\s*+:[^"]*+)*+){string}', '$1""')
    return F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def fingerprint(record: Column) -> Column:
    """64-bit hash of a record's nested field paths."""
    return F.xxhash64(F.coalesce(schema_paths(record), schema_paths(skeleton(record))))


_GET = re.compile(r"variant_get\(v, '\$\.(\w+)', '([^']*)'\)")


def _read_long(layout: Layout, record: str) -> tuple[Column, Column]:
    """(whether the JSON text can be read, turns) of a record in ``layout`` that no variant holds."""
    fields = dict(_GET.findall(layout.turns))
    schema = ", ".join([*(f"`{k}` {t}" for k, t in fields.items()), "__bad string"])
    parsed = (f"from_json(`{record}`, '{schema}', map('maxStringLen', '2147483647', 'columnNameOfCorruptRecord', '__bad'))")
    turns = _GET.sub(lambda m: f"{parsed}.`{m[1]}`", layout.turns)
    return F.expr(f"{parsed}.__bad IS NULL"), F.expr(turns).cast(_TURNS)


def canonical_turns(records: DataFrame, record: str = "record", layouts: list[Layout] | None = None) -> DataFrame:
    """``records`` without ``record``, with fingerprint, layout and turns.

    Records that are null, aren't JSON or have a layout nobody declared get layout ``unknown``
    and null turns, so they can be set aside.  Null texts and roles are empty.  Texts and records
    may be as long as a value can be.
    """
    keep = [F.col(f"`{c}`") for c in records.columns if c != record]
    raw = free_name(records, "__raw")
    parsed = records.select(*keep, F.col(f"`{record}`").alias(raw), F.try_parse_json(F.col(f"`{record}`")).alias("v"),
                            fingerprint(F.col(f"`{record}`")).alias("fingerprint"))
    name, turns = None, None
    for x in layouts or LAYOUTS:
        readable, long_turns = _read_long(x, raw)
        is_it = (F.col("fingerprint") == F.xxhash64(F.lit(x.paths))) & (F.col("v").isNotNull() | readable)
        mapped = F.when(F.col("v").isNotNull(), F.expr(x.turns).cast(_TURNS)).otherwise(long_turns)
        name = F.when(is_it, F.lit(x.name)) if name is None else name.when(is_it, F.lit(x.name))
        turns = F.when(is_it, mapped) if turns is None else turns.when(is_it, mapped)
    return parsed.select(*keep, "fingerprint", F.coalesce(name, F.lit(UNKNOWN)).alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(rows: DataFrame, trained_role: str = "assistant", turns: str = "turns") -> DataFrame:
    """``rows`` with ``turns`` replaced by ``formatted`` and ``loss_mask``: for each turn the code
    points to ``skip`` from the last run's end and to ``take``, its text's if it is ``trained_role``'s."""
    spelled = F.transform(F.col(turns), lambda t: F.struct(
        _role(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
        (F.coalesce(t["role"], F.lit("")) == trained_role).alias("trained")))
    rest = [F.col(f"`{c}`") for c in rows.columns if c != turns]
    made = rows.select(*rest, spelled.alias("__spelled"))
    text = F.array_join(F.transform("__spelled", lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    mask = F.transform("__spelled", lambda t, i: F.struct(
        (F.when(i > 0, len(END)).otherwise(0) + len(START) + F.length(t["role"]) + 1
         + F.when(t["trained"], 0).otherwise(F.length(t["text"]))).cast("long").alias("skip"),
        F.when(t["trained"], F.length(t["text"])).otherwise(0).cast("long").alias("take")))
    return made.select(*rest, text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(rows: DataFrame) -> DataFrame:
    """The other way: ``rows`` with ``turns`` and ``loss_texts`` (unescaped texts under the mask, in
    order, one for each turn, empty where nothing is taken) read from ``formatted`` and ``loss_mask``."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("formatted", "loss_mask")]
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    cut = rows.select(*rest, "formatted", "loss_mask", F.slice(pieces, 1, F.size(pieces) - 1).alias("__pieces"))
    head = len(START)

    def turn(p: Column) -> Column:
        role = F.substring_index(p.substr(F.lit(head + 1), F.length(p)), "\n", 1)
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"),
                        unescape(p.substr(F.length(role) + head + 2, F.length(p))).alias("text"))

    # a run that takes something starts after its turn's head; what it skips begins in the turn before
    under = F.zip_with("__pieces", F.transform("loss_mask", lambda r, i: F.struct(
        (r["skip"] - F.when(i > 0, len(END)).otherwise(0)).cast("int").alias("at"), r["take"].cast("int").alias("take"))),
        lambda p, r: F.when(r["take"] > 0, unescape(p.substr(r["at"] + 1, r["take"]))).otherwise(F.lit("")))
    return cut.select(*rest, "formatted", "loss_mask", F.transform("__pieces", turn).alias("turns"), under.alias("loss_texts"))


def raw_records(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, record): the rows of a conversation by ``turn`` as one JSON text, in the layouts that
    corpora come in: conversations of a user and an assistant row in turn as a prompt or an
    instruction, those of the usual three roles as value lists, all others as messages.

    Rows of one turn number are ordered by role and text; null turns come first; null roles and
    texts are empty; a null id is a conversation like any other.  A conversation is one value,
    so its rows meet in one task.
    """
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("content"))
    talk = rows.groupBy(F.col(f"`{id}`").alias("id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    kind = F.pmod(F.xxhash64("id"), F.lit(2))
    names = F.transform("t", lambda x: x["role"])
    text_of = lambda i: F.col("t")[i]["content"]
    usual = F.size(F.array_except(names, F.array(*[F.lit(x) for x in ("user", "assistant", "system")]))) == 0
    pair = names == F.array(F.lit("user"), F.lit("assistant"))
    triple = names == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    empty = F.lit("").alias("input")
    record = (
        F.when(pair & (kind == 0), F.to_json(F.struct(text_of(0).alias("prompt"), text_of(1).alias("completion"))))
        .when(pair, F.to_json(F.struct(text_of(0).alias("instruction"), empty, text_of(1).alias("output"))))
        .when(triple & (kind == 0), F.to_json(F.struct(text_of(0).alias("system"), text_of(1).alias("instruction"), empty,
                                                       text_of(2).alias("output"))))
        .when(usual & (kind == 0), F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            name(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))))
    return talk.select(F.col("id").alias(id), record.alias("record"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and conversation -1, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    known = canonical_turns(raw_records(rows.unionByName(tricky)))
    lost = F.raise_error(F.concat(F.lit("op8: no layout for the record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    read = read_turns(format_turns(known.withColumn("turns", F.coalesce("turns", lost.cast(_TURNS)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB: the same digests from the rows themselves.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
e AS (SELECT *, replace(replace(text, '\', '\s'), '<|', '\l') AS et,
  replace(replace(replace(role, '\', '\s'), '<|', '\l'), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
