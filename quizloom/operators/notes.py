"""Free-text notes, chat assembly and answer text (built-in string,
regex and array functions only; whole texts, no prefixes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern of the default (regex) tokenizer.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\x0B\f\r]"
# A token with the white space before it: put together again, these give the text up to its last token.
SPACED_TOKEN = r"[ \t\n\x0B\f\r]*(?:" + TOKEN_PATTERN + ")"
# Delimiters of the answer cut, in the reference's order.
CUT_DELIMITERS = ["Q:", "\n\n", "</s>", "."]
# Separator written between note parts.
SEPARATOR = "*" * 50
# Chat prefixes.
ASSISTANT_PREFIX = "Let's think step by step."
ANSWER_PHRASE = "Therefore, the answer is "
QUESTION_PHRASE = "Therefore, the answer to Q{} is "
# Why a recorded generation ended at its token limit.
FINISHED_BY_LENGTH = "length"
# Punctuation removed by the exact-match metric (Python string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def categorize(text, rules: list[tuple[str, str]], default: str = "regular") -> Column:
    """First rule whose substring the text contains wins."""
    t = _c(text)
    expr = None
    for sub, cat in rules:
        expr = F.when(t.contains(sub), F.lit(cat)) if expr is None else expr.when(t.contains(sub), F.lit(cat))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def tokens(text) -> Column:
    """Word/punctuation tokens (default pluggable tokenizer)."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def token_count(text) -> Column:
    """Number of tokens of the whole text."""
    return F.size(tokens(text))


def replace_all(text, names) -> Column:
    """Replace every occurrence of each name (in list order) by ``[NAME]``."""
    return F.aggregate(_c(names), _c(text), lambda t, n: F.replace(t, n, F.lit("[NAME]")))


def redact_captured(text, pattern: str, group: int = 1) -> Column:
    """Names captured by ``pattern`` are replaced everywhere in the text, each once and the
    longest first, so that no name leaves a piece of a longer one."""
    names = F.filter(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(pattern), group)), lambda n: n != F.lit(""))
    keyed = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    return replace_all(text, F.transform(keyed, lambda x: x["n"]))


def parse_name_list(list_text) -> Column:
    """``1. name`` lines -> names (text after the last ``". "``); empty names dropped."""
    lines = F.split(F.regexp_replace(_c(list_text), r"^\s+|\s+$", ""), "\n")
    names = F.transform(lines, lambda x: F.element_at(F.split(x, r"\. "), -1))
    return F.filter(names, lambda n: n != F.lit(""))


def _count(text: Column, hd: Column) -> Column:
    return F.size(F.split(text, F.concat(F.lit("\\Q"), hd, F.lit("\\E")), -1)) - 1


def _split_at(text: Column, hd: Column) -> Column:
    parts = F.split(text, F.concat(F.lit("\\Q"), hd, F.lit("\\E")), -1)
    n = F.size(parts) - 1
    one = F.concat(parts[0], F.lit(SEPARATOR + "\n"), hd, F.lit("\n"), parts[1])
    two = F.concat(parts[0], F.lit("\n"), hd, F.lit("\n"), parts[1], F.lit(SEPARATOR + "\n"), hd, F.lit("\n"), parts[2])
    return F.when(n == 1, one).when(n == 2, two)


def split_at_header(text, header) -> Column:
    """Split at a header occurring once (or at its second of two
    occurrences); try the raw header, then with ``*`` removed and trimmed; else null."""
    t, h = _c(text), _c(header)
    cleaned = F.regexp_replace(F.regexp_replace(h, r"\*", ""), r"^\s+|\s+$", "")
    ok = lambda x: (x != F.lit("")) & _count(t, x).isin(1, 2)
    return F.when(ok(h), _split_at(t, h)).when(ok(cleaned), _split_at(t, cleaned))


def before_separator(text, instruction: str = "") -> Column:
    """Part before the 50-asterisk separator, instruction prepended."""
    return F.concat(F.lit(instruction), F.substring_index(_c(text), SEPARATOR, 1))


def chat(user, system: str | None = None, assistant_prefix: str | None = ASSISTANT_PREFIX) -> Column:
    """Message list [system], user, [assistant prefix] as array<struct<role, content>>."""
    msgs = []
    if system:
        msgs.append(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    msgs.append(F.struct(F.lit("user").alias("role"), _c(user).alias("content")))
    if assistant_prefix is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), F.lit(assistant_prefix).alias("content")))
    return F.array(*msgs)


def render(msgs, keep_system: bool = True) -> Column:
    """Plain role-tagged rendering ``<|role|>\\ncontent`` joined by newlines; a
    template without a system slot drops system messages."""
    m = _c(msgs)
    if not keep_system:
        m = F.filter(m, lambda x: x["role"] != F.lit("system"))
    return F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"])), "\n")


def render_with_fold(user, system: str, keep_system: bool) -> Column:
    """If the rendered chat lost the system prompt, fold it into the user turn."""
    r = render(chat(user, system), keep_system)
    folded = render(chat(F.concat(F.lit(system + "\n"), _c(user))), keep_system)
    return F.when(r.contains(system), r).otherwise(folded)


def boxed_letter(text) -> Column:
    """First ``\\boxed{A-E}`` letter, else ""."""
    return F.regexp_extract(_c(text), r"\\boxed\{([A-E])\}", 1)


def cut_at_delimiters(text) -> Column:
    """Text up to the earliest of the delimiters."""
    t = _c(text)
    big = F.length(t) + 1
    pos = [F.when(F.locate(d, t) > 0, F.locate(d, t)).otherwise(big) for d in CUT_DELIMITERS]
    return F.substring(t, 1, F.least(*pos) - 1)


def budget_tokens(text, max_len: int, suffix_len: int) -> Column:
    """Keep the first ``max_len - suffix_len - 1`` tokens when the text
    plus suffix would not fit."""
    tk = tokens(text)
    keep = max_len - suffix_len - 1
    return F.when(F.size(tk) + suffix_len + 1 >= max_len, F.slice(tk, 1, keep)).otherwise(tk)


def answer_phrase(question: int | None = None) -> str:
    """Words that ask for the letter: of the only question, or of question ``question`` (from 0)."""
    return ANSWER_PHRASE if question is None else QUESTION_PHRASE.format(question + 1)


def answer_input(prompt, generated, max_len: int, question: int | None = None) -> Column:
    """Struct of ``n_tokens`` (of prompt and generation together), ``cut`` and ``input``, the text that asks for
    the answer.  Where text, phrase and one answer token would reach ``max_len``, the text keeps its first
    ``max_len - phrase - 1`` tokens (none if that is negative) with the white space between them; else all of it.
    A null prompt or generation counts as empty."""
    phrase = answer_phrase(question)
    whole = F.concat(F.coalesce(_c(prompt), F.lit("")), F.coalesce(_c(generated), F.lit("")))
    spaced = F.regexp_extract_all(whole, F.lit(SPACED_TOKEN), 0)
    room = F.greatest(F.lit(max_len) - token_count(F.lit(phrase)) - 1, F.lit(0))
    cut = F.size(spaced) >= F.lit(max_len) - token_count(F.lit(phrase)) - 1
    return F.struct(F.size(spaced).cast("long").alias("n_tokens"), cut.alias("cut"),
                    F.concat(F.when(cut, F.array_join(F.slice(spaced, F.lit(1), room), "")).otherwise(whole),
                             F.lit(phrase)).alias("input"))


def truncated(finish_reason) -> Column:
    """Whether a recorded generation ended at its token limit; an unrecorded reason is none."""
    return _c(finish_reason).eqNullSafe(F.lit(FINISHED_BY_LENGTH))


def normalize_answer(text) -> Column:
    """A17 normalisation: spaces removed, lower case, punctuation removed."""
    s = F.lower(F.regexp_replace(_c(text), " ", ""))
    return F.translate(s, PUNCTUATION, "")
