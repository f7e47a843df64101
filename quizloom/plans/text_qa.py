"""Notes, chat and answer-scoring plans over documents / conversations / labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.hashing import u
from quizloom.operators import notes as N
from quizloom.operators.sampling import global_position
from quizloom.session import checkpoint_dir
from quizloom.sources.stages import Stage, input_print, run_stages
from quizloom.sources.tables import table

SEED = 42
# Category rules of the note classifier (substring, category), first match wins.
CATEGORY_RULES = [("http", "web"), ("@", "contact"), ("***", "formatted")]
EMAIL = r"([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+"
EMAIL_FULL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
INSTRUCTION = "Given the note, continue the response.\n\n"
# System prompt of the evaluation.
SYS_PROMPT = ("Do not add a disclaimer or any other unnecessary sentences after the prediction.\n"
              "Put your final answer (letter choice only) within \\boxed{}.")
MAX_MODEL_LEN = 11000
MAX_ANSWER_TOKENS = 2000
#: Model length of ``answer_inputs``: a short one, so that many of the texts have to be cut.
SHORT_MODEL_LEN = 60


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def generations(spark, sf) -> DataFrame:
    """Recorded generations stand-in: document text + a hash-drawn boxed letter
    (10 % without a box), labels from ``labels`` (quality, toxic -> A/B; null where there are none)."""
    d = documents(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    letter = F.chr(F.lit(65) + F.floor(u(SEED, "gen", F.col("doc_id")) * 5).cast("int"))
    gen = F.when(u(SEED, "box", F.col("doc_id")) >= 0.1,
                 F.concat(F.col("text"), F.lit(" \\boxed{"), letter, F.lit("}"))).otherwise(F.col("text"))
    letter_of = lambda c: F.when(F.col(c) == 1, "A").when(F.col(c).isNotNull(), "B")
    g = d.join(lab, "doc_id", "left").select(
        "doc_id", "source", gen.alias("generated"), letter_of("quality").alias("label_0"), letter_of("toxic").alias("label_1"),
        F.chr(F.lit(65) + F.floor(u(SEED, "gen1", F.col("doc_id")) * 2).cast("int")).alias("value_1"))
    return g.withColumn("value_0", N.boxed_letter("generated"))


def note_category(spark, sf):
    return documents(spark, sf).select("doc_id", N.categorize("text", CATEGORY_RULES).alias("category"))


def note_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", N.token_count("text").cast("long").alias("n_tokens"))


def redact_regex(spark, sf):
    return documents(spark, sf).select("doc_id", N.redact_captured("text", EMAIL).alias("redacted"))


def redact_list(spark, sf):
    d = documents(spark, sf)
    lst = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(EMAIL_FULL), 0),
                                   lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e)), "\n")
    d = d.withColumn("name_list", lst)
    return d.select("doc_id", "name_list", N.replace_all("text", N.parse_name_list("name_list")).alias("redacted"))


def _headered(spark, sf):
    d = documents(spark, sf)
    return d.withColumn("header", F.regexp_extract("text", r"\n([^ \n]+)", 1))


def split_header(spark, sf):
    d = _headered(spark, sf)
    return d.select("doc_id", "header", N.split_at_header("text", "header").alias("split_text"))


def strip_after_sep(spark, sf):
    d = _headered(spark, sf)
    s = N.split_at_header("text", "header")
    return d.select("doc_id", N.before_separator(F.coalesce(s, F.col("text")), INSTRUCTION).alias("model_input"))


def chat_messages(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
    msgs = F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    m = g.select("conv_id", msgs.alias("messages"))
    # struct arrays are engine specific on the wire: expose roles and contents as parallel arrays
    return m.select("conv_id", F.transform("messages", lambda x: x["role"]).alias("roles"),
                    F.transform("messages", lambda x: x["content"]).alias("contents"),
                    N.render("messages").alias("rendered"))


def _user_turns(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", F.col("text").alias("user_message"))


def chat_prompts(spark, sf):
    """[system], user, assistant-prefix chat rendered with a system-capable template."""
    f = _user_turns(spark, sf)
    return f.select("conv_id", "turn", N.render(N.chat("user_message", SYS_PROMPT)).alias("prompt"))


def sys_fold(spark, sf):
    """Template without a system slot: the system prompt is folded into the user turn."""
    f = _user_turns(spark, sf)
    return f.select("conv_id", "turn", N.render_with_fold("user_message", SYS_PROMPT, keep_system=False).alias("prompt"))


def boxed_answer(spark, sf):
    return generations(spark, sf).select("doc_id", "value_0")


def cut_delims(spark, sf):
    return generations(spark, sf).select("doc_id", N.cut_at_delimiters("generated").alias("cut"))


def budget_trim(spark, sf):
    g = generations(spark, sf)
    suffix = 5   # tokens of the answer phrase "Therefore, the answer is "
    kept = N.budget_tokens("generated", MAX_MODEL_LEN, suffix)
    return g.select("doc_id", N.token_count("generated").cast("long").alias("n_tokens"),
                    F.size(kept).cast("long").alias("n_kept"))


def answer_inputs(spark, sf):
    """For both questions of a generation, the prompt and what was generated, cut to the model's length so that
    the words asking for the answer and one token fit behind."""
    g = generations(spark, sf)
    prompt = F.concat(F.lit(SYS_PROMPT + "\n"), F.coalesce(F.concat("source", F.lit("\n")), F.lit("")))
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("question_idx"),
                                         N.answer_input(prompt, "generated", SHORT_MODEL_LEN, q).alias("a"))
                                for q in range(2)]))
    return g.select("doc_id", asked.alias("x")).select(
        "doc_id", "x.question_idx", F.col("x.a.n_tokens").alias("n_tokens"), F.col("x.a.cut").alias("was_cut"),
        F.col("x.a.input").alias("answer_input"))


def prompt_parts(spark, sf):
    """Recover context and question block from rendered horizon prompts."""
    from quizloom.plans.timeseries_qa import horizon_question
    q = horizon_question(spark, sf)
    tail = "\n<|assistant|>\n" + N.ASSISTANT_PREFIX
    prompt = N.render(N.chat("user_message", SYS_PROMPT))
    body = F.when(prompt.endswith(tail), F.expr(f"substring(_p, 1, length(_p) - {len(tail)})")).otherwise(F.col("_p"))
    q = q.withColumn("_p", prompt).withColumn("_b", body).withColumn("_l", F.split("_b", "\n"))
    k = F.size("choices_0")
    question = F.concat(F.array_join(F.slice("_l", -(k + 1), k + 1), "\n"), F.lit("\n\nCorrect Answer: "), F.col("label_0"))
    ctx_all = F.array_join(F.slice("_l", 1, F.size("_l") - k - 1), "\n")
    ctx = F.element_at(F.split(F.element_at(F.split(ctx_all, r"<\|user\|>\n"), 2), r"\nQ\."), 1)
    return q.select("user_id", "slot_idx", ctx.alias("context"), question.alias("question"))


def exact_match(spark, sf):
    g = generations(spark, sf).where("label_0 IS NOT NULL")
    eq = (N.normalize_answer(N.cut_at_delimiters("value_0")) == N.normalize_answer("label_0")).cast("double")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(eq), 6).alias("accuracy"))


def accuracy_report(spark, sf):
    g = generations(spark, sf).where("label_0 IS NOT NULL")
    pairs = F.array(F.struct(F.lit(0).alias("q"), F.col("value_0").alias("v"), F.col("label_0").alias("l")),
                    F.struct(F.lit(1).alias("q"), F.col("value_1").alias("v"), F.col("label_1").alias("l")))
    x = g.select("source", F.explode(pairs).alias("p")).select("source", "p.*")
    eq = (N.normalize_answer(N.cut_at_delimiters("v")) == N.normalize_answer("l")).cast("double")
    return x.groupBy("source", F.col("q").alias("question_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(eq), 6).alias("accuracy"))


def reward_mean(spark, sf):
    g = generations(spark, sf).where("label_0 IS NOT NULL")
    r = (N.boxed_letter("generated") == F.col("label_0")).cast("double")
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean_reward"))


def truncation_rate(spark, sf):
    g = generations(spark, sf)
    t = (N.token_count("generated") >= MAX_ANSWER_TOKENS).cast("double")
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(t), 6).alias("truncation_rate"))


def recorded_runs(spark, sf) -> DataFrame:
    """Recorded generations with the reason each one ended (drawn by hash; a twentieth unrecorded)."""
    k = u(SEED, "fin", F.col("doc_id"))
    reason = F.when(k < 0.15, N.FINISHED_BY_LENGTH).when(k < 0.9, "stop").when(k < 0.95, "abort")
    return generations(spark, sf).withColumn("finish_reason", reason)


def finish_rate(spark, sf):
    """Generations of each source that ended at their token limit, by the recorded reason, and how many of the
    cut and of the finished ones hold an answer letter."""
    g = recorded_runs(spark, sf).withColumn("truncated", N.truncated("finish_reason"))
    answered = lambda c: F.count_if(c & (F.col("value_0") != ""))
    return g.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("n_truncated"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncation_rate"),
        answered(F.col("truncated")).alias("answered_truncated"), answered(~F.col("truncated")).alias("answered_finished"))


def blind_pairs(spark, sf):
    """J10 + W9: two systems' outputs per item, A/B order by hash coin, 20 items per page."""
    g = generations(spark, sf)
    before = g.select("doc_id", F.col("generated").alias("before"), F.col("doc_id").alias("prompt_b"))
    after = documents(spark, sf).select("doc_id", F.col("text").alias("after"), F.col("doc_id").alias("prompt_a"))
    j = before.join(after, "doc_id")
    j = j.withColumn("_chk", F.assert_true(F.col("prompt_a") == F.col("prompt_b")))
    shuffle = u(SEED, "ab", F.col("doc_id")) < 0.5
    j = j.select("doc_id", shuffle.alias("shuffle"),
                 F.when(shuffle, F.col("after")).otherwise(F.col("before")).alias("option_a"),
                 F.when(shuffle, F.col("before")).otherwise(F.col("after")).alias("option_b"),
                 u(SEED, "page", F.col("doc_id")).alias("_k"), "_chk").where(F.col("_chk").isNull()).drop("_chk")
    p = global_position(j, ["_k", "doc_id"])
    return p.select("doc_id", "shuffle", "option_a", "option_b", F.floor(F.col("position") / 20).cast("long").alias("page"))


# ---------------------------------------------------------------- staged note pipeline
def _category_stage(df, rules, skip):
    return df.withColumn("category", N.categorize("text", [tuple(r) for r in rules])).where(~F.col("category").isin(skip))


def _token_stage(df, least):
    return df.withColumn("n_tokens", N.token_count("text").cast("long")).where(F.col("n_tokens") >= least)


def _redaction_stage(df, pattern):
    return df.withColumn("text", N.redact_captured("text", pattern))


def _split_stage(df, header):
    d = df.withColumn("header", F.regexp_extract("text", header, 1))
    return d.withColumn("split_text", N.split_at_header("text", "header")).drop("text")


NOTE_STAGES = [
    Stage("category", _category_stage, {"rules": CATEGORY_RULES, "skip": ["web"]}),
    Stage("tokens", _token_stage, {"least": 20}),
    Stage("redaction", _redaction_stage, {"pattern": EMAIL}),
    Stage("split", _split_stage, {"header": r"\n([^ \n]+)"}),
]


def note_pipeline(spark, sf, root: str | None = None):
    """Notes by category, with tokens counted, names out and split at their header: four stages, each written
    once for its input and parameters and taken up again from there."""
    root = root or f"{checkpoint_dir(spark)}/note-stages"
    source = documents(spark, sf).select("doc_id", "text").where("text IS NOT NULL")
    return run_stages(spark, source, input_print(spark, f"{sf}/documents.parquet"), NOTE_STAGES, root)[0]
