"""Prompt tables with routes, and finalised answers ready to store.

Template sentences are our own wording (parameters); the structure and trimming follow N11:

* ``refused``   – search on, safe mode on, scope verdict yes: history + quoted message + redirect;
* ``repeated``  – search on and the question was answered before in the chat (J5/J6);
* ``no_answer`` – search on, no answer survived the re-rank;
* ``answered``  – search on, answers found: their texts in answer order, sources listed;
* ``context``   – search off, a context chosen: one "answer in this context" line;
* ``plain``     – otherwise.

History is the rolling context (W1), cut to half the prompt budget under search, then
``'\\nUser: ' + m + '\\n\\nAgent: '`` is appended and the whole prompt is cut to the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery import config as C
from docquery.config import RetrievalConfig
from docquery.functions.text import (final_answer, lstrip_all, split_response, summary_text, tail_trim,
                                     wrap_dollars)

# Our own template wording ({ctx} = context display name).
REDIRECT = "Kindly steer back to {ctx}: this assistant only helps with {ctx}."
APOLOGY = ("No matching sources were found for this question; answer from general knowledge and "
           "suggest adding more detail.")
IN_CONTEXT = "Answer the next message with {ctx} in mind."


def _fmt(template: str, ctx) -> F.Column:
    parts = template.split("{ctx}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [ctx, F.lit(p)]
    return F.concat(*out)


def assemble_prompts(questions: DataFrame, answers_ctx: DataFrame, repeats: DataFrame,
                     cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """R6 (+R8): ``questions``: ``query_id, chat_id, message, history, search_on, safe_mode, context,
    unsafe_text`` (model verdict on scope, may be null); ``answers_ctx``: A4 rows (``query_id,
    context_text, sources``); ``repeats``: J6 rows (``query_id, text``).

    Returns ``query_id, chat_id, route, prompt, sources``."""
    L = cfg.max_prompt_length
    q = (questions.join(answers_ctx.select("query_id", "context_text", "sources"), "query_id", "left")
                  .join(repeats.select("query_id", F.col("text").alias("repeat_text")), "query_id", "left"))
    has_ctx = F.col("context").isNotNull() & (F.col("context") != C.NO_CONTEXT)
    search = F.col("search_on") & has_ctx
    unsafe = F.coalesce(F.lower(split_response(F.col("unsafe_text"))).contains("yes"), F.lit(False))
    h = tail_trim(F.col("history"), L)
    half = tail_trim(h, L / 2)
    n_ans = F.coalesce(F.size("sources"), F.lit(0))
    route = (F.when(search & F.col("safe_mode") & unsafe, F.lit("refused"))
              .when(search & F.col("repeat_text").isNotNull(), F.lit("repeated"))
              .when(search & (n_ans == 0), F.lit("no_answer"))
              .when(search, F.lit("answered"))
              .when(has_ctx, F.lit("context"))
              .otherwise(F.lit("plain")))
    q = q.withColumn("route", route)
    r = F.col("route")
    body = (F.when(r == "repeated", F.concat(half, F.col("repeat_text")))
             .when(r == "no_answer", F.concat(half, F.lit(APOLOGY)))
             .when(r == "answered", F.concat(half, F.col("context_text")))
             .when(r == "context", F.concat(h, F.lit("\n"), _fmt(IN_CONTEXT, F.col("context")), F.lit("\n")))
             .otherwise(h))
    tail = F.concat(F.lit("\nUser: "), F.col("message"), F.lit("\n\n" + C.PROMPT_AGENT_MARK))
    refused = F.concat(h, F.lit('\nUser: "'), F.col("message"), F.lit('"\n\n'), _fmt(REDIRECT, F.col("context")),
                       F.lit("\n\n" + C.AGENT_MARK))
    prompt = F.when(r == "refused", refused).otherwise(tail_trim(F.concat(body, tail), L))
    sources = F.when(r == "answered", F.col("sources")).otherwise(F.array().cast("array<string>"))
    return q.select("query_id", "chat_id", "route", prompt.alias("prompt"), sources.alias("sources"))


def finalise(prompts: DataFrame, responses: DataFrame, chats: DataFrame) -> DataFrame:
    """Model output → answer text (N5 with the route's marks), sources appended (P20), and the
    row to store (S11: left-stripped, ``$``-sanitised, wrapped); new chats get a P9 summary.

    ``responses``: ``query_id, text`` (raw model output); ``chats``: ``query_id, message, summary,
    paraphrase`` (summary ``New Chat`` for a new chat; paraphrase = model answer for P9)."""
    j = prompts.join(responses.select("query_id", F.col("text").alias("raw")), "query_id").join(chats, "query_id")
    refused = F.col("route") == "refused"
    text = F.when(refused, split_response(F.col("raw"), C.AGENT_MARK, C.ANSWER_MARK)) \
            .otherwise(split_response(F.col("raw"), C.PROMPT_AGENT_MARK, C.PROMPT_AGENT_MARK))
    answer = F.when(refused, text).otherwise(final_answer(text, F.col("sources")))
    summary = F.when(refused | (F.col("summary") != C.NEW_CHAT), F.col("summary")) \
               .otherwise(summary_text(F.col("paraphrase")))
    return j.select("query_id", "chat_id", "route", answer.alias("answer"),
                    lstrip_all(summary).alias("summary"),
                    wrap_dollars(F.col("message")).alias("stored_prompt"),
                    wrap_dollars(lstrip_all(answer)).alias("stored_response"))
