"""Conversation tables: S11, W1, W2, A2, T6, U2–U4, J9, P8, P9.

``messages``: ``chat_id, id, datetime (timestamp_ntz), summary, prompt, response`` – one row per stored
(prompt, response) pair, texts wrapped in ``$$`` as stored.  All operators are column expressions,
joins and partial aggregates; order inside a chat comes from a global position (range partitioning),
never from a window per chat, so one chat holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery import config as C
from docquery.functions.text import lstrip_all, summary_text, tail_trim, unwrap_dollars, wrap_dollars
from docquery.operators.sequence import group_position, next_row, ordered_index, preceding_rows

EPOCH = "2024-01-01 00:00:00"   # fixture clock: message time = EPOCH + turn minutes
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Drop ``system`` turns, pair each ``user`` turn with the next turn when it is ``assistant``.

    Returns ``conv_id, turn, prompt, response`` (response null = unanswered user turn).  The next
    turn is found by position (:mod:`docquery.operators.sequence`), not by a window per conversation.
    """
    c = conversations.where(F.col("role") != "system").select("conv_id", "turn", "role", "text")
    nxt = next_row(ordered_index(c, ["conv_id"], ["turn"]), ["conv_id"], ["role", "text"])
    return (nxt.where(F.col("role") == "user")
               .select("conv_id", "turn", F.col("text").alias("prompt"),
                       F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response")))


def _chat_cols(pairs: DataFrame) -> DataFrame:
    ts = F.expr(f"timestampadd(MINUTE, turn, TIMESTAMP_NTZ'{EPOCH}')")
    # first prompt of each conversation: partial aggregate per key, joined back on the key
    first = pairs.groupBy("conv_id").agg(F.min_by("prompt", F.col("turn")).alias("first_prompt"))
    return pairs.join(first, "conv_id").select(
        F.concat(F.lit("chat_"), F.col("conv_id").cast("string")).alias("chat_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        ts.alias("datetime"),
        lstrip_all(summary_text(F.col("first_prompt"))).alias("summary"),
        "prompt", "response")


def messages_from_conversations(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """S11 (batch form of ``update_db``): answered pairs as stored message rows (``$$``-wrapped).
    ``pairs``: :func:`pair_turns` of the same conversations when already computed."""
    p = _chat_cols(pair_turns(conversations) if pairs is None else pairs)
    return (p.where(F.col("response").isNotNull())
             .select("chat_id", "id", "datetime", "summary", wrap_dollars(F.col("prompt")).alias("prompt"),
                     wrap_dollars(lstrip_all(F.col("response"))).alias("response")))


def current_questions(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The unanswered last user turn of each chat: ``chat_id, id, datetime, summary, message``."""
    p = _chat_cols(pair_turns(conversations) if pairs is None else pairs)
    last = (p.groupBy("chat_id")
             .agg(F.max_by(F.struct("id", "datetime", "summary", "prompt", "response"),
                           F.struct("datetime", "id")).alias("m")))
    return (last.where("m.response IS NULL")
                .select("chat_id", "m.id", "m.datetime", "m.summary", F.col("m.prompt").alias("message")))


def chat_history(messages: DataFrame) -> DataFrame:
    """T6 + P8: chronological (prompt, response) of each chat, ``$$`` removed; ties on the timestamp
    keep the row with the largest id (the reference keys its dict by timestamp)."""
    g = (messages.groupBy("chat_id", "datetime")
                 .agg(F.max_by(F.struct("id", "prompt", "response"), F.col("id")).alias("m")))
    pos = group_position(ordered_index(g, ["chat_id"], ["datetime"]), ["chat_id"])
    return pos.select("chat_id", F.col("_pos").cast("int").alias("seq"),
                      F.date_format("datetime", TS_FORMAT).alias("datetime"),
                      unwrap_dollars(F.col("m.prompt")).alias("prompt"),
                      unwrap_dollars(F.col("m.response")).alias("response"))


def rolling_context(messages: DataFrame, questions: DataFrame, max_prompt_length: int = 9000) -> DataFrame:
    """For every message and every current question, the last 5 (prompt, response) pairs before
    it joined by a blank line, keeping the last ``max_prompt_length`` characters.

    The ROWS frame (5 preceding .. 1 preceding) is a window over blocks of positions, each with the last five rows
    of the block before, so a chat of any size is spread over many tasks and its texts are not copied per frame.
    """
    hist = chat_history(messages).select("chat_id", "datetime", F.lit(0).alias("q"), "prompt", "response",
                                         F.col("seq").cast("string").alias("ref"))
    qs = questions.select("chat_id", F.date_format("datetime", TS_FORMAT).alias("datetime"), F.lit(1).alias("q"),
                          F.col("message").alias("prompt"), F.lit(None).cast("string").alias("response"),
                          F.col("id").alias("ref"))
    idx = ordered_index(hist.unionByName(qs), ["chat_id"], ["datetime", "q", "ref"])
    prev = preceding_rows(idx, ["chat_id"], F.struct("prompt", "response"), C.HISTORY_PAIRS, "prev")
    text = F.array_join(F.flatten(F.transform("prev", lambda e: F.array(e["prompt"], e["response"]))), "\n\n")
    return prev.select("chat_id", "datetime", F.col("q").cast("boolean").alias("is_question"), "ref",
                       tail_trim(F.coalesce(text, F.lit("")), max_prompt_length).alias("history"))


def chat_list(messages: DataFrame) -> DataFrame:
    """A2: one summary per chat (the earliest message's), in chat-id order."""
    return (messages.groupBy("chat_id")
                    .agg(F.min_by("summary", F.struct("datetime", "id")).alias("summary"))
                    .select("chat_id", "summary"))


def chat_by_name(messages: DataFrame, names: DataFrame) -> DataFrame:
    """``names(name)`` → the first chat (smallest id) whose summary equals the name; none → no row."""
    cl = chat_list(messages)
    return (names.join(cl, names["name"] == cl["summary"])
                 .groupBy("name").agg(F.min("chat_id").alias("chat_id")))


def rename_chat(messages: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames(chat_id, new_chat_id, new_summary)`` – copy rows under the new id and summary,
    drop the old; ids, timestamps and texts are kept. Other chats are untouched."""
    r = renames.select("chat_id", "new_chat_id", "new_summary")
    moved = (messages.join(r, "chat_id")
                     .select(F.col("new_chat_id").alias("chat_id"), "id", "datetime",
                             F.col("new_summary").alias("summary"), "prompt", "response"))
    kept = messages.join(r.select("chat_id"), "chat_id", "left_anti")
    return kept.unionByName(moved)


def delete_chat(messages: DataFrame, deletions: DataFrame) -> DataFrame:
    """Remove every row of the listed chats (``deletions(chat_id)``)."""
    return messages.join(deletions.select("chat_id"), "chat_id", "left_anti")


def next_chat_after_delete(messages: DataFrame, deletions: DataFrame) -> DataFrame:
    """U3 follow-up: the chat opened after deleting – smallest remaining chat id, else ``New Chat``."""
    rest = chat_list(delete_chat(messages, deletions))
    return (rest.agg(F.min_by("summary", F.col("chat_id")).alias("summary"), F.min("chat_id").alias("chat_id"))
                .select(F.coalesce("chat_id", F.lit(None)).alias("chat_id"),
                        F.coalesce("summary", F.lit(C.NEW_CHAT)).alias("summary")))


def delete_all_chats(messages: DataFrame) -> DataFrame:
    """U4: the empty messages table (same schema)."""
    return messages.where(F.lit(False))
