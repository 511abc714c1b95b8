"""Tunables and fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour for equal results.
# ---------------------------------------------------------------------------
CHUNK_SIZE = 1000                 # characters per chunk
HISTORY_PAIRS = 5                 # (prompt, response) pairs kept as rolling context
REPEAT_COSINE = 0.9               # strict ">" for the "already answered" lookup
SUMMARY_CHARS = 100               # summary truncation length, then "..."
SUMMARY_ELLIPSIS = "..."
UNKNOWN_AUTHOR = "Unknown"
NO_CHAPTER_TITLE = "None"
NEW_CHAT = "New Chat"
NO_CONTEXT = "< None >"
SOURCE_SUFFIXES = [".html", ".pdf", ".epub", ".txt", ".docx", ".doc", ".md"]  # dispatch order
AUTHOR_MARKERS = ["Author ", "author "]                                        # tried in this order
AGENT_MARK = "Assistant: "
ANSWER_MARK = "Answer: "
PROMPT_AGENT_MARK = "Agent: "
SUMMARY_MARK = "message: "
SOURCES_HEADER = "\n\nSources:"

# Our own choices (not values of the reference).
EMBED_BUCKETS = 384               # hashed bag-of-tokens width
TOKEN_PATTERN = r"[\p{L}\p{N}'-]+"  # maximal runs of letters, digits, apostrophe, dash
ID_SEPARATOR = "\u0001"


@dataclass(frozen=True)
class RetrievalConfig:
    """The seven tunables of a retrieval run (defaults as shipped)."""

    answers_limit: int = 4            # top-k after re-rank (1..20)
    keywords_limit: int = 6           # keywords kept (1..20)
    max_results_per_search: int = 4   # LIMIT of every search pattern (1..20)
    max_search_results: int = 15      # hits kept per query after the cascade (1..100)
    score_threshold: float = 0.16     # strict ">" on cosine (0..1)
    max_prompt_length: int = 9000     # characters (1000..16000)
    max_tokens: int = 4096            # model limit only; unused by data work

    def __post_init__(self) -> None:
        checks = [
            (1 <= self.answers_limit <= 20, "answers_limit"),
            (1 <= self.keywords_limit <= 20, "keywords_limit"),
            (1 <= self.max_results_per_search <= 20, "max_results_per_search"),
            (1 <= self.max_search_results <= 100, "max_search_results"),
            (0.0 <= self.score_threshold <= 1.0, "score_threshold"),
            (1000 <= self.max_prompt_length <= 16000, "max_prompt_length"),
            (1024 <= self.max_tokens <= 8192, "max_tokens"),
        ]
        bad = [name for ok, name in checks if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
