"""Row-wise text functions (pure Column expressions, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquery import config as C


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def between_marks(text, mark) -> Column:
    """Python ``s.split(mark)[1]`` when ``mark`` occurs, else ``s`` unchanged (literal mark)."""
    t, m = _col(text), _lit(mark)
    return F.when(t.contains(m), F.split_part(t, m, F.lit(2))).otherwise(t)


def split_response(text, agent: str = C.AGENT_MARK, mark: str = C.ANSWER_MARK) -> Column:
    """Cut model output between the first two ``agent`` marks, then the same with ``mark``."""
    return between_marks(between_marks(text, agent), mark)


def verdict_flag(text) -> Column:
    """A yes/no verdict is yes when ``yes`` appears after N5, any case."""
    return F.lower(split_response(text, C.AGENT_MARK, C.ANSWER_MARK)).contains("yes")


def sanitize_dollars(text) -> Column:
    """P7 first half: runs of two or more ``$`` become one."""
    return F.regexp_replace(_col(text), r"[$]{2,}", r"\$")


def wrap_dollars(text) -> Column:
    """Sanitise, then wrap in ``$$ … $$`` as stored."""
    return F.concat(F.lit("$$"), sanitize_dollars(text), F.lit("$$"))


def unwrap_dollars(text) -> Column:
    """Remove every ``$$``."""
    return F.replace(_col(text), F.lit("$$"), F.lit(""))


def summary_text(text) -> Column:
    """Text after ``message: `` (whole text when absent), quotes dropped, 100 chars + ``...``."""
    s = F.replace(between_marks(text, C.SUMMARY_MARK), F.lit('"'), F.lit(""))
    return F.when(F.char_length(s) > C.SUMMARY_CHARS,
                  F.concat(F.substring(s, 1, C.SUMMARY_CHARS), F.lit(C.SUMMARY_ELLIPSIS))).otherwise(s)


def flatten_newlines(text) -> Column:
    """Newlines become spaces (``page_text``)."""
    return F.translate(_col(text), "\n", " ")


def tail_trim(text, limit) -> Column:
    """Drop leading characters until at most ``floor(limit)`` remain."""
    n = F.floor(_lit(limit)).cast("int")
    t = _col(text)
    return F.when(F.char_length(t) > n, F.substring(t, F.char_length(t) - n + 1, n)).otherwise(t)


def citation(title="title", chapter="chapter", page="page_number", author="author") -> Column:
    """``title[, Chapter c], Page p`` by chapter/page presence, plus ``, Author a`` when known."""
    t, c, p, a = _col(title), _col(chapter), _col(page), _col(author)
    base = (F.when((c == 0) & (p == 0), t)
             .when(c == 0, F.concat(t, F.lit(", Page "), p.cast("string")))
             .otherwise(F.concat(t, F.lit(", Chapter "), c.cast("string"), F.lit(", Page "), p.cast("string"))))
    return F.when(a != F.lit(C.UNKNOWN_AUTHOR), F.concat(base, F.lit(", Author "), a)).otherwise(base)


def final_answer(text, sources) -> Column:
    """P20: ``text`` + ``\\n\\nSources:`` + one line per source (when any) + ``\\n``."""
    s = _col(sources)
    listed = F.concat(F.lit(C.SOURCES_HEADER), F.lit("\n"), F.array_join(s, "\n"))
    return F.concat(_col(text), F.when(F.coalesce(F.size(s), F.lit(0)) > 0, listed).otherwise(F.lit("")), F.lit("\n"))


def context_slug(name) -> Column:
    """Lower-case, drop every non-word character (Unicode aware), prefix ``context_`` before a digit.

    Names with no word character give null (the reference raises on them).
    """
    s = F.regexp_replace(F.lower(_col(name)), r"(?U)\W+", "")
    return (F.when(s == "", F.lit(None).cast("string"))
             .when(s.rlike(r"^(?U)\d"), F.concat(F.lit("context_"), s))
             .otherwise(s))


def split_author(path, ext) -> Column:
    """struct(title, author) from a file path and its lower-case extension.

    The stem is the text before the first occurrence of ``ext`` anywhere in the path; the name is the
    part after the last ``/``. ``Author `` is tried before ``author ``; otherwise author ``Unknown``.
    """
    e = _lit(ext)
    stem = F.split_part(_col(path), e, F.lit(1))
    name = F.substring_index(stem, "/", -1)
    up, low = C.AUTHOR_MARKERS
    title = (F.when(name.contains(up), F.split_part(name, F.lit(up), F.lit(1)))
              .when(name.contains(low), F.split_part(name, F.lit(low), F.lit(1)))
              .otherwise(name))
    author = (F.when(name.contains(up), F.split_part(name, F.lit(up), F.lit(2)))
               .when(name.contains(low), F.split_part(name, F.lit(low), F.lit(2)))
               .otherwise(F.lit(C.UNKNOWN_AUTHOR)))
    return F.struct(title.alias("title"), author.alias("author"))


def source_kind(path) -> Column:
    """The first suffix (in the fixed dispatch order) the lower-cased path ends with, else null."""
    low = F.lower(_col(path))
    out = F.lit(None).cast("string")
    for suf in reversed(C.SOURCE_SUFFIXES):
        out = F.when(low.endswith(suf), F.lit(suf)).otherwise(out)
    return out


def omit_list(text) -> Column:
    """``''`` → null, otherwise split on ``', '``."""
    t = _col(text)
    return F.when(t == "", F.lit(None).cast("array<string>")).otherwise(F.split(t, ", "))


def strip_all(text) -> Column:
    """Python ``str.strip()`` (all leading/trailing whitespace)."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"^\s+", ""), r"\s+$", "")


def lstrip_all(text) -> Column:
    """Python ``str.lstrip()``."""
    return F.regexp_replace(_col(text), r"^\s+", "")
