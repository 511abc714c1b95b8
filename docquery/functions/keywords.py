"""Keyword functions: N7 sanitising and N8 search variants (array expressions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_keywords(text, omit=None, limit=6) -> Column:
    """Split on each ``,`` or space; keep ``[a-zA-Z0-9'-]``; drop empty and omitted (exact case);
    strip a leading ``\\d+.``; keep the first ``limit``. Duplicates are kept."""
    omit_c = F.coalesce(_col(omit), F.array().cast("array<string>")) if omit is not None \
        else F.array().cast("array<string>")
    parts = F.transform(F.split(_col(text), "[, ]"), lambda k: F.regexp_replace(k, r"[^a-zA-Z0-9'-]", ""))
    kept = F.filter(parts, lambda k: (k != "") & ~F.array_contains(omit_c, k))
    cleaned = F.transform(kept, lambda k: F.regexp_replace(k, r"^\d+\.", ""))
    n = limit if isinstance(limit, Column) else F.lit(int(limit))
    return F.slice(cleaned, F.lit(1), n)


def py_title(text) -> Column:
    """Python ``str.title()`` for ASCII keywords: each run of letters gets an upper first letter and
    lower rest; non-letters are kept (``foo-bar`` → ``Foo-Bar``, ``3d`` → ``3D``)."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"([a-zA-Z]+|[^a-zA-Z]+)"), 0)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                             F.lower(F.substring(w, 2, 1 << 30)))), "")


def capitalize(text) -> Column:
    """Python ``str.capitalize()``: first character upper, the rest lower."""
    t = _col(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))


def wildcard_form(keyword) -> Column:
    """Apostrophes become the one-character wildcard ``?``."""
    return F.replace(_col(keyword), F.lit("'"), F.lit("?"))


def like_body(term) -> Column:
    """A search term as a LIKE body: ``?`` → ``_`` (terms hold only ``[a-zA-Z0-9?-]``)."""
    return F.replace(_col(term), F.lit("?"), F.lit("_"))
