"""HTML → text with the standard-library parser, run inside Arrow batches (``mapInPandas``).

N2: text nodes are concatenated with no separator; comments, doctype and processing instructions are
dropped; ``<script>``/``<style>`` content is kept by default (``include_scripts``); a text node made only
of ASCII whitespace collapses to ``\\n`` if it holds a newline, else to one space (not inside
``<pre>``/``<textarea>``); character references are decoded.  A regex cannot do this: script bodies may
hold ``</p>``.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

_WS = " \n\t\x0c\r"
_PRESERVE = {"pre", "textarea"}
_RAW = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source",
         "track", "wbr"}


class _Text(HTMLParser):
    def __init__(self, include_scripts: bool = True, paragraphs: bool = False):
        super().__init__(convert_charrefs=True)
        self.include_scripts = include_scripts
        self.want_paragraphs = paragraphs
        self.parts: list[str] = []
        self.buf: list[str] = []
        self.stack: list[str] = []
        self.paras: list[list[str]] = []
        self.open_paras: list[int] = []  # indexes of the paragraphs that are open, outermost first

    def _flush(self):
        if not self.buf:
            return
        s = "".join(self.buf)
        self.buf = []
        if s.strip(_WS) == "" and not (_PRESERVE & set(self.stack)):
            s = "\n" if "\n" in s else " "
        if (not self.include_scripts) and (_RAW & set(self.stack)):
            return
        self.parts.append(s)
        for k in self.open_paras:  # an unclosed paragraph also holds the text of those within it
            self.paras[k].append(s)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        self.stack.append(tag)
        if tag == "p" and self.want_paragraphs:
            self.open_paras.append(len(self.paras))
            self.paras.append([])

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.stack:
            while self.stack:
                t = self.stack.pop()
                if t == "p" and self.open_paras:
                    self.open_paras.pop()
                if t == tag:
                    break

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()


def html_to_text(html: str | None, include_scripts: bool = True) -> str | None:
    if html is None:
        return None
    p = _Text(include_scripts)
    p.feed(html)
    p.close()
    return "".join(p.parts)


def html_paragraphs(html: str | None) -> list[str] | None:
    if html is None:
        return None
    p = _Text(True, paragraphs=True)
    p.feed(html)
    p.close()
    return ["".join(x) for x in p.paras]


def with_html_text(df: DataFrame, html_col: str = "html", out: str = "text", include_scripts: bool = True) -> DataFrame:
    """Add ``out`` = text of ``html_col`` (one Arrow batch at a time; the HTML column is dropped)."""
    from pyspark.sql.types import StringType, StructField, StructType

    fields = [f for f in df.schema.fields if f.name != html_col] + [StructField(out, StringType())]
    schema = StructType(fields)

    def run(batches):
        for pdf in batches:
            pdf[out] = [html_to_text(h, include_scripts) for h in pdf[html_col]]
            yield pdf.drop(columns=[html_col])

    return df.mapInPandas(run, schema)


def with_html_paragraphs(df: DataFrame, html_col: str = "html", out: str = "paragraphs") -> DataFrame:
    """Add ``out`` = texts of the ``<p>`` elements of ``html_col`` (array<string>)."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    fields = [f for f in df.schema.fields if f.name != html_col] + [StructField(out, ArrayType(StringType()))]
    schema = StructType(fields)

    def run(batches):
        for pdf in batches:
            pdf[out] = [html_paragraphs(h) for h in pdf[html_col]]
            yield pdf.drop(columns=[html_col])

    return df.mapInPandas(run, schema)
