"""Markup to plain text, wholly in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that end a line (fixed values).
UNSEEN = ("script", "style", "head")
LINES = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre")
#: Character references that mail and pages use most (fixed values); & comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _steps() -> list[tuple[str, str]]:
    """Patterns and what takes their place, in order, in the syntax that Java and RE2 share."""
    unseen = [(rf"(?is)<{t}(?:[ \t\r\n/][^>]*)?>.*?</{t}[ \t\r\n]*>", "") for t in UNSEEN]
    lines = [(rf"(?i)</?(?:{'|'.join(LINES)})(?:[ \t\r\n/][^>]*)?>", "\n"), (r"(?s)<!--.*?-->", ""), (r"<[^>]*>", "")]
    return [*unseen, *lines]


#: White space inside lines, around line breaks, and empty lines.
_SPACE = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))


def stripped(html: Column) -> Column:
    """Text of a page: no scripts, styles and head, a line per block, no empty
    lines; null stays null."""
    out = html
    for pattern, to in _steps():
        out = F.regexp_replace(out, pattern, to)
    for name, to in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(to))
    for pattern, to in _SPACE:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def stripped_sql(column: str) -> str:
    """The same steps as SQL text for another engine."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'" if "\n" not in s else f"'{s}'"
    out = column
    for pattern, to in _steps():
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    for name, to in REFERENCES:
        out = f"replace({out}, {quoted(name)}, {quoted(to)})"
    for pattern, to in _SPACE:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"
