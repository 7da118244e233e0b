"""HTML to Markdown. All but tables is a chain of native expressions; tables need a parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions.text import nonempty, trimmed

#: Named entities and their text. Each is decoded once; the ampersand comes last.
NAMED = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&#x27;": "'",
    "&#x60;": "`",
    "&nbsp;": " ",
    "&mdash;": "—",
    "&ndash;": "–",
    "&hellip;": "…",
    "&dagger;": "†",
    "&Dagger;": "‡",
    "&amp;": "&",
}
#: Tags that begin or end a line.
BLOCKS = (
    "p|div|li|tr|td|th|blockquote|section|pre|article|header|footer|nav|figure|figcaption|table|thead|tbody|tfoot"
    "|caption|col|colgroup|dl|dt|dd|address"
)


def math_to_latex(html: Column) -> Column:
    """``<math>`` elements become the trimmed TeX of their annotation: in ``$``, or if displayed in ``$$`` on lines of
    their own. Those with an empty annotation go."""
    before = r'(?:(?!</math>).)*?<annotation[^>]*encoding="application/x-tex"[^>]*>\s*'
    after = r"\s*</annotation>(?:(?!</math>).)*+</math>"
    note = before + r"((?:(?!\s*</annotation>).)++)" + after
    some = F.regexp_replace(html, r"(?is)<math[^>]*>" + before + after, "")
    block = F.regexp_replace(some, r'(?is)<math[^>]*display="?block[^>]*>' + note, "\n\\$\\$\n$1\n\\$\\$\n")
    return F.regexp_replace(block, r"(?is)<math[^>]*>" + note, r"\$$1\$")


def html_title(html: Column) -> Column:
    """The text of the document's heading, else of the title element; empty if there is neither."""
    named = F.regexp_extract(html, r"(?is)<h1[^>]*ltx_title_document[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.coalesce(nonempty(named), nonempty(title), F.lit(""))
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(text, "<[^>]+>", "")), r"\s+", " "))


def article_body(html: Column) -> Column:
    """What follows the mark of the content up to the end of the article; all without the mark."""
    body = F.regexp_extract(html, r'(?is)<div[^>]*class="[^"]*ltx_page_content[^"]*"[^>]*>(.*)', 1)
    return F.coalesce(nonempty(F.regexp_replace(body, r"(?is)</article>.*", "")), html)


def headings(html: Column) -> Column:
    for level in range(2, 7):
        html = F.regexp_replace(html, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", f"\n\n{'#' * level} $1\n\n")
    return html


def without_tags(html: Column) -> Column:
    for pattern, new in (
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?is)<br\s*/?>", "\n"),
        (rf"(?is)</?(?:{BLOCKS})[^>]*>", "\n"),
        (r"<[^>]+>", ""),
    ):
        html = F.regexp_replace(html, pattern, new)
    return html


def decoded(s: Column) -> Column:
    """Named entities and decimal ones, each once."""
    pattern = "&#\\d{1,7};|" + "|".join(NAMED)
    found, between = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)), F.split(s, pattern, -1)
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    shown = F.transform(found, lambda e: F.coalesce(F.try_element_at(named, e), _character(F.regexp_extract(e, r"^&#(\d+);$", 1).try_cast("int"))))
    joined = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(s, F.lit("&")), joined).otherwise(s)


def _character(n: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes; U+FFFD outside Unicode."""
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    tail = lambda k: byte(F.floor(n / 64**k) % 64 + 128)
    code = (
        F.when(n < 128, byte(n))
        .when(n < 2048, F.concat(byte(F.floor(n / 64) + 192), tail(0)))
        .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("EFBFBD"))
        .when(n < 65536, F.concat(byte(F.floor(n / 4096) + 224), tail(1), tail(0)))
        .otherwise(F.concat(byte(F.floor(n / 262144) + 240), tail(2), tail(1), tail(0)))
    )
    return F.decode(F.unhex(code), "UTF-8")


def tidy(s: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


class _Tables(HTMLParser):
    """Rows of the outermost tables of a document; header cells count as cells."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.align: list[str] = []
        self.caption = ""
        self.depth = 0
        self.open: str | None = None

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "table"
        if self.depth != 1:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open = tag
            if len(self.rows) == 1:
                text = " ".join(v or "" for _, v in attrs)
                self.align.append("right" if "right" in text else "center" if "center" in text else "left")
        elif tag == "caption":
            self.open = tag

    def handle_endtag(self, tag):
        self.depth -= tag == "table"
        if tag == self.open:
            self.open = None

    def handle_data(self, data):
        if self.open == "caption":
            self.caption += data
        elif self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def table_markdown(html: str) -> str:
    """One table element as a Markdown table, short rows padded; a caption comes first."""
    parser = _Tables()
    parser.feed(html)
    rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in parser.rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    rule = {"left": "---", "center": ":---:", "right": "---:"}
    marks = [rule[a] for a in parser.align[:width]]
    text = "\n".join([line(rows[0]), line(marks + ["---"] * (width - len(marks))), *map(line, rows[1:])])
    caption = re.sub(r"\s+", " ", parser.caption).strip()
    return f"**{caption}**\n\n{text}" if caption else text


_TABLE = re.compile(r"(?is)<figure[^>]*ltx_table[^>]*>.*?</figure>|<table\b.*?</table>")


@F.pandas_udf(StringType())
def tables_to_markdown(html: pd.Series) -> pd.Series:
    """Tables replaced by their Markdown, kept from the later steps by entities of its marks."""

    def one(text):
        if text is None or "<table" not in text.lower():
            return text
        return _TABLE.sub(lambda m: "\n\n" + table_markdown(m[0]).replace("&", "&amp;").replace("<", "&lt;") + "\n\n", text)

    return html.map(one, na_action="ignore")


def html_to_markdown(html: Column, tables: bool = True) -> Column:
    """The text of a page as Markdown, its title first. ``tables=False`` stays native; else pages with a table, and
    only these, pass a parser."""
    title = html_title(html)
    body = math_to_latex(html)
    if tables:
        body = F.coalesce(tables_to_markdown(F.when(F.contains(F.lower(html), F.lit("<table")), body)), body)
    body = tidy(decoded(without_tags(headings(article_body(body)))))
    return F.when(html == "", "").otherwise(trimmed(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)))
