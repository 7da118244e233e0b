"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are decoded, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
#: Characters that file names can't hold.
UNSAFE = '/\\:*?"<>|'
#: Marks of Markdown.
MARKDOWN = ["```", "**", "~~", "`", "\n- ", "\n* ", "\n1. ", "\n# ", "---", "> "]
#: Marks of TeX files, of main files, of errors of tokens and of the network.
TEX = ["\\documentclass", "\\begin{document}", "\\section"]
MAIN_TEX = ["\\documentclass", "\\documentstyle"]
TOKEN_ERRORS = ["99991663", "invalid access token"]
NETWORK_ERRORS = ["connection reset", "broken pipe", "i/o timeout", "connection refused"]
#: What a URL can't hold (CJK marks, full-width forms and ideographs, too), and what it can't end in.
URL_STOP = "\\s<>\"'()\u3000-\u303f\uff00-\uffef\u4e00-\u9fff"
URL_END = ".,;:!?)"


def trimmed(s: Column) -> Column:
    """Without white space at the ends, Unicode's too."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def nonempty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def truncated(s: Column, n: int, mark: str = "...") -> Column:
    """At most ``n`` code points, then ``mark`` if some were cut."""
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def truncated_bytes(s: Column, n: int, mark: str = "...") -> Column:
    """At most ``n`` bytes, then ``mark`` if some were cut; the cut never splits a code point."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(s) > n, F.concat(F.regexp_replace(cut, "\ufffd+$", ""), F.lit(mark))).otherwise(s)


def estimated_tokens(s: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(F.coalesce(s, F.lit(""))) / 4).cast("long")


def decoded_entities(s: Column) -> Column:
    for entity, value in ENTITIES.items():
        s = F.replace(s, F.lit(entity), F.lit(value))
    return s


def clean_text(s: Column) -> Column:
    """Without tags, entities decoded once, trimmed."""
    return trimmed(decoded_entities(F.regexp_replace(trimmed(s), "<[^>]*>", "")))


def safe_filename(s: Column) -> Column:
    return trimmed(F.translate(s, UNSAFE, "_" * len(UNSAFE)))


def escaped_yaml(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def short_authors(authors: Column) -> Column:
    """Of more than five authors the first three and the last two; fewer stay as they are written."""
    names = F.transform(F.split(authors, ","), trimmed)
    short = F.concat(F.array_join(F.concat(F.slice(names, 1, 3), F.slice(names, -2, 2)), ", "), F.lit(", et. al."))
    return F.when(F.size(names) > 5, short).otherwise(F.coalesce(authors, F.lit("")))


def without_mentions(s: Column) -> Column:
    return trimmed(F.replace(F.regexp_replace(s, "@_user_[0-9]*", ""), F.lit("@_all"), F.lit("")))


def masked(key: Column, shown: int = 4) -> Column:
    """A key of which only the first and last characters show, and none of a short one."""
    dots = F.lit("\u2022" * 4)
    some = F.concat(F.substring(key, 1, shown), dots, F.substring(key, -shown, shown))
    return F.when(key == "", "").when(F.length(key) <= 2 * shown, dots).otherwise(some)


def key_prefix(key: Column, shown: int = 5) -> Column:
    return F.when(F.length(key) < shown, "***").otherwise(F.substring(key, 1, shown))


def paper_ref(session_id: Column, id_: Column) -> Column:
    """The session id, else the legacy number, else empty."""
    return F.coalesce(nonempty(session_id), F.when(id_ > 0, id_.cast("string")), F.lit(""))


def short_ref(ref: Column) -> Column:
    """The first eight characters of a session id; other references are whole."""
    return F.when(ref.rlike(r"^(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})\z"), F.substring(ref, 1, 8)).otherwise(ref)


def session_id(seed: Column) -> Column:
    """A version-4 identifier made from a seed, so that a run can be repeated."""
    h = F.md5(seed.cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def contains_any(s: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(s, m))


def looks_like_tex(s: Column) -> Column:
    return contains_any(s, TEX)


def looks_like_main_tex(s: Column) -> Column:
    return contains_any(s, MAIN_TEX)


def has_markdown(s: Column) -> Column:
    return contains_any(s, MARKDOWN)


def is_token_error(message: Column) -> Column:
    """In whatever case; no message is no error."""
    return F.coalesce(contains_any(F.lower(message), TOKEN_ERRORS), F.lit(False))


def is_network_error(message: Column) -> Column:
    return F.coalesce(contains_any(message, NETWORK_ERRORS), F.lit(False))


def token_error(message: str) -> bool:
    """As :func:`is_token_error`, of an exception's text."""
    return any(mark in message.lower() for mark in TOKEN_ERRORS)


def network_error(message: str) -> bool:
    """As :func:`is_network_error`, of an exception's text."""
    return any(mark in message for mark in NETWORK_ERRORS)


def split_urls(s: Column) -> Column:
    """URLs in a text, up to the first stop character, and bare repository links after white space; marks at their end don't belong to them."""
    name = "[A-Za-z0-9][A-Za-z0-9._-]*"
    found = F.regexp_extract_all(s, F.lit(rf"(?i)\bhttps?://[^{URL_STOP}]+|(?:^|\s)github\.com/{name}/{name}"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(trimmed(u), f"[{URL_END}]+$", ""))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


#: Displayed formulas first: what stands between two dollars or in brackets, then in one dollar or parentheses.
_FORMULA = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)"


def split_latex(s: Column) -> Column:
    """The formulas of a text, in order, with their marks."""
    return F.regexp_extract_all(s, F.lit(_FORMULA), F.lit(0))


def latex_tokens(s: Column) -> Column:
    """``array<struct<math, display, content>>``: the pieces of a text, formulas without their marks."""
    found = split_latex(s)

    def formula(i: Column) -> Column:
        own = F.get(found, i)
        wide = F.startswith(own, F.lit("$$")) | F.startswith(own, F.lit("\\"))
        inner = F.when(wide, F.substring(own, F.lit(3), F.length(own) - 4)).otherwise(F.substring(own, F.lit(2), F.length(own) - 2))
        display = F.startswith(own, F.lit("$$")) | F.startswith(own, F.lit("\\["))
        return F.struct(F.lit(True).alias("math"), display.alias("display"), inner.alias("content"))

    plain = lambda p: F.struct(F.lit(False).alias("math"), F.lit(False).alias("display"), p.alias("content"))
    every = F.flatten(F.transform(F.split(s, _FORMULA, -1), lambda p, i: F.array(plain(p), formula(i))))
    return F.filter(every, lambda t: t["content"].isNotNull() & (t["math"] | (t["content"] != "")))
