"""Paper ids and links: what users and feeds write, made canonical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import clean_text, nonempty, trimmed

# The forms of ids and of the hosts that serve them.
NEW_ID = r"\d{4}\.\d{4,5}(?:v\d+)?"
OLD_ID = r"[A-Za-z-]+(?:\.[A-Za-z]{2})?/\d{7}(?:v\d+)?"
HOSTS = r"(?:www\.|export\.)?arxiv\.org"
VIEWS = r"(?:abs|pdf|html|e-print)"


def arxiv_id(s: Column) -> Column:
    """The first new-style id in a text, without its version; empty if there is none."""
    return F.regexp_extract(s, r"(\d{4}\.\d{4,5})(v\d+)?", 1)


def normalized_arxiv(s: Column) -> Column:
    """``struct<url, id, ok>`` of an id, a prefixed id or a link; the version stays in the id."""
    x = trimmed(F.regexp_replace(trimmed(s), r"(?i)^arxiv:", ""))
    plain = F.regexp_extract(x, rf"^({NEW_ID}|{OLD_ID})(?:\.pdf)?$", 1)
    link = F.regexp_extract(x, rf"^(?i:https?://{HOSTS}/)/*{VIEWS}/({NEW_ID}|{OLD_ID})(?:\.pdf)?/*(?:[?#].*)?$", 1)
    own = F.coalesce(nonempty(plain), nonempty(link), F.lit(""))
    url = F.when(own != "", F.concat(F.lit("https://arxiv.org/abs/"), own)).otherwise("")
    return F.struct(url.alias("url"), own.alias("id"), (own != "").alias("ok"))


def id_of_abs_url(url: Column) -> Column:
    """The id of an abstract page's link, without version; other views and hosts give none."""
    return F.regexp_extract(url, rf"^https?://(?:www\.)?arxiv\.org/abs/({NEW_ID}|{OLD_ID})/?(?:[?#].*)?$", 1)


def pdf_url(url: Column) -> Column:
    """The document of an abstract page's link, with its extension; other links as they are."""
    page = "https://arxiv.org/abs/"
    own = F.substring(url, F.lit(len(page) + 1), F.length(url))
    return F.when(F.startswith(url, F.lit(page)), F.concat(F.lit("https://arxiv.org/pdf/"), own, F.lit(".pdf"))).otherwise(url)


def shown_pdf_url(url: Column) -> Column:
    """As :func:`pdf_url` for the page of articles: either scheme, no extension."""
    return F.regexp_replace(url, r"^https?://arxiv\.org/abs/", "https://arxiv.org/pdf/")


def github_url(s: Column) -> Column:
    """The first repository link; one with a scheme wins over a bare one, wherever they stand."""
    name = r"([A-Za-z0-9][A-Za-z0-9._-]*)"
    clean = lambda part: F.regexp_replace(F.regexp_replace(part, r"\.git$", ""), r"[.,;:!?)\]}]+$", "")

    def first(before: str) -> Column:
        pattern = rf"(?i){before}github\.com/{name}/{name}"
        a, b = clean(F.regexp_extract(s, pattern, 1)), clean(F.regexp_extract(s, pattern, 2))
        return F.when((a != "") & (b != ""), F.concat(F.lit("https://github.com/"), a, F.lit("/"), b))

    return F.coalesce(first(r"\bhttps?://"), first(r"(?<![A-Za-z0-9./])"), F.lit(""))


def is_url(s: Column) -> Column:
    return F.startswith(s, F.lit("http://")) | F.startswith(s, F.lit("https://"))


def is_file_path(s: Column) -> Column:
    return s.rlike(r"^(?:/|\./|\.\./|~)")


def is_variable_name(s: Column) -> Column:
    """Two or more capitals and underscores."""
    return s.rlike(r"^[A-Z_]{2,}\z")


def feed_description(s: Column) -> Column:
    """``struct<abstract, announce>`` of a feed item's description: a line about the item, then the abstract."""
    s = clean_text(s)
    first = F.substring_index(s, "\n", 1)
    rest = trimmed(F.substring(s, F.length(first) + 2, F.length(s)))
    return F.struct(
        trimmed(F.regexp_replace(rest, "^Abstract:", "")).alias("abstract"),
        F.regexp_extract(first, r"Announce Type:\s*(\S+)", 1).alias("announce"),
    )


def author_of_description(s: Column) -> Column:
    line = trimmed(F.substring_index(s, "\n", 1))
    return F.when(F.startswith(line, F.lit("Authors:")), trimmed(F.regexp_replace(line, "^Authors:", ""))).otherwise("")


def split_references(s: Column) -> Column:
    """``struct<body, refs>``: from a TeX bibliography, else from the first heading of references."""
    tex = F.locate("\\begin{thebibliography}", s)
    heading = F.regexp_instr(s, F.lit(r"(?mi)^#{1,4}[ \t]+(?:references|bibliography)[ \t]*$"))
    at = F.when(tex > 0, tex).otherwise(heading)
    body = F.when(at > 0, trimmed(F.substring(s, F.lit(1), at - 1))).otherwise(s)
    refs = F.when(at > 0, trimmed(F.substring(s, at, F.length(s)))).otherwise("")
    return F.struct(body.alias("body"), refs.alias("refs"))


def id_of_page(pathname: Column, canonical: Column, first_link: Column) -> Column:
    """A page's id: from its path, else its canonical link, else its first abstract link."""
    from_path = F.regexp_extract(pathname, rf"^/{VIEWS}/({NEW_ID}|{OLD_ID})", 1)
    from_link = lambda c: F.regexp_extract(c, rf"{HOSTS}/{VIEWS}/({NEW_ID}|{OLD_ID})", 1)
    return F.coalesce(nonempty(from_path), nonempty(from_link(canonical)), nonempty(from_link(first_link)), F.lit(""))
