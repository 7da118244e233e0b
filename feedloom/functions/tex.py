"""TeX to Markdown, and formulas to Unicode.

Brace matching and nested environments are no regular language, so this is one parser, run in
Arrow batches. Tables of names hold fixed values; what follows a rule (Greek, letters with accents,
super- and subscripts) is made from Unicode names.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Symbols by macro name.
SYMBOLS = {
    "times": "×", "cdot": "·", "pm": "±", "mp": "∓", "div": "÷", "ast": "*", "star": "⋆", "circ": "∘", "bullet": "•",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "sim": "∼",
    "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "in": "∈", "notin": "∉", "ni": "∋",
    "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅",
    "forall": "∀", "exists": "∃", "neg": "¬", "land": "∧", "lor": "∨", "wedge": "∧", "vee": "∨", "oplus": "⊕",
    "otimes": "⊗", "to": "→", "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒",
    "Leftarrow": "⇐", "Leftrightarrow": "⇔", "mapsto": "↦", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑",
    "prod": "∏", "int": "∫", "sqrt": "√", "angle": "∠", "perp": "⊥", "parallel": "∥", "ldots": "…", "dots": "…",
    "cdots": "⋯", "prime": "′", "hbar": "ℏ", "ell": "ℓ", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "langle": "⟨",
    "rangle": "⟩", "lceil": "⌈", "rceil": "⌉", "lfloor": "⌊", "rfloor": "⌋", "degree": "°", "dagger": "†", "ddagger": "‡",
    "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "euro": "€", "ss": "ß", "SS": "SS", "ae": "æ", "AE": "Æ",
    "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "aa": "å", "AA": "Å",
    "quad": " ", "qquad": "  ", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "item": "- ",
    "varepsilon": "ε", "vartheta": "θ", "omicron": "ο", "varpi": "π", "varrho": "ρ", "varsigma": "ς", "varphi": "φ",
    "vdots": "⋮", "ddots": "⋱", "varnothing": "∅", "gets": "←", "uparrow": "↑", "downarrow": "↓", "mid": "∣",
    "triangle": "△", "triangleq": "≜", "imath": "ı", "jmath": "ȷ",
    "textless": "<", "textgreater": ">", "textbar": "|", "textdegree": "°",
}
#: Symbols that look otherwise within a formula.
FORMULA_SYMBOLS = {"varpi": "ϖ", "varrho": "ϱ", "varphi": "ϕ"}
#: Names of functions stand as they are.
FUNCTION_NAMES = "sin cos tan log ln exp max min arg argmin argmax sup inf lim det tr rank".split()
GREEK = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega"
).split()
ACCENTS = {"'": "ACUTE", "`": "GRAVE", "^": "CIRCUMFLEX", '"': "DIAERESIS", "~": "TILDE", "=": "MACRON", ".": "DOT ABOVE", "c": "CEDILLA", "v": "CARON", "u": "BREVE", "H": "DOUBLE ACUTE", "r": "RING ABOVE"}
HEADINGS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
WRAPS = {"textbf": "**", "bf": "**", "textit": "*", "emph": "*", "textsl": "*", "texttt": "`", "verb": "`"}
PLAIN = {"text", "textrm", "textsf", "textsc", "mbox", "underline", "mathrm", "operatorname", "caption", "url", "footnote", "title", "author"}
DROPPED = {"label", "cite", "citep", "citet", "ref", "eqref", "autoref", "cref", "vspace", "hspace", "includegraphics", "bibliography", "bibliographystyle", "usepackage", "documentclass", "thanks", "pagestyle", "thispagestyle", "setlength", "newcommand", "renewcommand", "def", "input", "centering", "maketitle"}
EQUATIONS = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath"}

SYMBOLS |= {_name: _name for _name in FUNCTION_NAMES}
for _name in GREEK:
    _kind = "CAPITAL" if _name[0].isupper() else "SMALL"
    SYMBOLS[_name] = unicodedata.lookup(f"GREEK {_kind} LETTER {'LAMDA' if _name.lower() == 'lambda' else _name.upper()}")


def _group(s: str, i: int, left: str = "{", right: str = "}") -> tuple[str, int]:
    """(content, place after it) of the group that begins at ``i``; the next token if none does."""
    while i < len(s) and s[i] in " \t\n":
        i += 1
    if i >= len(s):
        return "", i
    if s[i] != left:
        m = re.match(r"\\[A-Za-z]+|\\.|.", s[i:], re.S)
        return (m[0], i + m.end()) if left == "{" else ("", i)
    depth, j = 0, i
    while j < len(s):
        if s[j] == "\\":
            j += 2
            continue
        depth += (s[j] == left) - (s[j] == right)
        j += 1
        if not depth:
            return s[i + 1 : j - 1], j
    return s[i + 1 :], len(s)


def without_comments(tex: str) -> str:
    """Comments up to the line's end, and what stands between ``\\iffalse`` and ``\\fi``."""
    tex = re.sub(r"\\iffalse\b.*?\\fi\b", "", tex, flags=re.S)
    return re.sub(r"(?<!\\)((?:\\\\)*)%[^\n]*\n?", r"\1", tex)


def document_body(tex: str) -> str:
    m = re.search(r"\\begin\s*\{document\}(.*?)(?:\\end\s*\{document\}|\Z)", tex, re.S)
    return m[1] if m else tex


def without_definitions(tex: str) -> str:
    """Macro definitions taken out (they are not expanded)."""
    out, at = [], 0
    for m in re.finditer(r"\\(?:re|provide)?newcommand\*?|\\renewcommand\*?|\\providecommand\*?|\\def\b|\\newtheorem\*?|\\DeclareMathOperator\*?", tex):
        if m.start() < at:
            continue
        out.append(tex[at : m.start()])
        i = m.end()
        if m[0] == r"\def":
            i = tex.find("{", i) if "{" in tex[i:] else len(tex)
            _, at = _group(tex, i)
            continue
        _, i = _group(tex, i)
        while re.match(r"\s*\[", tex[i:]):
            _, i = _group(tex, i, "[", "]")
        _, at = _group(tex, i)
    return "".join([*out, tex[at:]])


def alignments(spec: str) -> list[str]:
    """Of a column specification: l, c or r for each column."""
    out, i = [], 0
    while i < len(spec):
        c = spec[i]
        if c == "*":
            n, i = _group(spec, i + 1)
            part, i = _group(spec, i)
            out += alignments(part) * (int(n) if n.isdigit() else 1)
            continue
        if c in "@!><":
            _, i = _group(spec, i + 1)
            continue
        if c in "pmbX":
            out.append("l")
            i = _group(spec, i + 1)[1] if spec[i + 1 : i + 2] == "{" else i + 1
            continue
        if c in "lcr":
            out.append(c)
        i += 1
    return out


def _cells(s: str, mark: str) -> list[str]:
    """Split at a mark outside braces."""
    out, depth, now, i = [], 0, "", 0
    while i < len(s):
        if not depth and s.startswith(mark, i):
            out.append(now)
            now, i = "", i + len(mark)
            continue
        step = 2 if s[i] == "\\" else 1
        depth += (s[i] == "{") - (s[i] == "}")
        now += s[i : i + step]
        i += step
    return [*out, now]


def tabular(spec: str, body: str) -> str:
    """A Markdown table; cells that span columns are padded, short rows too."""
    align = alignments(spec)
    rows = []
    for line in _cells(body, "\\\\"):
        line = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\c(?:mid)?line(?:\([^)]*\))?\s*\{[^}]*\}", "", line).strip()
        if not line:
            continue
        row = []
        for cell in _cells(line, "&"):
            cell, extra = cell.strip(), 0
            if m := re.match(r"\\multicolumn\s*", cell):
                n, i = _group(cell, m.end())
                _, i = _group(cell, i)
                cell, _ = _group(cell, i)
                extra = max(0, int(n) - 1) if n.isdigit() else 0
            elif m := re.match(r"\\multirow\s*", cell):
                _, i = _group(cell, m.end())
                _, i = _group(cell, i)
                cell, _ = _group(cell, i)
            row += [re.sub(r"\s+", " ", inline(cell)).strip().replace("|", "\\|")] + [""] * extra
        rows.append(row)
    if not rows:
        return ""
    width = max(len(align), *map(len, rows))
    show = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    rule = {"l": "---", "c": ":---:", "r": "---:"}
    return "\n".join([show(rows[0]), show([rule[a] for a in align] + ["---"] * (width - len(align))), *map(show, rows[1:])])


def inline(s: str) -> str:
    """Macros of running text; formulas stay as they are."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "$":
            mark = "$$" if s.startswith("$$", i) else "$"
            end = s.find(mark, i + len(mark))
            end = len(s) if end < 0 else end + len(mark)
            out.append(s[i:end])
            i = end
        elif c in "{}":
            i += 1
        elif c == "~":
            out.append(" ")
            i += 1
        elif c != "\\":
            out.append(c)
            i += 1
        elif s.startswith("\\\\", i):
            out.append("\n")
            i += 2
            _, i = _group(s, i, "[", "]") if s[i : i + 1] == "[" else ("", i)
        elif m := re.match(r"\\([A-Za-z]+)\*?", s[i:]):
            name, i = m[1], i + m.end()
            if name in HEADINGS:
                text, i = _group(s, i)
                out.append(f"\n\n{'#' * HEADINGS[name]} {inline(text).strip()}\n\n")
            elif name in WRAPS and s[i : i + 1] == "{":
                text, i = _group(s, i)
                out.append(f"{WRAPS[name]}{inline(text).strip()}{WRAPS[name]}")
            elif name == "href":
                url, i = _group(s, i)
                text, i = _group(s, i)
                out.append(f"[{inline(text)}]({url})")
            elif name in PLAIN and s[i : i + 1] == "{":
                text, i = _group(s, i)
                out.append(inline(text))
            elif name in DROPPED:
                while s[i : i + 1] in ("[", "{"):
                    _, i = _group(s, i, s[i], "]" if s[i] == "[" else "}")
            elif name in ACCENTS and len(name) == 1 and s[i : i + 1] in ("{", " "):
                text, i = _group(s, i)
                out.append(_accented(name, text))
            elif name in SYMBOLS:
                out.append(SYMBOLS[name])
                i += s[i : i + 1] == " " and name != "item" and name not in FUNCTION_NAMES
            else:
                i += s[i : i + 1] == " "
        else:
            mark = s[i + 1 : i + 2]
            i += 2
            if mark in ACCENTS and mark:
                text, i = _group(s, i)
                out.append(_accented(mark, text))
            elif mark in ("(", ")", "[", "]"):
                out.append("$" if mark in "()" else "$$")
            else:
                out.append({",": " ", ";": " ", ":": " ", "!": "", "/": ""}.get(mark, mark))
    return "".join(out)


def _accented(mark: str, text: str) -> str:
    letter = {"ı": "i", "ȷ": "j"}.get(inline(text).strip(), inline(text).strip())
    return unicodedata.normalize("NFC", letter[:1] + unicodedata.lookup(_COMBINING[ACCENTS[mark]]) + letter[1:]) if letter else ""


_COMBINING = {name: f"COMBINING {name}" + (" ACCENT" if name in ("ACUTE", "GRAVE", "CIRCUMFLEX", "DOUBLE ACUTE") else "") for name in ACCENTS.values()}

_BEGIN = re.compile(r"\\begin\s*\{([A-Za-z*]+)\}")


def _items(body: str) -> list[str]:
    """What follows each item of a list, without splitting lists within it."""
    cuts, depth = [], 0
    for m in re.finditer(r"\\begin\b|\\end\b|\\item\b", body):
        depth += (m[0] == r"\begin") - (m[0] == r"\end")
        if m[0] == r"\item" and not depth:
            cuts.append((m.start(), m.end()))
    ends = [a for a, _ in cuts[1:]] + [len(body)]
    return [body[b:e] for (_, b), e in zip(cuts, ends, strict=True)]


def _environments(s: str) -> str:
    """Environments from the outside in; running text between them goes through :func:`inline`."""
    out, at = [], 0
    while m := _BEGIN.search(s, at):
        out.append(inline(s[at : m.start()]))
        name, depth, end = m[1], 1, len(s)
        for x in re.finditer(r"\\(begin|end)\s*\{" + re.escape(name) + r"\}", s[m.end() :]):
            depth += 1 if x[1] == "begin" else -1
            if not depth:
                end = m.end() + x.start()
                at = m.end() + x.end()
                break
        else:
            at = len(s)
        body = s[m.end() : end]
        if name in EQUATIONS:
            out.append(f"\n\n$${re.sub(r'\\label\s*{[^}]*}', '', body).strip()}$$\n\n")
        elif name in ("verbatim", "lstlisting"):
            out.append(f"\n\n```\n{body.strip(chr(10))}\n```\n\n")
        elif name.rstrip("*") in ("tabular", "tabularx", "array"):
            i = 0
            if name.startswith("tabular") and name != "tabular":
                _, i = _group(body, 0)
            if body[i : i + 1] == "[":
                _, i = _group(body, i, "[", "]")
            spec, i = _group(body, i)
            out.append(f"\n\n{tabular(spec, body[i:])}\n\n")
        elif name in ("itemize", "enumerate", "description"):
            n, text = 0, []
            for item in _items(body):
                n += 1
                label, i = _group(item, 0, "[", "]") if item.lstrip().startswith("[") else ("", 0)
                inner = _environments(item[i:]).strip()
                text.append((f"{n}. " if name == "enumerate" else "- ") + (f"**{inline(label)}** " if label else "") + inner)
            out.append("\n\n" + "\n".join(text) + "\n\n")
        elif name == "abstract":
            out.append(f"\n\n## Abstract\n\n{_environments(body).strip()}\n\n")
        elif name in ("table", "table*", "figure", "figure*"):
            caption = re.search(r"\\caption\s*(?=[{\[])", body)
            title = ""
            if caption:
                i = caption.end()
                _, i = _group(body, i, "[", "]") if body[i] == "[" else ("", i)
                title, i = _group(body, i)
                body = body[: caption.start()] + body[i:]
            body = re.sub(r"^\s*\[[^\]]*\]", "", body)
            out.append((f"\n\n**{inline(title).strip()}**\n\n" if title else "\n\n") + _environments(body).strip() + "\n\n")
        else:
            out.append(_environments(body))
    return "".join([*out, inline(s[at:])])


def tex_to_markdown(tex: str) -> str:
    body = without_definitions(document_body(without_comments(tex)))
    text = _environments(body)
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_SUPER = {c: unicodedata.lookup(f"SUPERSCRIPT {n}") for c, n in zip("0123456789+-=()n", "ZERO,ONE,TWO,THREE,FOUR,FIVE,SIX,SEVEN,EIGHT,NINE,PLUS SIGN,MINUS,EQUALS SIGN,LEFT PARENTHESIS,RIGHT PARENTHESIS,LATIN SMALL LETTER N".split(","), strict=True)}
_SUPER["i"] = "ⁱ"
_SUB = {c: unicodedata.lookup(f"SUBSCRIPT {n}") for c, n in zip("0123456789+-=()", "ZERO,ONE,TWO,THREE,FOUR,FIVE,SIX,SEVEN,EIGHT,NINE,PLUS SIGN,MINUS,EQUALS SIGN,LEFT PARENTHESIS,RIGHT PARENTHESIS".split(","), strict=True)}
_SUB |= {c: unicodedata.lookup(f"LATIN SUBSCRIPT SMALL LETTER {c.upper()}") for c in "aehijklmnoprstuvx"}
_STYLES = {"mathbf": "BOLD", "mathbb": "DOUBLE-STRUCK", "mathcal": "SCRIPT", "mathfrak": "FRAKTUR"}


def _styled(style: str, c: str) -> str | None:
    kind = "CAPITAL" if c.isupper() else "SMALL"
    for name in (f"MATHEMATICAL {style} {kind} {c.upper()}", f"{style} {kind} {c.upper()}", f"MATHEMATICAL {style} DIGIT {unicodedata.name(c, '').rpartition(' ')[2]}"):
        try:
            return unicodedata.lookup(name)
        except KeyError:
            continue
    return None


def _formula(s: str) -> str | None:
    """A formula in Unicode, or None if some part of it has no such form."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c in "^_":
            group, i = _group(s, i + 1)
            inner = _formula(group)
            table = _SUPER if c == "^" else _SUB
            if inner is None or any(x not in table for x in inner):
                return None
            out.append("".join(table[x] for x in inner))
        elif c == "\\":
            m = re.match(r"\\([A-Za-z]+)", s[i:])
            if not m:
                out.append({",": " ", ";": " ", " ": " ", "{": "{", "}": "}", "%": "%", "!": ""}.get(s[i + 1 : i + 2]) or "")
                i += 2
                continue
            name, i = m[1], i + m.end()
            if name in _STYLES:
                group, i = _group(s, i)
                styled = [_styled(_STYLES[name], x) if x.isalnum() else x for x in group]
                if None in styled:
                    return None
                out.append("".join(styled))
            elif name in ("text", "mathrm", "operatorname"):
                group, i = _group(s, i)
                out.append(group)
            elif name == "sqrt":
                group, i = _group(s, i)
                inner = _formula(group)
                if inner is None:
                    return None
                out.append("√" + (inner if len(inner) == 1 else f"({inner})"))
            elif name == "tilde":
                group, i = _group(s, i)
                out.append(unicodedata.normalize("NFC", group + "̃"))
            elif name in SYMBOLS:
                out.append(FORMULA_SYMBOLS.get(name, SYMBOLS[name]))
            else:
                return None
        elif c in "{}":
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


_SPAN = re.compile(r"\$\$(.+?)\$\$|(?<![\\$])\$([^$\n぀-鿿]+)\$", re.S)


def latex_to_unicode(s: str) -> str:
    """Formulas that can be written in Unicode as a whole are; others stay."""

    def put(m: re.Match) -> str:
        new = _formula((m[1] or m[2]).strip())
        return m[0] if new is None else new

    return _SPAN.sub(put, s)


@F.pandas_udf(StringType())
def tex_to_markdown_udf(tex: pd.Series) -> pd.Series:
    return tex.map(tex_to_markdown, na_action="ignore")


@F.pandas_udf(StringType())
def latex_to_unicode_udf(s: pd.Series) -> pd.Series:
    return s.map(latex_to_unicode, na_action="ignore")
