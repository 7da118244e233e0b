import pytest
from pyspark.sql import functions as F

from feedloom.functions import calendar, fit, html, ids, json, state, tex, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


TRUTH = {0: [0, 3, 1, 2, -1], 3: [3, 0, 1, 2, -1], 1: [1, 1, 0, 2, -1], 2: [2, 2, 2, 0, -1], -1: [-1, -1, -1, 2, 0]}


def test_status_truth_table(spark):
    rows = spark.createDataFrame([(o, n) for o in TRUTH for n in (0, 3, 1, 2, -1)], "o int, n int")
    got = rows.select("o", "n", state.merged_status(F.col("o"), F.col("n")).alias("m")).collect()
    for r in got:
        assert r.m == TRUTH[r.o][[0, 3, 1, 2, -1].index(r.n)]


@pytest.mark.parametrize(
    ("given", "url", "id_"),
    [
        ("arXiv:2301.00001v2", "https://arxiv.org/abs/2301.00001v2", "2301.00001v2"),
        (" 2301.00001 ", "https://arxiv.org/abs/2301.00001", "2301.00001"),
        ("2301.00001.pdf", "https://arxiv.org/abs/2301.00001", "2301.00001"),
        ("https://arxiv.org/pdf/2301.00001v1.pdf", "https://arxiv.org/abs/2301.00001v1", "2301.00001v1"),
        ("http://export.arxiv.org/html/hep-th/9901001?x#y", "https://arxiv.org/abs/hep-th/9901001", "hep-th/9901001"),
        ("https://arxiv.org/e-print/2301.00001/", "https://arxiv.org/abs/2301.00001", "2301.00001"),
        ("https://example.com/abs/2301.00001", "", ""),
        ("arxiv.org/abs/2301.00001", "", ""),
        ("", "", ""),
    ],
)
def test_normalized_arxiv(spark, given, url, id_):
    assert tuple(one(spark, ids.normalized_arxiv(F.col("s")), s=given)) == (url, id_, bool(id_))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("see https://github.com/a/b.git !", "https://github.com/a/b"),
        ("github.com/x/y and https://github.com/a/b/tree/main", "https://github.com/a/b"),
        ("(github.com/x/y.z),", "https://github.com/x/y.z"),
        ("mygithub.com/x/y", ""),
        ("none", ""),
    ],
)
def test_github_url(spark, given, want):
    assert one(spark, ids.github_url(F.col("s")), s=given) == want


def test_ids_and_references(spark):
    assert one(spark, ids.arxiv_id(F.col("s")), s="x/abs/2606.12495v1 y") == "2606.12495"
    assert one(spark, ids.id_of_abs_url(F.col("s")), s="https://arxiv.org/abs/2606.12495v1") == "2606.12495v1"
    assert one(spark, ids.id_of_abs_url(F.col("s")), s="https://export.arxiv.org/abs/2606.12495") == ""
    split = lambda s: tuple(one(spark, ids.split_references(F.col("s")), s=s))
    assert split("Body\n\n## References\n[1] x") == ("Body", "## References\n[1] x")
    assert split("A \\begin{thebibliography}{9} B\n# References") == ("A", "\\begin{thebibliography}{9} B\n# References")
    assert split("no list") == ("no list", "")
    page = ids.id_of_page(F.col("p"), F.col("c"), F.col("l"))
    assert one(spark, page, p="/abs/2301.00001v3", c="", l="") == "2301.00001v3"
    assert one(spark, page, p="/list", c="", l="https://arxiv.org/abs/2301.00002") == "2301.00002"
    assert one(spark, ids.feed_description(F.col("s")), s="arXiv:1 Announce Type: new\nAbstract: Some text ") == ("Some text", "new")
    assert one(spark, ids.author_of_description(F.col("s")), s="Authors: A, B\nx") == "A, B"


def test_text_functions(spark):
    s = lambda f, v, *a: one(spark, f(F.col("s"), *a), s=v)
    assert s(text.clean_text, " <p>a &amp;lt; b&nbsp;</p>\n") == "a &lt; b"
    assert s(text.truncated, "日本語テキスト", 3) == "日本語..."
    assert s(text.truncated_bytes, "日本", 4) == "日..."
    assert s(text.escaped_yaml, 'a"b\\') == 'a\\"b\\\\'
    assert s(text.short_authors, "A, B, C, D, E, F") == "A, B, C, E, F, et. al."
    assert s(text.short_authors, "A, B") == "A, B"
    assert s(text.without_mentions, "@_user_1 hi") == "hi"
    assert s(text.masked, "abcdefghijkl") == "abcd••••ijkl"
    assert s(text.masked, "abc") == "••••"
    assert s(text.masked, "") == ""
    assert s(text.split_urls, "see https://a.b/c, and http://x.y。z") == ["https://a.b/c", "http://x.y"]
    assert s(text.split_latex, "a $x$ b $$y z$$ \\[w\\]") == ["$x$", "$$y z$$", "\\[w\\]"]
    assert s(text.has_markdown, "**b**") is True
    assert s(text.is_network_error, "read: connection reset") is True
    assert one(spark, text.paper_ref(F.col("a"), F.col("b")), a="", b=7) == "7"
    assert s(text.session_id, "7")[14] == "4"


def test_html_to_markdown(spark):
    page = """<html><head><title>T &amp; U</title><style>p{}</style><script>var x="<p>"</script></head><body>
    <h2>Head</h2><p>a &#233; &amp;lt; <math alttext="q"><semantics><annotation encoding="application/x-tex">x^2</annotation></semantics></math></p>
    <math display="block"><annotation encoding="application/x-tex">y</annotation></math>
    <table><caption>Cap</caption><tr><th>A</th><th align="right">B</th></tr><tr><td>1 | 2</td></tr></table><br/>end</body></html>"""
    got = one(spark, html.html_to_markdown(F.col("s")), s=page)
    assert got.startswith("# T & U\n\n")
    assert "## Head" in got
    assert "a é &lt; $x^2$" in got
    assert "\n$$\ny\n$$\n" in got
    assert "**Cap**\n\n| A | B |\n| --- | ---: |\n| 1 \\| 2 |  |" in got
    assert got.endswith("end")
    assert "var x" not in got
    assert one(spark, html.html_to_markdown(F.col("s")), s="") == ""
    assert one(spark, html.decoded(F.col("s")), s="&#8364;&#128512;&#65;&#55296;") == "€😀A�"


def test_tex_to_markdown():
    source = r"""\documentclass{x}\newcommand{\foo}[1]{bar #1}\def\x#1{y}
\begin{document}\section{Intro \emph{x}} Hello % comment
world \'e \"{u} \c{c} \infty \in \leq 50\%
\begin{table}[h]\caption{Cap}\begin{tabular}{l*{2}{c}r}a & b \\ \hline \multicolumn{2}{c}{x} & {1 & 2}\end{tabular}\end{table}
\begin{equation}a=b\label{q}\end{equation}
\begin{enumerate}\item one \item two \begin{itemize}\item in\end{itemize}\end{enumerate}
\iffalse hidden \fi\begin{verbatim}\raw{x}\end{verbatim}\end{document} after"""
    got = tex.tex_to_markdown(source)
    for part in ("## Intro *x*", "Hello world é ü ç ∞∈≤50%", "**Cap**\n\n| a | b |  |  |", "| --- | :---: | :---: | ---: |", "$$a=b$$", "1. one\n2. two", "- in", "```\n\\raw{x}\n```"):
        assert part in got
    assert "after" not in got
    assert "hidden" not in got
    assert "foo" not in got


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (r"$x^2_i$", "x²ᵢ"),
        (r"$\mathbb{R}^{n}$", "ℝⁿ"),
        (r"$\frac{a}{b}$", r"$\frac{a}{b}$"),
        (r"$\alpha \leq \infty$", "α ≤ ∞"),
        (r"$\subseteq\simeq\lambda$", "⊆≃λ"),
        (r"$\sqrt{ab}$ and $5", "√(ab) and $5"),
        (r"$中$", r"$中$"),
        (r"$\varphi \gets \log n$", "ϕ ← log n"),
        (r"$\argmax_i x \triangleq \vdots$", "argmaxᵢ x ≜ ⋮"),
    ],
)
def test_latex_to_unicode(given, want):
    assert tex.latex_to_unicode(given) == want


def test_chunks_concatenate_and_keep_blocks_whole():
    table = "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 10
    fence = "```\n" + "code\n" * 10 + "```\n"
    source = "text line é\n" * 20 + table + "more\n" + fence + "日本語" * 50
    for most in (50, 130, 200, 10_000):
        chunks = fit.split_bytes(source, most)
        assert "".join(chunks) == source
        assert all(len(c.encode()) <= most for c in chunks)
    chunks = fit.split_bytes(source, 150)
    assert sum(table in c for c in chunks) == sum(fence in c for c in chunks) == 1
    assert fit.split_bytes("", 10) == [""]


def test_fit_counts(spark):
    s = "a\nb\n\n| x |\n| - |\n\n| y |\nend"
    assert one(spark, fit.count_tables(F.col("s")), s=s) == 2
    assert one(spark, fit.without_tables(F.col("s")), s=s) == "a\nb\n\nend"
    assert one(spark, fit.normalized_quotes(F.col("s")), s="> q\ntext") == "> q\n\ntext"
    assert one(spark, fit.card_fits(F.col("s")), s="x" * 30_000) is False
    assert one(spark, fit.page_fallback(F.col("s")), s="x" * 30_000) == "x" * 500 + "..."


def test_scores_and_replies(spark):
    parsed = lambda s: one(spark, json.parsed_scores(F.col("s")), s=s)
    assert parsed('```json\n[{"id":"a","score":3},{"id":"","score":1},{"id":"b","score":-0.5},{"id":"a","score":-7}]\n```') == [("b", -0.5), ("a", -1.0)]
    assert parsed("no json") is None
    assert one(spark, json.json_object(F.col("s")), s='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, json.tool_argument(F.col("s"), "q"), s='{"q": "z"}') == "z"


def test_calendar(spark):
    assert one(spark, calendar.fetch_slots(F.col("s")), s="00:15") == ["23:15", "07:15", "15:15"]
    assert one(spark, calendar.fetch_slots(F.col("s")), s="24:00") is None
    run = calendar.next_run(F.col("n").cast("timestamp"), F.col("s")).cast("string")
    assert one(spark, run, n="2024-01-01 09:00:00", s="09:00") == "2024-01-02 09:00:00"
    assert one(spark, run, n="2024-01-01 08:59:59", s="09:00") == "2024-01-01 09:00:00"
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-06",), ("2024-01-08",)], "d string").select(F.to_date("d").alias("day"))
    first = days.where("day = '2024-01-01'").withColumn("is_holiday", F.lit(True)).withColumn("name", F.lit("New Year"))
    second = days.where("day <> '2024-01-06'").withColumn("is_holiday", F.lit(False)).withColumn("name", F.lit(None).cast("string"))
    got = {str(r.day): (r.is_holiday, r.name, r.source) for r in calendar.holidays(days, [("one", first), ("two", second)]).collect()}
    assert got == {"2024-01-01": (True, "New Year", "one"), "2024-01-06": (True, "", "weekend"), "2024-01-08": (False, "", "two")}


def test_entities_are_decoded_once(spark):
    assert one(spark, html.decoded(F.col("s")), s="&#38;lt; &amp;lt; &amp;amp; &lt;b&gt; &#x27;") == "&lt; &lt; &amp; <b> '"


def test_elements_are_lines_and_quarters_of_table_cells(spark):
    text = "# a\n\ntext\nmore\n| a | b | c | d |\n```\n| x | y | z | w |\n\n```\n|"
    assert one(spark, fit.count_elements(F.col("s")), s=text) == 3 + 2 + 3 + 1


def test_text_symbols():
    assert tex.tex_to_markdown(r"\begin{document}a \textless{} b, \varphi{} and \log x\end{document}").replace("{}", "").split() == "a < b, φ and log x".split()


def _brute_fit(s, most, elements, tables):
    """The longest prefix that fits, brought back to the last place where a card may end."""

    def fits(x):
        n = t = 0
        code = before = False
        for line in x.split("\n"):
            own = line.strip(" \t\n\x0b\x0c\r")
            bar = len(own) > 1 and own[0] == "|" and own[-1] == "|"
            n += 0 if not own else (own.count("|") - 1) // 4 + 1 if bar and not code else 1
            code ^= own.startswith("```")
            t += bar and not before
            before = bar
        return len(x.encode()) <= most and n <= elements and t <= tables

    if fits(s):
        return s
    lo = max(i for i in range(len(s) + 1) if fits(s[:i]) and all(fits(s[:j]) for j in range(i)))
    code = table = math = False
    at = best = last = 0
    for line in s[:lo].split("\n")[:-1]:
        at += len(line) + 1
        own = line.strip(" \t\n\x0b\x0c\r")
        code ^= own.startswith("```")
        table = len(own) > 1 and own[0] == "|" and own[-1] == "|"
        if not code and own.count("$") % 2:
            math = not math
        if not (code or table or math):
            last = at
            best = at if not own else best
    return s[: best or last] or None


def test_fitted_parts_end_where_cards_may(spark):
    import random

    r = random.Random(5)
    kinds = ["", "  ", "text é", "| a | b |", "```", "x $y", "$z", "漢字" * 9, "w" * 40]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randrange(1, 14))) for _ in range(150)] + ["", "é" * 70, "|" * 400 + "|", "a\nb"]
    limits = (100, 6, 2)
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", fit.fitted(F.col("s"), *limits).alias("x")).collect()
    for row in rows:
        part, rest = row.x
        want = _brute_fit(row.s, *limits)
        if part == fit.TOO_LONG:
            assert rest == row.s
            continue
        assert part + rest == row.s
        assert len(part.encode()) <= limits[0]
        if want is not None:
            assert part == want
    assert sum(1 for row in rows if row.x.rest) > 60
    assert spark.range(1).select(fit.fitted(F.lit(None).cast("string")).alias("x")).first().x is None


def test_formulas_of_math_elements(spark):
    math = lambda tex, more="": f'a<math{more}><mi>x</mi><annotation encoding="application/x-tex">{tex}</annotation></math>b'
    texts = [math(" x^2 "), math("y", ' display="block"'), math(" \n z ", " display=block"), math("  "), math("", ' display="block"'), math("block", ' alttext="d"'), "a<math><mi>x</mi></math>b", math("u") + math("v")]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(html.math_to_latex(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["a$x^2$b", "a\n$$\ny\n$$\nb", "a\n$$\nz\n$$\nb", "ab", "ab", "a$block$b", "a<math><mi>x</mi></math>b", "a$u$ba$v$b"]
