import hashlib
import random
import re
import string

from feedloom.llm import queries
from feedloom.llm.secrets import Model, fit, pattern_spans, secrets, train

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = ["assign", "access", "hex"]
    return sorted([(m.start(), rank.index(k), m.end(), k) for k, m in out])


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, _, e, k in spans).encode()).hexdigest()


def test_testdata_equals_brute_force(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_secret_scans(spark, at).collect()}
    hits = 0
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        want, own = brute(r.text or ""), got[r.doc_id]
        hits += len(want)
        assert own.base_sha256 == digest(want)
        assert [own.n_assign, own.n_access, own.n_hex] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in own.spans.split(",") if s and not s.startswith("markov")] == [f"{k}:{b}:{e}" for b, _, e, k in want]
    assert hits > 10


def test_patterns_by_hand():
    cases = [
        "Password = 'abc12' token:abcdef",
        "API_KEY:\"x.y=z-/_+\" apikey=a passwd  :  éé123456",
        "toKen=abcdefg AKIAAKIA" + "A" * 12 + " AKIA0",
        "f" * 23 + "g" + "0" * 24 + "secret=" + "a" * 30,
        "\U0001f600 secret:\U0001f600 secret:123456",
        "tokentoken=tokens=abcdef",
        "",
    ]
    for text in cases:
        assert [(b, e) for b, e, _ in pattern_spans(text)] == [(b, e) for b, _, e, _ in brute(text)], text


def sample(seed):
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    parts = ["user", "name", "count", "index", "load", "file", "from", "value", "request", "handler", "config", "test"]
    return (
        ["".join(r.choice(letters) for _ in range(r.randrange(20, 50))) for _ in range(400)],
        ["_".join(r.choice(parts) for _ in range(r.randrange(4, 7))) for _ in range(2000)],
    )


def test_random_strings_are_told_from_identifiers():
    model = fit(*sample(1))
    keys, names = sample(2)
    assert sum(model.score(x) > model.threshold for x in keys) > 0.95 * len(keys)
    assert sum(model.score(x) > model.threshold for x in names) < 0.01 * len(names)


def test_spans_are_added_and_odd_rows_are_kept(spark):
    keys, names = sample(3)
    rows = [(i, f"{names[i]} secret={keys[i]} and {names[i + 500]}", "x") for i in range(300)]
    rows += [(900, f"see {keys[350]} there", "y"), (901, None, None), (902, "", "z"), (902, "", "z"), (None, "a" * 300_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.spans] for r in secrets(docs, train(docs)).collect()}
    assert got[900] == [("markov", 4, 4 + len(keys[350]))]
    assert got[901] == got[902] == []
    assert len(got) == 304
    assert secrets(docs.limit(0), train(docs.limit(0))).collect() == []
    assert fit([], []).threshold == float("inf")
    assert isinstance(fit(["a"], ["b"]), Model)
