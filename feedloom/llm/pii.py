"""Personal data replaced by format-preserving pseudonyms, with native Spark expressions only.

One pattern finds candidates, in which the account numbers that a text holds stand by name, so a
longer run around them hides neither them nor what follows; a candidate counts when it validates: card numbers by their Luhn
digit, account numbers (IBAN) modulo 97, addresses (IPv4) by their octets, dates by the calendar,
phone numbers by their digits, mail addresses by their form. Its symbols are then permuted by a
keyed Feistel network within the same format: separators, lengths, country codes and mail domains
stay, check digits are made anew, and dates stay dates. The permutation depends on the key, the
kind and the value alone, so equal values stay equal in all documents and different ones stay
different; :func:`restored` undoes it with the key.

The round function is SHA-256 over key, kind, round and half, so pseudonyms tell nothing without
the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_JUNK = r"[-. #$%&*!]{0,5}"
#: Candidates by kind, in the order in which they are tried at a place. The labels of a mail domain
#: give back where the last one is no top-level name, as before a full stop (a name has 127 at most).
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}|(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": rf"(?<![\d+])(?:\+\d{{1,3}}{_JUNK}\(?\d{{2,4}}\)?{_JUNK}\d{{3,4}}{_JUNK}\d{{3,4}}|\(\d{{3}}\){_JUNK}\d{{3}}{_JUNK}\d{{4}}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}})(?!\d)",
}
CANDIDATE = "|".join(KINDS.values())
#: The longest run that may begin with an account number, at every place where one may begin.
_ACCOUNT_RUN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])))"
#: Symbols of an account number by country.
_ACCOUNT_SIZE = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
        "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SPAN = (("1900-01-01", 73_049, 271, 270), ("0001-01-01", 3_652_059, 1912, 1911))


def _whole(kind: str) -> str:
    return f"^(?:{KINDS[kind]})$"


def _long(c: Column) -> Column:
    return c.cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _feistel(a: Column, b: Column, mu: Column, mv: Column, key: str, tweak: Column, back: bool) -> Column:
    """``struct<a, b>`` with 0 <= a < mu and 0 <= b < mv, permuted (or restored)."""

    def step(acc: Column, i: Column) -> Column:
        m = F.when(i % 2 == 0, mu).otherwise(mv)
        seen = acc["a"] if back else acc["b"]
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), seen.cast("string")), 256)
        f = _long(F.conv(F.substring(digest, 1, 15), 16, 10)) % m
        if back:
            return F.struct(F.pmod(acc["b"] - f, m).alias("a"), acc["a"].alias("b"))
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + f, m).alias("b"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.alias("a"), b.alias("b")), step)


def _symbols(s: Column, radix: int, block: int, key: str, kind: str, back: bool) -> Column:
    """A string of symbols of the radix, permuted in blocks; its length stays."""

    def part(all_: Column, j: Column) -> Column:
        return _let(F.substring(all_, j * block + 1, F.lit(block)), lambda x: _let(F.length(x), lambda n: permuted(x, n, j)))

    def permuted(x: Column, n: Column, j: Column) -> Column:
        u = F.floor(n / 2).cast("int")
        v = n - u
        number = lambda t: F.coalesce(_long(F.conv(F.when(t != "", t), radix, 10)), F.lit(0).cast("long"))
        size = lambda k: _long(F.pow(F.lit(float(radix)), k))
        tweak = F.concat_ws(":", F.lit(kind), n.cast("string"), j.cast("string"))
        two = _feistel(number(F.substring(x, F.lit(1), u)), number(F.substring(x, u + 1, v)), size(u), size(v), key, tweak, back)
        text = lambda c, k: F.lpad(F.lower(F.conv(c.cast("string"), 10, radix)), k, F.lit("0"))
        return _let(two, lambda t: F.concat(text(t["a"], u), text(t["b"], v)))

    def blocks(all_: Column) -> Column:
        last = F.floor((F.length(all_) - 1) / block).cast("int")
        joined = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda j: part(all_, j)), "")
        return F.when(all_ == "", all_).otherwise(joined)

    return _let(s, blocks)


def _filled(old: Column, symbol: str, new: Column) -> Column:
    """``old`` with the matches of ``symbol`` replaced, in order, by the characters of ``new``."""
    gaps = F.split(old, symbol, -1)
    return _let(new, lambda n: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(n, i + 1, F.lit(1)))), ""))


def _bare(s: Column, kept: str = "0-9") -> Column:
    return F.regexp_replace(s, f"[^{kept}]", "")


def _digit(s: Column, i: Column) -> Column:
    return F.ascii(F.substring(s, i, F.lit(1))) - 48


def _luhn(digits: Column, first_doubled: int) -> Column:
    """The Luhn sum, doubling every second digit from the right; the last is doubled if 1."""
    def of(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = _digit(s, F.length(s) - i)
            return acc + F.when(i % 2 == 1 - first_doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0), add)

    return _let(digits, of)


def _mod97(s: Column) -> Column:
    """An account number's remainder, letters counting from 10."""

    def of(t: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substring(t, i, F.lit(1)))
            return F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), add)

    return _let(s, of)


def _accounts(text: Column) -> Column:
    """The account numbers of a text: of every run that may begin with one, the part that validates.

    Of the parts that end at a group's border, the one of the country's length, else the longest.
    """
    sizes = F.create_map(*[F.lit(x) for pair in _ACCOUNT_SIZE.items() for x in pair])

    def valid(part: Column) -> Column:
        bare = _bare(part, "A-Z0-9")
        moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
        return F.length(bare).between(15, 34) & (_mod97(moved) == 1)

    def account(run: Column) -> Column:
        groups = F.split(run, " ")
        parts = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), " "))
        known = F.try_element_at(sizes, F.substring(run, 1, 2))
        fits = lambda all_: F.filter(all_, lambda p: F.length(_bare(p, "A-Z0-9")) == known)
        return _let(F.filter(parts, valid), lambda all_: F.coalesce(F.get(fits(all_), F.lit(0)), F.get(all_, F.lit(0))))

    found = F.transform(F.regexp_extract_all(text, F.lit(_ACCOUNT_RUN), F.lit(1)), account)
    return F.array_distinct(F.filter(found, lambda a: a.isNotNull()))


def _pattern(text: Column) -> Column:
    """What is replaced in a text: accounts by name, as a run that fails must not hide what follows."""
    mail = KINDS["email"]
    rest = "|".join(p for kind, p in KINDS.items() if kind not in ("email", "iban"))

    def named(accounts: Column) -> Column:
        longest = F.reverse(F.array_sort(F.transform(accounts, lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))))
        either = F.array_join(F.transform(longest, lambda a: a["a"]), "|")
        own = F.concat(F.lit(f"{mail}|(?<![A-Za-z0-9])(?:"), either, F.lit(f")(?![A-Za-z0-9])|{rest}"))
        return F.when(F.size(accounts) > 0, own).otherwise(F.lit(f"{mail}|{rest}"))

    some = F.when(text.rlike(_ACCOUNT_RUN), _let(_accounts(text), named))
    return F.coalesce(some, F.lit(f"{mail}|{rest}"))


def _email(m: Column, key: str, back: bool) -> Column:
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.substring_index(m, "@", -1)
    new = _symbols(_bare(local, "a-z0-9"), 36, 10, key, "email", back)
    return F.concat(_filled(local, "[a-z0-9]", new), F.lit("@"), domain)


def _iban(m: Column, key: str, back: bool) -> Column:
    bare = _bare(m, "A-Z0-9")
    country, rest = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    new = _filled(rest, "[0-9]", _symbols(_bare(rest), 10, 18, key, "iban", back))
    check = lambda n: F.lpad((F.lit(98) - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(rest, F.substring(bare, 1, 4))) == 1
    return F.when(valid, _let(new, lambda n: _filled(m, "[A-Z0-9]", F.concat(country, check(n), n))))


def _ip(m: Column, key: str, back: bool) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    half = lambda i: _long(part[i] * 256 + part[i + 1])
    m16 = F.lit(65_536).cast("long")
    two = _feistel(half(0), half(2), m16, m16, key, F.lit("ip"), back)

    def shown(t: Column) -> Column:
        octets = [F.floor(t[h] / 256).cast("long") if k == 0 else t[h] % 256 for h in "ab" for k in (0, 1)]
        return F.concat_ws(".", *[o.cast("string") for o in octets])

    return F.when(~F.exists(part, lambda x: x > 255), _let(two, shown))


def _date(m: Column, key: str, back: bool) -> Column:
    def moved(day: Column) -> Column:
        def one(start: str, size: int, mu: int, mv: int) -> Column:
            at = _long(F.datediff(day, F.lit(start).cast("date")))

            def walk(acc: Column, i: Column) -> Column:
                two = _feistel(F.floor(acc / mv).cast("long"), acc % mv, _long(F.lit(mu)), _long(F.lit(mv)), key, F.lit(f"date{size}"), back)
                return F.when((i == 0) | (acc >= size), _let(two, lambda t: t["a"] * mv + t["b"])).otherwise(acc)

            return F.date_add(F.lit(start).cast("date"), F.aggregate(F.sequence(F.lit(0), F.lit(9)), at, walk).cast("int"))

        near, far = (one(*s) for s in _SPAN)
        return F.when((F.year(day) >= 1900) & (F.year(day) < 2100), near).otherwise(far)

    mark = F.substring(m, 3, 1)
    split = F.regexp_replace(m, "[./]", "-")
    iso = F.try_to_date(m, "yyyy-MM-dd")
    european, american = F.try_to_date(split, "dd-MM-yyyy"), F.try_to_date(split, "MM-dd-yyyy")

    def shown(new: Column) -> Column:
        other = F.when(european.isNotNull(), F.date_format(new, "dd-MM-yyyy")).otherwise(F.date_format(new, "MM-dd-yyyy"))
        return F.when(m.rlike(r"^\d{4}"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.regexp_replace(other, F.lit("-"), mark))

    day = F.when(m.rlike(r"^\d{4}"), iso).otherwise(F.coalesce(european, american))
    return _let(_let(day, moved), shown)


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _bare(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _symbols(body, 10, 18, key, "card", back)
    check = lambda n: ((F.lit(10) - _luhn(n, 1) % 10) % 10).cast("string")
    return F.when(_luhn(digits, 0) % 10 == 0, _let(new, lambda n: _filled(m, "[0-9]", F.concat(n, check(n)))))


def _phone(m: Column, key: str, back: bool) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=\D)|^\+\d", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    new = _symbols(_bare(rest), 10, 18, key, "phone", back)
    return F.when(F.length(_bare(m)).between(7, 15), F.concat(country, _filled(rest, "[0-9]", new)))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "card": _card, "phone": _phone}


def _replaced(text: Column, key: str, back: bool) -> Column:
    def value(m: Column) -> Column:
        new = F.lit(None).cast("string")
        for kind in reversed(KINDS):
            new = F.when(m.rlike(_whole(kind)), _MAKERS[kind](m, key, back)).otherwise(new)
        return F.coalesce(new, m)

    def joined(pattern: Column) -> Column:
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        between = F.split(text, pattern, -1)
        return F.array_join(F.zip_with(between, F.transform(found, value), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    whole = _let(_pattern(text), joined)
    return F.when(text.rlike("[0-9@]"), whole).otherwise(text)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; other columns and rows stay as they are.

    Null and empty texts stay, repeated rows are replaced alike, an empty table stays empty.
    Candidates that don't validate are left alone. Mail names come out in lower case.
    """
    return docs.withColumn("text", _replaced(F.col("text"), key, back=False))


def restored(docs: DataFrame, key: str) -> DataFrame:
    """Undo :func:`pseudonymised` with the same key (mail names in lower case).

    A date written month first may come out as one that also reads day first, and is then read so.
    """
    return docs.withColumn("text", _replaced(F.col("text"), key, back=True))
