"""Pseudonyms that keep their format, by a keyed Feistel network in DataFrame functions alone.

Found and validated: card numbers (13 to 19 digits with a right check digit), North American telephone numbers (area
and exchange from 200; after +1 any), other numbers after a plus, social security numbers, IBANs (right check digits), IPv4 addresses, dates from 1899-12-30
to 2099-12-31 (year first, or year last with dots or slashes), and e-mail addresses. What doesn't validate stays as it is.

Each kind's valid values are numbered as pairs (l, r) below (a, b), and a Feistel network with sums modulo a and b
permutes the pairs; so a card number becomes a valid card number, a date a valid date, in the same layout, two such values
never become one (two e-mail addresses may, by equal hashes), and equal values stay equal in all documents under one key. Layouts of one number (with
dashes or blanks) give one number. The digits of an e-mail's local part and its letters are replaced by those of
a keyed hash, one for one; its domain stays.

A text is cut at all finds by one pattern, the finds are replaced one by one, and the parts are joined again. Nothing is
shuffled, so a hot source or value has no effect. The key is a literal of the plan: who can read the application's plans or event
log can read it.

Nulls and edges: a null text stays null, with no finds; an empty one stays empty; extra columns stay, but
for one named n_found, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1899-12-30 to 2099-12-31: 319 * 229.
DAYS = (319, 229)
WALK = 60

# The patterns of the kinds. A find stands alone: no letter, digit or sign of a longer number beside it.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
#: With the country's code a number is one even if no such area or exchange is assigned.
PLUS_ONE = r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
ABROAD = r"\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,5}"
DATE = r"(?:18|19|20)\d{2}([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:18|19|20)\d{2}|(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|[12]\d|3[01])/(?:18|19|20)\d{2}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
CARD = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"
#: Countries by the length of their IBANs; capitals that follow don't belong to one. Other lengths and codes are found as far as they reach.
LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN = r"(?=[A-Z]{2}\d)(?:" + "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items()) + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
LEFT, RIGHT = r"(?<![A-Za-z0-9_.+@-])", r"(?![A-Za-z0-9_@]|[.-]\d)"
#: In order of preference where two begin at one place.
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "phone": PHONE, "plus_one": PLUS_ONE, "ssn": SSN, "ip": IPV4, "card": CARD, "abroad": ABROAD}
ANY = LEFT + "(?:" + "|".join(p.replace(r"([-/])", r"[-/]").replace(r"\1", r"[-/]") for p in KINDS.values()) + ")" + RIGHT


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _long(x: Column) -> Column:
    return F.when(x == "", F.lit(0)).otherwise(x).cast("long")


def _hash(key: str, kind: Column, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def _luhn(payload: Column) -> Column:
    """The check digit after these digits."""
    n = F.length(payload)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    return ((10 - total % 10) % 10).cast("string")


def _mod97(x: Column) -> Column:
    """The rest by 97 of the number that letters and digits spell, A being 10."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    each = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))
    return F.aggregate(F.transform(each, code), F.lit(0), lambda s, d: (s * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def feistel(key: str, kind: Column, l: Column, r: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (l, r), 0 <= l < a and 0 <= r < b."""
    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def one(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(_hash(key, kind, s["a"], s["b"], k, s["r"]), s["a"]), s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, one)


def _numbered(key: str, kind: Column, digits: Column) -> Column:
    """A permutation of all strings of as many digits."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    p = feistel(key, kind, _long(F.substring(digits, F.lit(1), half)), _long(F.substring(digits, half + 1, rest)), ten(half), ten(rest))
    return _let(p, lambda p: F.concat(F.when(half == 0, "").otherwise(_pad(p["l"], half)), _pad(p["r"], rest)))


def _laid_out(find: Column, digits: Column) -> Column:
    """find with its digits replaced one by one."""
    each = F.transform(F.sequence(F.lit(1), F.length(find)), lambda i: F.substring(find, i, F.lit(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(s: Column, c: Column) -> Column:
        isdigit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(isdigit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + isdigit.cast("int")).alias("at"))

    return F.aggregate(each, start, one)["out"]


def _card(key: str, m: Column) -> Column:
    def go(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(_numbered(key, F.lit("card"), payload), lambda p: F.concat(p, _luhn(p)))
        valid = F.substring(d, -1, 1) == _luhn(payload)
        return F.when(valid & ~d.rlike("^0+$"), _laid_out(m, new)).otherwise(m)

    return _let(_digits(m), go)


def _phone(key: str, m: Column) -> Column:
    """Area and exchange codes begin with 2 to 9."""

    def go(d: Column) -> Column:
        ten = F.substring(d, -10, 10)
        p = feistel(key, F.lit("phone"), _long(F.substring(ten, 1, 3)) - 200, _long(F.substring(ten, 4, 7)) - 2_000_000, F.lit(800), F.lit(8_000_000))
        new = _let(p, lambda p: F.concat(F.when(F.length(d) == 11, "1").otherwise(""), (p["l"] + 200).cast("string"), (p["r"] + 2_000_000).cast("string")))
        return _laid_out(m, new)

    return _let(_digits(m), go)


def _plus_one(key: str, m: Column) -> Column:
    """Those of _phone as there; the others in two parts that are each permuted: areas below 200, and exchanges below 200 in the rest."""

    def go(d: Column) -> Column:
        area, rest = _long(F.substring(d, -10, 3)), _long(F.substring(d, -7, 7))
        low = area < 200
        p = feistel(key, F.lit("plus_one"), F.when(low, area).otherwise(area - 200), rest, F.when(low, 200).otherwise(800), F.when(low, 10_000_000).otherwise(2_000_000))
        new = _let(p, lambda p: _laid_out(m, F.concat(F.lit("1"), _pad(p["l"] + F.when(low, 0).otherwise(200), 3), _pad(p["r"], 7))))
        return F.when(low | (rest < 2_000_000), new).otherwise(_phone(key, m))

    return _let(_digits(m), go)


def _abroad(key: str, m: Column) -> Column:
    """The digits after the first two; E.164 allows 15."""
    return _let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _laid_out(m, F.concat(F.substring(d, 1, 2), _numbered(key, F.concat(F.lit("abroad"), F.substring(d, 1, 2)), F.substring(d, F.lit(3), F.length(d) - 2))))).otherwise(m))


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = _long(F.substring(m, 1, 3)), _long(F.substring(m, 5, 2)), _long(F.substring(m, 8, 4))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    new = _let(p, lambda p: F.concat_ws("-", _pad(p["l"] + F.when(p["l"] >= 665, 2).otherwise(1), 3), _pad(F.floor(p["r"] / 9999) + 1, 2), _pad(p["r"] % 9999 + 1, 4)))
    return F.when(valid, new).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    p = feistel(key, F.lit("ip"), F.get(parts, F.lit(0)) * 256 + F.get(parts, F.lit(1)), F.get(parts, F.lit(2)) * 256 + F.get(parts, F.lit(3)), F.lit(65536), F.lit(65536))
    four = lambda p: F.concat_ws(".", *(x.cast("string") for v in (p["l"], p["r"]) for x in (F.shiftright(v, 8), v % 256)))
    return F.when(F.forall(parts, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0\d"), _let(p, four)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """With slashes and the year last, a first number above 12 is a day and else a month; days above 12 are walked to days above 12, so that no two become one."""
    dotted, last = m.contains("."), m.rlike("^[0-9]{2}/")
    day_first = last & (F.substring(m, 1, 2) > "12")
    part = lambda *at: F.concat_ws("-", *(F.substring(m, i, n) for i, n in at))
    iso = F.when(dotted | day_first, part((7, 4), (4, 2), (1, 2))).when(last, part((7, 4), (1, 2), (4, 2))).otherwise(F.translate(m, "/", "-"))
    first = F.lit("1899-12-30").cast("date")

    def other(day: Column) -> Column:
        n = F.datediff(day, first)
        p = feistel(key, F.lit("date"), F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
        return F.date_add(first, _let(p, lambda p: (p["l"] * DAYS[1] + p["r"]).cast("int")))

    def go(day: Column) -> Column:
        # two days of five are low, so WALK steps without a high one don't happen
        steps = F.when(day_first, F.sequence(F.lit(1), F.lit(WALK))).otherwise(F.array(F.lit(1)))
        new = F.aggregate(steps, F.struct(day.alias("d"), F.lit(True).alias("go")), lambda s, _: F.when(s["go"], _let(other(s["d"]), lambda d: F.struct(d.alias("d"), (F.dayofmonth(d) <= 12).alias("go")))).otherwise(s))["d"]
        layout = F.when(dotted, "dd.MM.yyyy").when(day_first, "dd/MM/yyyy").when(last, "MM/dd/yyyy").when(m.contains("/"), "yyyy/MM/dd").otherwise("yyyy-MM-dd")
        return F.when(day.isNull() | ~F.datediff(day, first).between(0, DAYS[0] * DAYS[1] - 1), m).otherwise(F.call_function("date_format", new, layout))

    return _let(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), go)


def _iban(key: str, m: Column) -> Column:
    """The digits after the fourth place are permuted, then the check digits set anew."""

    def go(x: Column) -> Column:
        body = F.substring(x, F.lit(5), F.length(x) - 4)
        valid = _mod97(F.concat(body, F.substring(x, 1, 4))) == 1

        def with_check(b: Column) -> Column:
            return _let(98 - _mod97(F.concat(b, F.substring(x, 1, 2), F.lit("00"))), lambda c: F.concat(_pad(c, 2), _digits(b)))

        spelt = F.concat(F.substring(x, 1, 2), F.regexp_replace(body, "[0-9]", "9"))
        new = _let(_let(_digits(body), lambda d: _laid_out(body, F.when(d == "", d).otherwise(_numbered(key, F.concat(F.lit("iban"), spelt), d)))), with_check)
        return F.when(valid, _laid_out(m, new)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), go)


def _email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)

    def go(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(local)), lambda i: F.struct(F.substring(local, i, F.lit(1)).alias("c"), F.conv(F.substring(h, i % 60 + 1, F.lit(4)), 16, 10).cast("int").alias("n")))
        letter = lambda s: F.when(s["c"].rlike("[0-9]"), (s["n"] % 10).cast("string")).when(s["c"].rlike("[a-z]"), F.char(s["n"] % 26 + 97)).when(s["c"].rlike("[A-Z]"), F.char(s["n"] % 26 + 65)).otherwise(s["c"])
        return F.concat(F.array_join(F.transform(each, letter), ""), F.lit("@"), F.substring_index(m, "@", -1))

    return _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), go)


MAKERS = {"email": _email, "iban": _iban, "date": _date, "phone": _phone, "plus_one": _plus_one, "ssn": _ssn, "ip": _ip, "card": _card, "abroad": _abroad}


def pseudonym(find: Column, key: str) -> Column:
    """The pseudonym of a find, or the find itself where it doesn't validate."""
    out = F.when(F.lit(False), find)
    for kind, pattern in KINDS.items():
        out = out.when(find.rlike(f"^(?:{pattern})$"), MAKERS[kind](key, find))
    return out.otherwise(find)


def pseudonymised(docs: DataFrame, key: str, *, column: str = "text") -> DataFrame:
    """docs with the column's personal numbers, dates and addresses replaced, and n_found, how many were."""
    keep = [c for c in docs.columns if c not in ("n_found", "_new")]
    text = F.col(column)
    finds = F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    new = F.transform(finds, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    # computed once, for the few texts that have a digit or an @ at all
    marked = docs.select(*keep, F.when(text.rlike("[0-9@]") & text.rlike(ANY), new).alias("_new"))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("gap"), F.transform("_new", lambda p: p["new"]).alias("new")), lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    out = F.when(F.col("_new").isNull(), text).otherwise(joined)
    found = F.coalesce(F.size(F.filter("_new", lambda p: p["old"] != p["new"])), F.lit(0)).cast("long")
    return marked.select(*(out.alias(c) if c == column else c for c in keep), found.alias("n_found"))
