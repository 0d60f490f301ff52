"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found values are validated, then permuted within their own format by a keyed Feistel network, so equal values get equal
pseudonyms in every document and different values of a kind never meet. Kinds:
  email  the local part: each letter stays a letter of its case and each digit a digit; the domain stays
  iban   check digits hold (mod 97): the account part is permuted, the check digits are computed anew
  ip     four numbers of at most 255: permuted among all such addresses
  date   a day that exists, year first or last: permuted among the days of its 400 years (from 1700, 2100, ...) that can be written
         in its layout, which is kept. Month first with slashes and day first otherwise, the other order where only that can be
  phone  a number with + and country code, or of three, three and four digits: the digits behind the country code are permuted and put
         into the value's layout, so all layouts of a number get one pseudonym; a trunk zero in brackets stays
  ssn    three, two and four digits in the valid ranges: permuted among the valid ones
  card   13 to 19 digits, in one run or in the usual groups, that pass the Luhn test: all but the check digit are permuted, and
         the check digit is computed anew; of four groups of four with a number behind that don't pass, the four groups alone
A found value that fails its kind's validation stays as it is.

One round adds to one half of the value a SHA-256 digest of key, kind, round number and the other half, character by
character modulo the size of the character's class, and swaps the halves: whatever the digest, that can be undone, so a
round is a permutation of the format. A value that falls outside its layout is permuted again until it doesn't, which keeps
different values apart. The key is a parameter without default; a deployment passes its own secret. It reaches the tasks as the one
row of a table, so no plan, event log or page of the UI shows it.

Defined results: a null text stays null, an empty one empty, with no values; repeated rows and all other columns, whatever their
names, are kept as they are; equal values get equal pseudonyms, also in one text (dates and e-mail addresses in equal layouts); an
empty table gives no rows.
Work is within a row: no shuffle. No pattern repeats a group without a bound, so a long text costs in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days in 400 years, and two factors of it.
DAYS, DAY_PARTS = 146_097, (189, 773)
#: Permutations after which a date in its layout is found but for a chance of 1e-21.
WALK = 200
SSN_PARTS = (898, 989_901)
#: Country codes of one and of two digits; all others have three.
CODES_1 = (1, 7)
CODES_2 = (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)

_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters of bank account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, countries: str) -> str:
    tail = f"(?: ?[A-Z0-9]{{{(n - 4) % 4}}})" if n % 4 else ""
    return f"(?:{countries.replace(' ', '|')})" + r"\d{2}(?: ?[A-Z0-9]{4}){" + str((n - 4) // 4) + "}" + tail + _NOT_AFTER


_IBANS = "|".join(_of_length(n, countries) for n, countries in IBAN_LENGTHS.items())
#: What a phone number doesn't go on into: a blank and a card, date, ssn or ip.
_NEXT = r"(?! (?:\d{13}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{4}[-/.]\d{1,2}[-/.]\d|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{3}-\d{2}-\d{4}|\d{1,3}(?:\.\d{1,3}){3}))"
#: By kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}",
    "iban": _NOT_BEFORE + "(?:" + _IBANS + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _NOT_AFTER + ")",
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
    "date": _NOT_BEFORE + r"(?:\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})" + _NOT_AFTER,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+\d(?:" + _NEXT + r"[ .\-]?\(?\d\)?){6,14}(?!-\d)|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}]|\.\d)",
    "ssn": _NOT_BEFORE + r"\d{3}-\d{2}-\d{4}" + _NOT_AFTER,
    "card": _NOT_BEFORE + r"(?:\d{13,19}|\d{4}([ \-])\d{4}\4\d{4}\4\d{4}(?:\4\d{1,3}(?![\-./]?\d))?|\d{4}([ \-])\d{6}\5\d{5})" + _NOT_AFTER,
}
KINDS = tuple(PATTERNS)
#: The back references of dates and cards count groups from the left of the whole.
ANY = "|".join(PATTERNS.values())


def _number(key: Column, tag: str, *parts: Column) -> Column:
    """48 bits of the digest of key, tag and parts."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(tag), *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def permuted_pair(key: Column, tag: str, left: Column, right: Column, sizes: tuple[int, int]) -> tuple[Column, Column]:
    """A permutation of the pairs (left below sizes[0], right below sizes[1])."""

    def half(acc: Column, k: Column) -> Column:
        size = F.when(k % 2 == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")
        moved = F.pmod(acc["x"] + F.pmod(_number(key, tag, k.cast("string"), acc["y"].cast("string")), size), size)
        return F.struct(acc["y"].alias("x"), moved.alias("y"))

    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, half)
    return out["x"], out["y"]


def permuted_text(key: Column, tag: str, text: Column) -> Column:
    """A permutation of the texts with the same layout: ASCII letters by case and digits move in their class, all else stays."""

    def shifted(part: Column, k: Column, other: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            by = _number(key, tag, k.cast("string"), at.cast("string"), other)
            moved = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
            return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def half(acc: Column, k: Column) -> Column:
        new = _bound(F.sha2(acc["y"], 256), lambda other: shifted(acc["x"], k, other))
        return F.struct(acc["y"].alias("x"), new.alias("y"))

    middle = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), middle).alias("x"), F.substr(text, middle + 1).alias("y"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, half)
    return F.concat(out["x"], out["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _into(layout: Column, characters: Column, kind: str) -> Column:
    """Put characters, one after the other, in the places that layout has for them."""
    place = lambda i: F.length(F.regexp_replace(F.substr(layout, F.lit(1), i + 1), f"[^{kind}]", ""))
    return F.array_join(F.transform(F.split(layout, ""), lambda c, i: F.when(c.rlike(f"^[{kind}]$"), F.substr(characters, place(i), F.lit(1))).otherwise(c)), "")


def luhn(prefix: Column) -> Column:
    """The check digit that completes prefix."""
    doubled = F.transform(F.split(F.reverse(prefix), ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    """text's letters count as 10 to 35, as in bank account numbers."""

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (acc * 100 + letter) % 97).otherwise(acc)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _email(key: Column, m: Column) -> Column:
    new = F.concat(permuted_text(key, "email", F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))
    return F.when(~m.contains(".."), new)


def _iban(key: Column, m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    account = permuted_text(key, "iban", F.substr(plain, F.lit(5)))
    country = F.substring(m, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1
    return F.when(valid, _into(m, F.concat(country, check, account), "A-Z0-9"))


def _ip(key: Column, m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    x, y = permuted_pair(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65536, 65536))
    parts = [(x / 256).cast("long"), x % 256, (y / 256).cast("long"), y % 256]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _date(key: Column, m: Column) -> Column:
    start = F.lit("1700-01-01").cast("date")

    def read(parts: Column) -> Column:
        """mark, the places of year, month and day in parts, the widths of the last two, whether only days over 12 keep the order, the day's number."""
        mark = F.regexp_extract(m, "[-/.]", 0)
        year_first = F.length(parts[0]) == 4
        over = lambda k: parts[k].cast("int") > 12
        late = ~year_first & F.when(mark == "/", over(0)).otherwise(over(1))
        month_first = year_first | ((mark == "/") != late)
        first = F.when(year_first, 1).otherwise(0)
        year, month, day = F.when(year_first, 0).otherwise(2), first + F.when(month_first, 0).otherwise(1), first + F.when(month_first, 1).otherwise(0)
        text = F.concat_ws("-", parts[year], F.lpad(parts[month], 2, "0"), F.lpad(parts[day], 2, "0"))
        return F.struct(
            mark.alias("mark"), year.alias("year"), month.alias("month"), day.alias("day"), F.length(parts[month]).alias("months"), F.length(parts[day]).alias("days"),
            late.alias("late"), F.datediff(text.try_cast("date"), start).alias("n"),
        )

    def permuted(n: Column) -> Column:
        x, y = permuted_pair(key, "date", (F.pmod(n, F.lit(DAYS)) / DAY_PARTS[1]).cast("int"), F.pmod(n, F.lit(DAYS)) % DAY_PARTS[1], DAY_PARTS)
        return (n - F.pmod(n, F.lit(DAYS)) + x * DAY_PARTS[1] + y).cast("int")

    def writable(own: Column, like: Column) -> Column:
        fits = ((like["months"] == 2) | (F.month(own) < 10)) & ((like["days"] == 2) | (F.day(own) < 10))
        return fits & (~like["late"] | (F.day(own) > 12)) & F.year(own).between(1, 9999)

    def walked(like: Column) -> Column:
        step = lambda n, _: F.when(writable(F.date_add(start, n), like), n).otherwise(permuted(n))
        # nothing falls outside a padded layout, but for the first and last years
        any_day = (like["months"] == 2) & (like["days"] == 2) & ~like["late"] & like["n"].between(-4 * DAYS, 20 * DAYS - 1)
        return F.date_add(start, F.aggregate(F.sequence(F.lit(1), F.when(any_day, 1).otherwise(WALK)), permuted(like["n"]), step))

    def printed(new: Column, like: Column) -> Column:
        pad = lambda value, width: F.lpad(value.cast("string"), width, F.lit("0"))
        texts = F.array(pad(F.year(new), F.lit(4)), pad(F.month(new), like["months"]), pad(F.day(new), like["days"]))
        # which of year, month and day stands first, second and third
        order = [F.when(like["year"] == 0, a).when(like["month"] == 0, b).otherwise(c) for a, b, c in ((0, 1, 2), (1, 2, 1), (2, 0, 0))]
        return _bound(texts, lambda t: F.concat(t[order[0]], like["mark"], t[order[1]], like["mark"], t[order[2]]))

    return _bound(read(F.split(m, "[-/.]")), lambda like: F.when(like["n"].isNotNull(), _bound(walked(like), lambda new: printed(new, like))))


def _phone(key: Column, m: Column) -> Column:
    """The country code and a trunk zero in brackets stay."""
    layout = F.replace(m, F.lit("(0)"), F.lit("(O)"))
    digits = _digits(layout)
    size = F.when(F.substring(digits, 1, 1).isin(*map(str, CODES_1)), 1).when(F.substring(digits, 1, 2).isin(*map(str, CODES_2)), 2).otherwise(3)
    code = F.when(m.startswith("+"), size).otherwise(0)
    new = F.concat(F.substr(digits, F.lit(1), code), permuted_text(key, "phone", F.substr(digits, code + 1)))
    return F.when(F.length(digits).between(7, 15), F.replace(_into(layout, new, "0-9"), F.lit("(O)"), F.lit("(0)")))


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    place = area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))
    x, y = permuted_pair(key, "ssn", place, (group - 1) * 9999 + serial - 1, SSN_PARTS)
    new = x + 1 + F.when(x >= 665, F.lit(1)).otherwise(F.lit(0))
    text = F.format_string("%03d-%02d-%04d", new, (y / 9999).cast("long") + 1, y % 9999 + 1)
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), text)


def _card(key: Column, m: Column) -> Column:
    def whole(m: Column) -> Column:
        digits = _digits(m)
        body, check = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
        new = permuted_text(key, "card", body)
        return F.when(check == luhn(body), _into(m, F.concat(new, luhn(new).cast("string")), "0-9"))

    grouped = m.rlike(r"^\d{4}([ \-])(\d{4}\1){3}\d{1,3}$")
    return F.coalesce(whole(m), F.when(grouped, F.concat(whole(F.substr(m, F.lit(1), F.lit(19))), F.substr(m, F.lit(20)))))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.when(m.contains("@"), F.lit("email")).when(m.rlike(r"^[A-Z]"), F.lit("iban")).when(m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), F.lit("ip"))
    out = out.when(m.rlike(r"^(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})$"), F.lit("date"))
    return out.when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone")).when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn")).otherwise(F.lit("card"))


def pseudonym(kind: Column, m: Column, key: Column) -> Column:
    """The pseudonym of value m of that kind; null if it isn't valid."""
    out = None
    for name, maker in _MAKERS.items():
        out = (F if out is None else out).when(kind == name, maker(key, m))
    return out


def _free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """docs with pseudonyms in column text; with counts, also n_<kind> for every kind. All other columns stay."""
    held, secret = _free_name(docs, "values"), _free_name(docs, "secret")
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text")
    some = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)))
    one_row = docs.sparkSession.createDataFrame([(key,)], f"{secret} string")
    values = docs.crossJoin(F.broadcast(one_row)).select(*own, secret, F.coalesce(some, F.array().cast("array<string>")).alias(held))
    new = F.transform(held, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    new = F.transform(new, lambda v: F.struct(v["m"].alias("m"), v["kind"].alias("kind"), pseudonym(v["kind"], v["m"], F.col(secret)).alias("new")))
    values = values.select(*own, new.alias(held))
    parts = F.zip_with(F.split(text, f"({ANY})", -1), held, lambda part, v: F.concat(F.coalesce(part, F.lit("")), F.coalesce(v["new"], v["m"], F.lit(""))))
    masked = F.when(F.size(held) > 0, F.array_join(parts, "")).otherwise(text)
    of_kind = lambda k: F.filter(held, lambda v: (v["kind"] == k) & v["new"].isNotNull())
    more = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS] if counts else []
    return values.select(*[masked.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)
