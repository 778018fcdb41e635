"""Format-preserving pseudonyms by keyed Feistel permutations, with DataFrame functions only.

Numbers and dates in text are found by one expression, validated, and replaced by their image under
a keyed permutation of their own format: what was valid stays valid, other formats are never
made, and equal values get equal pseudonyms in every document, so links survive.

=========  =============================================  ========================================
kind       validated by                                   permuted over
=========  =============================================  ========================================
date       calendar (ISO, d.m.y, m/d/y, 5 March 2021,     days of the 400 years from 1700
           March 5, 2021)
           calendar (d/m/y that is no m/d/y)              days 13 to 31 of their months
ipv4       octets to 255                                  all addresses, 2**16 x 2**16
mac        six pairs of hex digits                        hex digits, by class
ssn        assigned areas, groups, serials                898 x (99 x 9999)
iban       remainder 1 modulo 97; in groups of four also  account letters and digits, new check digits
           the country's length
card       13 to 19 digits in one and their Luhn digit,   all but the check digit, whose offset from
           or 16 in groups of four                        the Luhn digit is kept (valid stays valid)
phone      + and 7 to 15 digits, or ten in groups of the  digits behind the country code; with code 1, or
           North American plan (area, office from 200)    none: areas x offices x lines, so both forms link
email      address syntax                                 letters and digits of the local part, by class;
                                                          case is kept, and not told apart
secret     16 or more hex digits behind a secret's name   hex digits, by class
=========  =============================================  ========================================

Digits in card groups are replaced with a wrong Luhn digit too: their layout says what they are, and
a mistyped card still tells of its holder.

Numeric formats use a Feistel network over Z_a x Z_b (addition modulo the half's size); strings use
one over halves of characters, each moved within its class, so that punctuation stays. Round
functions are SHA-256 of key, kind, round and the other half. The key is a parameter, or the session's
``spark.rowloom.pseudonyms.key``; without either, one is drawn for the application, so that nobody can turn its
pseudonyms back, and runs don't link with each other.

Defined cases: a null text stays null; empty texts and texts without digits, @ or a secret's name come back
unchanged (and are not searched); things that look like a kind but fail validation stay as they are; texts of
any length are searched whole; repeated rows give equal results; an empty table gives an empty
result; columns other than the id and the text are not read, and ``pseudonymise`` keeps the
others as they are.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CONF = "spark.rowloom.pseudonyms.key"
ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Length of an IBAN by country; grouped ones end there, whatever word comes next.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
GROUPED_IBAN = "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ \u00a0-][A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[ \u00a0-][A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,2}[=:]"
#: In order of trial; a match is tried at each place once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,24}",
    "secret": SECRET_NAME + r"\s{0,2}[\"']?[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
    + rf"|(?<![0-9A-Za-z])(?:[0-9]{{1,2}} (?:{MONTHS}) [0-9]{{4}}|(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})(?![0-9A-Za-z])",
    "mac": r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])|(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{GROUPED_IBAN})(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z-]|\.[0-9])",
}
#: What a kind can begin with, looked at before its pattern is tried: most places fail here at once.
BEGINS = {"email": "[A-Za-z0-9]", "secret": "[tspaTSPA]", "date": "[0-9JFMASOND]", "mac": "[0-9A-Fa-f]{2}[:-]", "ipv4": r"[0-9]{1,3}\.", "phone": "[+(2-9]", "ssn": "[0-9]{3}-", "iban": "[A-Z]{2}[0-9]{2}", "card": "[0-9]{4}"}
ANY = "(?=[0-9A-Za-z+(])(?:" + "|".join(f"(?={BEGINS[k]})(?:{p})" for k, p in PATTERNS.items()) + ")"
#: Texts without any of these hold no match.
NEEDED = "[0-9@]|" + SECRET_NAME
DAYS, DAYS_A = 146097, 189  # 400 Gregorian years; 189 * 773
FIRST_DAY = "1700-01-01"
LATE_DAYS, LATE_A = DAYS - 12 * 4800, 9  # those after the 12th of their month; 9 * 9833


def _hash(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256)


def numeric(key: Column, kind: str, value: Column, a: int, b: int) -> Column:
    """A permutation of [0, a * b): Feistel over Z_a x Z_b with additions."""
    start = F.struct(F.pmod(value, F.lit(a)).cast("long").alias("l"), F.floor(value / F.lit(a)).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        # Halves change places each round; l is the one that moves.
        h = F.conv(F.substring(_hash(key, F.lit(kind), i, acc["r"]), 1, 15), 16, 10).cast("long")
        size = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(h, size), size).cast("long").alias("r"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda acc: acc["l"] + acc["r"] * F.lit(a).cast("long"))


def _moved(s: Column, digest: Column, hex_: bool) -> Column:
    """Each character of s moved within its class by two digits of the digest."""
    letters = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    classes = (letters[0], "abcdef", "ABCDEF") if hex_ else letters

    def one(i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        n = F.conv(F.substr(digest, F.pmod(i * 2 - 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for k in classes:
            at = F.instr(F.lit(k), c)
            out = F.when(at > 0, F.substr(F.lit(k), F.pmod(at - 1 + n, F.lit(len(k))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise(s)


def string(key: Column, kind: str, value: Column, hex_: bool = False) -> Column:
    """A permutation of the strings that have the value's length and, place by place, its classes."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(acc["r"].alias("l"), _moved(acc["l"], _hash(key, F.lit(kind), i, F.length(value), acc["r"]), hex_).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _refill(format_: Column, digits: Column, places: str = "[0-9]") -> Column:
    """format_ with its digits (or other places), in order, replaced by those given."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        d = c.rlike(places)
        return F.struct(F.concat(acc["s"], F.when(d, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("s"), (acc["at"] + d.cast("int")).alias("at"))

    return F.aggregate(F.split(format_, ""), start, step, lambda acc: acc["s"])


def luhn_digit(payload: Column) -> Column:
    """The digit that completes a payload."""
    n = F.length(payload)

    def one(acc: Column, i: Column) -> Column:
        d = F.substr(payload, n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + d

    return F.pmod(10 - F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one), F.lit(10)), F.lit(10))


def mod97(s: Column) -> Column:
    """Remainder of letters (A = 10) and digits read as one number."""

    def one(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)).cast("int")

    return F.aggregate(F.split(s, ""), F.lit(0), one)


def _date(key: Column, v: Column) -> Column:
    shapes = {"MM/dd/yyyy": v.contains("/"), "MMMM d, yyyy": v.contains(","), "d MMMM yyyy": v.contains(" "), "dd.MM.yyyy": v.contains("."), "yyyy-MM-dd": F.lit(True)}
    pattern = F.coalesce(*[F.when(test, p) for p, test in shapes.items()])
    day = F.coalesce(*[F.when(pattern == p, F.try_to_timestamp(v, F.lit(p)).cast("date")) for p in shapes])
    first = F.lit(FIRST_DAY).cast("date")
    n = F.datediff(day, first).cast("long")
    other = F.date_add(first, numeric(key, "date", n, DAYS_A, DAYS // DAYS_A).cast("int"))
    text = F.coalesce(*[F.when(pattern == p, F.date_format(other, p)) for p in shapes])
    return F.when((n >= 0) & (n < DAYS), text).when(day.isNull() & v.contains("/"), _day_first(key, v))


def _day_first(key: Column, v: Column) -> Column:
    """Of d/m/y with a day after the 12th, as no month has; so are its pseudonyms, and none is another's as m/d/y."""
    first = F.lit(FIRST_DAY).cast("date")
    day = F.try_to_timestamp(v, F.lit("dd/MM/yyyy")).cast("date")
    n = F.datediff(day, first).cast("long")
    place = n - ((F.year(day) - 1700) * 12 + F.month(day)) * 12

    def month(m: Column) -> Column:
        return F.make_date((F.floor(m / 12) + 1700).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))

    def before(m: Column) -> Column:
        return F.datediff(month(m), first) - 12 * m

    def write(x: Column) -> Column:
        # The months near to an even share; the last that starts at or before the place is the one.
        near = F.floor(x * 4800 / LATE_DAYS).cast("int")
        m = F.array_max(F.transform(F.sequence(near - 2, near + 2), lambda m: F.when(before(m) <= x, m)))
        return F.transform(F.array(m), lambda m: F.date_format(F.date_add(month(m), (x - before(m) + 12).cast("int")), "dd/MM/yyyy"))[0]

    made = F.transform(F.array(numeric(key, "day_first", place, LATE_A, LATE_DAYS // LATE_A)), write)[0]
    return F.when((n >= 0) & (n < DAYS) & (F.dayofmonth(day) > 12), made)


def _ipv4(key: Column, v: Column) -> Column:
    p = [F.split_part(v, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    n = numeric(key, "ipv4", ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3], 65536, 65536)
    return F.transform(F.array(n), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))[0]


def _ssn(key: Column, v: Column) -> Column:
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & group.between(1, 99) & (serial > 0)
    place = (area - 1 - (area > 666).cast("long")) + 898 * ((group - 1) + 99 * (serial - 1))
    n = numeric(key, "ssn", place, 898, 99 * 9999)

    def write(x: Column) -> Column:
        a, rest = F.pmod(x, F.lit(898)) + 1, F.floor(x / 898)
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.format_string("%03d-%02d-%04d", a.cast("long"), (F.pmod(rest, F.lit(99)) + 1).cast("long"), (F.floor(rest / 99) + 1).cast("long"))

    return F.when(valid, F.transform(F.array(n), write)[0])


def _iban(key: Column, written: Column) -> Column:
    v = F.regexp_replace(written, "[^A-Z0-9]", "")
    country, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5), F.length(v))
    valid = mod97(F.concat(account, F.substr(v, F.lit(1), F.lit(4)))) == 1
    made = F.transform(F.array(string(key, "iban", account)), lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))[0]
    return F.when(valid, F.when(v == written, made).otherwise(_refill(written, made, "[A-Z0-9]")))


def _card(key: Column, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    payload, check = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    offset = F.pmod(check - luhn_digit(payload), F.lit(10))
    made = F.transform(F.array(string(key, "card", payload)), lambda x: F.concat(x, F.pmod(luhn_digit(x) + offset, F.lit(10)).cast("string")))[0]
    return F.when((offset == 0) | (v != digits), _refill(v, made))


def country_code(digits: Column) -> Column:
    """The calling code at the start of an international number: 1 and 7 stand alone, of the others some have two
    digits, the rest three (ITU-T E.164)."""
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    return F.when(digits.rlike("^[17]"), F.left(digits, F.lit(1))).when(F.left(digits, F.lit(2)).isin(two.split()), F.left(digits, F.lit(2))).otherwise(F.left(digits, F.lit(3)))


def _american(key: Column, ten: Column) -> Column:
    """Ten digits of the North American plan: area and office are 200 to 999."""
    area, office, line = (F.substring(ten, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    place = ((area - 200) * 800 + office - 200) * 10000 + line
    n = numeric(key, "american", place, 80000, 80000)
    return F.transform(F.array(n), lambda x: F.format_string("%03d%03d%04d", F.floor(x / 8000000) + 200, F.pmod(F.floor(x / 10000), F.lit(800)) + 200, F.pmod(x, F.lit(10000))))[0]


def _phone(key: Column, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    code = F.when(v.startswith("+"), country_code(digits)).otherwise("")
    rest = F.substr(digits, F.length(code) + 1, F.length(digits))
    american = code.isin("1", "") & rest.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    made = F.when(american, _american(key, rest)).when(code != "", string(key, "phone", rest))
    return F.when(american | (F.length(digits).between(7, 15) & (F.length(rest) > 1)), _refill(v, F.concat(code, made)))


def _email(key: Column, v: Column) -> Column:
    local = F.substring_index(v, "@", 1)
    moved = string(key, "email", F.lower(local))
    cased = F.array_join(F.zip_with(F.split(local, ""), F.split(moved, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    return F.concat(cased, F.lit("@"), F.substring_index(v, "@", -1))


def _mac(key: Column, v: Column) -> Column:
    return _refill(v, string(key, "mac", F.regexp_replace(v, "[^0-9A-Fa-f]", ""), hex_=True), "[0-9A-Fa-f]")


def _secret(key: Column, v: Column) -> Column:
    value = F.regexp_extract(v, "([0-9A-Fa-f]{16,})$", 1)
    return F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(value)), string(key, "secret", value, hex_=True))


MAKERS = {"email": _email, "secret": _secret, "date": _date, "ipv4": _ipv4, "mac": _mac, "phone": _phone, "ssn": _ssn, "iban": _iban, "card": _card}


def kind_of(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        # A match is of the first kind that matches it whole.
        out = F.when(v.rlike(rf"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def pseudonym(v: Column, key: Column) -> Column:
    """The pseudonym of a match, null where validation fails."""
    kind = kind_of(v)
    out = F.lit(None).cast("string")
    for k, make in MAKERS.items():
        out = F.when(kind == k, make(key, v)).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    """The session's key; a drawn one, the application's own, where none is set."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, found)
    return found


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with the text's numbers and dates replaced, and ``n_pseudonyms`` (0 for null texts); an
    older column of that name is replaced."""
    t, spans = F.col(text), "__spans"
    found = docs.withColumn(spans, F.when(t.rlike(NEEDED), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    k = F.lit(key_of(docs.sparkSession) if key is None else key)
    found = found.withColumn(spans, F.transform(spans, lambda v: F.struct(v.alias("old"), pseudonym(v, k).alias("new"))))
    new = F.transform(spans, lambda s: F.coalesce(s["new"], s["old"]))
    parts = F.split(t, ANY, -1)
    joined = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text_out = F.when(F.size(F.coalesce(F.col(spans), F.array())) > 0, joined).otherwise(t)
    count = F.size(F.filter(F.coalesce(F.col(spans), F.array()), lambda s: s["new"].isNotNull()))
    out = found.withColumn("__text", text_out).withColumn("n_pseudonyms", count.cast("int")).withColumn(text, F.col("__text"))
    return out.drop(spans, "__text")
