"""Value builders: Columns over (seed, table, column, row). Word lists are this library's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import corpora, rng

FIRST_F = ["Ada", "Beatriz", "Chloe", "Dana", "Elif", "Freya", "Grace", "Hana", "Ines", "Jana", "Keiko", "Lena", "Mina", "Nora", "Olga", "Priya"]
FIRST_M = ["Adam", "Bruno", "Carlos", "David", "Emre", "Felix", "Goran", "Hugo", "Ivan", "Jonas", "Kenji", "Luca", "Milan", "Noah", "Oscar", "Pavel"]
LAST = ["Abel", "Becker", "Costa", "Dubois", "Evans", "Fischer", "Garcia", "Haas", "Ito", "Jensen", "Kovacs", "Lopez", "Meyer", "Novak", "Okoro", "Petrov", "Quinn", "Rossi", "Silva", "Tanaka"]
WORDS = ["amber", "brisk", "cedar", "delta", "early", "field", "grain", "harbor", "inner", "jolly", "kettle", "lunar", "meadow", "north", "ocean", "paper", "quiet", "river", "stone", "timber", "upper", "violet", "water", "yellow"]
STREETS = ["Oak", "Mill", "Lake", "Station", "Garden", "Church", "Park", "Bridge", "Hill", "Market"]
#: city, state, zip prefix; used together, so that a row's place is one.
PLACES = [
    ("Springfield", "Illinois", "627"), ("Portland", "Oregon", "972"), ("Austin", "Texas", "787"), ("Denver", "Colorado", "802"), ("Boston", "Massachusetts", "021"), ("Atlanta", "Georgia", "303"),
    ("Phoenix", "Arizona", "850"), ("Seattle", "Washington", "981"), ("Nashville", "Tennessee", "372"), ("Madison", "Wisconsin", "537"), ("Omaha", "Nebraska", "681"), ("Tampa", "Florida", "336"),
]
COUNTRIES = [("Austria", "AT"), ("Brazil", "BR"), ("Canada", "CA"), ("Denmark", "DK"), ("Egypt", "EG"), ("France", "FR"), ("Ghana", "GH"), ("India", "IN"), ("Japan", "JP"), ("Kenya", "KE")]
SAFE_DOMAINS = ["example.com", "example.net", "example.org"]  # reserved for documentation
ZONES = ["UTC", "Europe/Paris", "America/New_York", "Asia/Tokyo", "Africa/Cairo", "America/Lima"]
CURRENCIES = ["EUR", "USD", "GBP", "JPY", "CHF", "CAD"]
COLORS = ["red", "green", "blue", "black", "white", "grey"]
DAY = 86400


@dataclass(frozen=True)
class Ctx:
    """What a value depends on. ref: the present, as epoch seconds, given so that reruns agree."""

    seed: int
    table: str
    column: str
    row: Column
    ref: int = 1735689600
    max_length: int | None = None
    locale: str = corpora.DEFAULT

    def corpus(self, kind: str) -> list | None:
        """The locale's words of a kind; None for English, which has its own lists here."""
        return corpora.entries(self.locale, kind)

    def u(self, draw: int = 0, column: str | None = None) -> Column:
        return rng.uniform(self.seed, self.table, column or self.column, self.row, draw)

    def hex(self, draw: int = 0) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.table), F.lit(self.column), self.row.cast("string"), F.lit(str(draw))))


Builder = Callable[[Ctx], Column]


def from_list(values: list) -> Builder:
    return lambda c: rng.pick(c.u(), values)


def of_locale(kind: str, english: Builder, part: int | None = None) -> Builder:
    """A draw from the locale's words of a kind (or a part of them), else English."""

    def build(c: Ctx) -> Column:
        found = c.corpus(kind)
        return english(c) if found is None else corpora.drawn(c.u(), [x if part is None else x[part] for x in found])

    return build


def a_word(c: Ctx, draw: int) -> Column:
    return rng.pick(c.u(draw), c.corpus("word") or WORDS)


def words(n: int) -> Builder:
    return lambda c: F.concat_ws(" ", *[a_word(c, i) for i in range(n)])


def sentence(n: int = 8) -> Builder:
    return lambda c: F.concat(F.initcap(a_word(c, 0)), F.lit(" "), F.concat_ws(" ", *[a_word(c, i) for i in range(1, n)]), F.lit("."))


def sentences(n: int) -> Builder:
    return lambda c: F.concat_ws(" ", *[F.concat(F.initcap(a_word(c, 10 * k)), F.lit(" "), F.concat_ws(" ", *[a_word(c, 10 * k + i) for i in range(1, 7)]), F.lit(".")) for k in range(n)])


def integer(low: int, high: int) -> Builder:
    return lambda c: rng.between(c.u(), low, high)


def decimal(low: float, high: float, digits: int) -> Builder:
    return lambda c: F.floor((F.lit(low) + c.u() * F.lit(high - low)) * F.lit(10**digits)) / F.lit(float(10**digits))


def moment(oldest: int, newest: int) -> Builder:
    """Seconds before (negative) or after the reference time, as a timestamp."""
    return lambda c: F.timestamp_seconds(F.lit(c.ref) + F.floor(F.lit(oldest) + c.u() * F.lit(newest - oldest)).cast("long"))


def hex_digits(n: int) -> Builder:
    return lambda c: F.substring(F.concat(c.hex(0), c.hex(1)), 1, n)


def code(n: int) -> Builder:
    return lambda c: F.upper(F.substring(c.hex(), 1, n))


def uuid4(c: Ctx) -> Column:
    h = c.hex()
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.floor(c.u(1) * 4) + 1).cast("int"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def ipv4(c: Ctx) -> Column:
    return F.concat_ws(".", *[rng.between(c.u(i), 1 if i in (0, 3) else 0, 254).cast("string") for i in range(4)])


def pairs_of(n: int, sep: str, width: int = 2) -> Builder:
    return lambda c: F.concat_ws(sep, *[F.substring(c.hex(), 1 + width * i, width) for i in range(n)])


def local_part(c: Ctx) -> Column:
    if c.corpus("last") is None:
        return F.lower(F.concat(rng.pick(c.u(0), FIRST_F + FIRST_M), F.lit("."), rng.pick(c.u(1), LAST)))
    return corpora.ascii_folded(F.concat(rng.pick(c.u(0), firsts(c)), F.lit("."), corpora.drawn(c.u(1), c.corpus("last"))))


def firsts(c: Ctx) -> list[str]:
    return [*(c.corpus("first_f") or FIRST_F), *(c.corpus("first_m") or FIRST_M)]


def address(local: Column, c: Ctx) -> Column:
    """An e-mail address at a domain that nobody can own."""
    return F.concat(local, F.lit("@"), rng.pick(c.u(2), SAFE_DOMAINS))


def email(c: Ctx) -> Column:
    return address(local_part(c), c)


def phone(c: Ctx) -> Column:
    lead = c.corpus("phone")
    if lead:
        return F.concat(F.lit(lead[0]), F.lit("-"), F.lpad(rng.between(c.u(0), 0, 999).cast("string"), 3, "0"))
    return F.concat(F.lit("+1-555-"), F.lpad(rng.between(c.u(0), 0, 999).cast("string"), 3, "0"), F.lit("-"), F.lpad(rng.between(c.u(1), 0, 9999).cast("string"), 4, "0"))


def postal(c: Ctx) -> Column:
    found = c.corpus("place")
    return digits(5)(c) if found is None else postal_of(corpora.drawn(c.u(0), [x[2] for x in found]), found[0][3], c.u(1))


def postal_of(lead: Column, size: int, u: Column) -> Column:
    """A postal code of so many digits that begins with lead."""
    return F.substring(F.concat(lead, F.lpad(rng.between(u, 0, 10**size - 1).cast("string"), size, "0")), 1, size)


def street(c: Ctx) -> Column:
    found = c.corpus("street")
    if found:
        return F.concat_ws(" ", corpora.drawn(c.u(1), found), rng.between(c.u(0), 1, 199).cast("string"))
    return F.concat_ws(" ", rng.between(c.u(0), 1, 9999).cast("string"), rng.pick(c.u(1), STREETS), F.lit("Street"))


def digits(n: int) -> Builder:
    return lambda c: F.concat(*[F.lpad(rng.between(c.u(i), 0, 10 ** min(4, n - 4 * i) - 1).cast("string"), min(4, n - 4 * i), "0") for i in range((n + 3) // 4)])


def boolean(c: Ctx) -> Column:
    return c.u() < 0.5


def null(c: Ctx) -> Column:
    return F.lit(None).cast("string")


def first_name(c: Ctx) -> Column:
    return rng.pick(c.u(), firsts(c))


def full_name(c: Ctx) -> Column:
    last = c.corpus("last")
    return F.concat_ws(" ", rng.pick(c.u(0), firsts(c)), rng.pick(c.u(1), LAST) if last is None else corpora.drawn(c.u(1), last))


YEAR = 365 * DAY
#: Builders by dotted name: what configurations and plugins refer to.
NAMED: dict[str, Builder] = {
    "person.first_name": first_name, "person.last_name": of_locale("last", from_list(LAST)), "person.middle_name": first_name, "person.full_name": full_name, "person.prefix": from_list(["Dr", "Mr", "Ms", "Mx"]),
    "person.suffix": from_list(["Jr", "Sr", "II", "III"]), "person.username": lambda c: F.concat(F.lower(first_name(c)), rng.between(c.u(3), 1, 9999).cast("string")), "person.sex": from_list(["female", "male"]),
    "person.birth_date": lambda c: moment(-80 * YEAR, -18 * YEAR)(c).cast("date"), "person.age": integer(18, 85), "person.bio": sentences(2), "person.avatar": lambda c: F.concat(F.lit("https://img.example.com/"), F.substring(c.hex(), 1, 12), F.lit(".png")),
    "contact.email": email, "contact.phone": phone, "contact.fax": phone, "contact.url": lambda c: F.concat(F.lit("https://"), rng.pick(c.u(0), WORDS), F.lit("."), rng.pick(c.u(1), SAFE_DOMAINS)),
    "internet.ipv4": ipv4, "internet.ipv6": pairs_of(8, ":", 4), "internet.mac": pairs_of(6, ":"), "internet.user_agent": lambda c: F.concat(F.lit("Browser/"), rng.between(c.u(), 1, 120).cast("string"), F.lit(".0")),
    "internet.slug": lambda c: F.concat_ws("-", *[rng.pick(c.u(i), WORDS) for i in range(3)]), "internet.domain": lambda c: F.concat(rng.pick(c.u(0), WORDS), F.lit("."), rng.pick(c.u(1), SAFE_DOMAINS)),
    "internet.password": hex_digits(16), "internet.token": hex_digits(32),
    "location.street": street, "location.secondary": lambda c: F.concat(F.lit("Apt. "), rng.between(c.u(), 1, 999).cast("string")),
    "location.city": of_locale("place", from_list([p[0] for p in PLACES]), 0), "location.state": of_locale("place", from_list([p[1] for p in PLACES]), 1), "location.country": from_list([x for x, _ in COUNTRIES]), "location.country_code": from_list([x for _, x in COUNTRIES]),
    "location.zip": postal, "location.latitude": decimal(-90, 90, 6), "location.longitude": decimal(-180, 180, 6), "location.county": of_locale("county", lambda c: F.concat(rng.pick(c.u(), STREETS), F.lit(" County"))), "location.timezone": from_list(ZONES),
    "finance.amount": decimal(1, 10000, 2), "finance.rate": decimal(0, 1, 4), "finance.currency": from_list(CURRENCIES), "finance.card": digits(16), "finance.account": digits(10), "finance.routing": digits(9),
    "finance.iban": lambda c: F.concat(F.lit("DE"), digits(20)(c)), "finance.bic": lambda c: F.concat(F.upper(F.translate(F.substring(c.hex(), 1, 6), "0123456789", "ghijklmnop")), F.lit("XX")),
    "commerce.product": lambda c: F.initcap(words(2)(c)), "commerce.brand": lambda c: F.initcap(rng.pick(c.u(), WORDS)), "commerce.department": from_list(["Books", "Garden", "Grocery", "Music", "Office", "Sports", "Tools", "Toys"]),
    "commerce.sku": lambda c: F.concat(code(3)(c), F.lit("-"), digits(6)(c)), "commerce.isbn": lambda c: F.concat(F.lit("978"), digits(10)(c)), "commerce.color": from_list(COLORS), "commerce.size": from_list(["XS", "S", "M", "L", "XL"]),
    "commerce.weight": decimal(0.1, 100, 2), "commerce.quantity": integer(1, 100), "commerce.rating": integer(1, 5), "commerce.review": sentences(2), "commerce.price": decimal(1, 1000, 2),
    "identifier.uuid": uuid4, "identifier.code": code(8), "identifier.hash": hex_digits(40), "identifier.external": hex_digits(12), "identifier.tracking": code(16), "identifier.confirmation": code(6), "identifier.serial": code(10),
    "time.created": moment(-2 * YEAR, 0), "time.updated": moment(-30 * DAY, 0), "time.deleted": moment(-7 * DAY, 0), "time.published": moment(-YEAR, 0), "time.expires": moment(0, YEAR), "time.start": moment(-3 * YEAR, 0),
    "time.end": moment(0, YEAR), "time.recent": moment(-90 * DAY, 0), "time.date": moment(-2 * YEAR, 0), "time.year": integer(2000, 2026), "time.month": integer(1, 12), "time.day": integer(1, 28), "time.hour": integer(0, 23), "time.minute": integer(0, 59),
    "text.sentence": sentence(), "text.paragraph": sentences(4), "text.long": sentences(9), "text.short": sentences(2), "text.words": words(3), "boolean.coin": boolean, "null": null,
}
