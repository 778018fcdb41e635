"""What column names say about their values.

The names in NAMES, EVENTS, ENDINGS and BEGINNINGS, and the pairs in EARLIER_LATER, are fixed values: schemas that are
in use have them, and a column of such a name has to get the kind of value that it gets elsewhere. Which generator
serves a name, words in STEMS and everything else is this library's own choice.

A name is looked up without its underscores, so that one entry stands for first_name and firstname."""

from __future__ import annotations

# --- fixed values: names of columns

#: Names of columns by what fills them, as words; a column may write them with underscores or as one word.
NAMES: dict[str, list[str]] = {
    "boolean.coin": ["active", "admin", "approved", "archived", "confirmed", "deleted", "disabled", "enabled", "featured", "hidden", "locked", "opted in", "private", "public", "published", "read", "subscribed", "verified", "visible"],
    "commerce.brand": ["brand", "manufacturer"],
    "commerce.color": ["color", "colour"],
    "commerce.department": ["category", "department"],
    "commerce.isbn": ["barcode", "isbn"],
    "commerce.product": ["item name", "product", "product name"],
    "commerce.quantity": ["qty", "quantity", "stock"],
    "commerce.rating": ["rating", "score", "stars"],
    "commerce.review": ["review"],
    "commerce.size": ["size"],
    "commerce.sku": ["sku"],
    "commerce.weight": ["weight"],
    "contact.email": ["email", "email address", "mail"],
    "contact.fax": ["fax"],
    "contact.phone": ["cell", "mobile", "phone", "phone number", "telephone"],
    "contact.url": ["homepage", "link", "url", "website"],
    "finance.account": ["account number"],
    "finance.amount": ["amount", "balance", "cost", "discount", "fee", "price", "profit", "revenue", "salary", "subtotal", "tax", "total"],
    "finance.bic": ["bic", "swift"],
    "finance.card": ["card number", "credit card"],
    "finance.currency": ["currency", "currency code"],
    "finance.iban": ["iban"],
    "finance.rate": ["interest rate", "rate", "tax rate"],
    "finance.routing": ["routing number"],
    "identifier.code": ["code", "ref", "reference"],
    "identifier.confirmation": ["confirmation code"],
    "identifier.external": ["external id"],
    "identifier.hash": ["checksum", "hash", "sha"],
    "identifier.serial": ["serial", "serial number"],
    "identifier.tracking": ["tracking number"],
    "identifier.uuid": ["guid", "uuid"],
    "internet.domain": ["domain", "domain name", "host", "hostname"],
    "internet.ipv4": ["ip", "ip address", "ipv4"],
    "internet.ipv6": ["ipv6"],
    "internet.mac": ["mac", "mac address"],
    "internet.password": ["passwd", "password", "password hash"],
    "internet.slug": ["permalink", "slug"],
    "internet.token": ["access token", "api key", "refresh token", "secret", "token"],
    "internet.user_agent": ["user agent"],
    "location.city": ["city", "city name", "town"],
    "location.country": ["country", "country name", "nation"],
    "location.country_code": ["country code"],
    "location.county": ["county", "district", "neighborhood"],
    "location.latitude": ["lat", "latitude"],
    "location.longitude": ["lng", "lon", "longitude"],
    "location.secondary": ["address 2", "address line 2", "apartment", "unit"],
    "location.state": ["province", "region", "state", "state name"],
    "location.street": ["address", "address 1", "address line 1", "street", "street address"],
    "location.timezone": ["time zone", "tz"],
    "location.zip": ["postal code", "postcode", "zip", "zip code"],
    "person.age": ["age"],
    "person.avatar": ["avatar", "avatar url", "photo", "profile image"],
    "person.bio": ["about", "bio", "biography"],
    "person.birth_date": ["birth date", "birthday", "date of birth", "dob"],
    "person.first_name": ["first name", "fname", "forename", "given name"],
    "person.full_name": ["display name", "full name", "name"],
    "person.last_name": ["family name", "last name", "lname", "surname"],
    "person.middle_name": ["middle name"],
    "person.prefix": ["prefix", "salutation", "title"],
    "person.sex": ["gender", "sex"],
    "person.suffix": ["suffix"],
    "person.username": ["handle", "login", "nickname", "user name"],
    "text.long": ["article", "text"],
    "text.paragraph": ["abstract", "body", "content", "description", "excerpt", "message"],
    "text.sentence": ["caption", "headline", "label", "subject", "summary"],
    "text.short": ["comment", "comments", "note", "notes", "remarks"],
    "time.date": ["date"],
    "time.day": ["day"],
    "time.hour": ["hour"],
    "time.minute": ["minute", "second"],
    "time.month": ["month"],
    "time.recent": ["last login", "last seen", "time", "timestamp"],
    "time.year": ["year"],
}
#: What happened, and what the time of it is filled with: the event alone (as a time), and with the ends and beginnings below.
EVENTS: dict[str, list[str]] = {
    "time.created": ["created", "inserted"],
    "time.deleted": ["deleted"],
    "time.end": ["due", "end", "ended", "ends"],
    "time.expires": ["expired", "expires", "expiry", "expiration"],
    "time.published": ["published"],
    "time.start": ["hire", "hired", "start", "started", "starts"],
    "time.updated": ["last modified", "modified", "updated"],
}
EVENT_ENDS = ["", "at", "date", "on", "time"]
EVENT_BEGINNINGS = ["date"]
#: Last words of longer names.
ENDINGS: dict[str, list[str]] = {
    "contact.email": ["email"],
    "contact.fax": ["fax"],
    "contact.phone": ["mobile", "phone", "tel"],
    "contact.url": ["homepage", "link", "uri", "url", "website"],
    "finance.amount": ["amount", "balance", "cost", "fee", "price", "total"],
    "finance.rate": ["rate"],
    "identifier.code": ["code", "ref"],
    "identifier.hash": ["hash"],
    "identifier.serial": ["number"],
    "identifier.uuid": ["guid", "uuid"],
    "internet.domain": ["domain"],
    "internet.ipv4": ["ip"],
    "internet.mac": ["mac"],
    "internet.password": ["password"],
    "internet.slug": ["slug"],
    "internet.token": ["key", "token"],
    "location.city": ["city"],
    "location.country": ["country"],
    "location.latitude": ["lat"],
    "location.longitude": ["lng", "lon"],
    "location.state": ["state"],
    "location.street": ["address", "street"],
    "location.zip": ["zip"],
    "time.date": ["date", "on"],
    "time.recent": ["at"],
}
#: First words of names of truth values.
BEGINNINGS: dict[str, list[str]] = {"boolean.coin": ["allow", "can", "disable", "enable", "has", "is", "needs", "should", "was", "will"]}

#: Events of which the first is never after the second; a column has one with an end or beginning as above, or "of".
EARLIER_LATER: list[tuple[str, str]] = [
    ("begin", "end"), ("birth", "death"), ("birth", "hire"), ("checkin", "checkout"), ("effective from", "effective to"), ("order", "delivery"), ("order", "ship"), ("ordered", "delivered"), ("ordered", "shipped"), ("ship", "delivery"),
    ("shipped", "delivered"), ("start", "end"), ("started", "ended"), ("valid from", "valid to"), ("valid from", "valid until"),
    # More of them, of our own.
    ("created", "deleted"), ("created", "modified"), ("created", "paid"), ("created", "updated"), ("departure", "arrival"), ("hire", "termination"), ("inserted", "updated"), ("issued", "due"), ("opened", "closed"), ("ordered", "paid"),
    ("paid", "shipped"), ("published", "expires"), ("starts", "ends"),
]

# --- choices of our own

#: Words that hint at a domain, and how strongly; half a point is enough. They are compared by their stems.
STEMS: dict[str, tuple[float, list[str]]] = {
    "boolean": (0.6, ["active", "enable", "verify"]),
    "commerce": (0.7, ["brand", "cart", "discount", "item", "order", "product", "shipment", "shipping"]),
    "contact": (0.8, ["email", "mobile", "phone", "website"]),
    "education": (0.7, ["course", "exam", "grade", "lesson", "semester"]),
    "finance": (0.7, ["balance", "budget", "cost", "currency", "invoice", "payment", "price", "revenue", "salary", "tax"]),
    "government": (0.7, ["agency", "ballot", "citizen", "license", "permit"]),
    "identifier": (0.7, ["barcode", "hash", "serial", "token", "tracking"]),
    "internet": (0.7, ["browser", "cookie", "domain", "session"]),
    "legal": (0.7, ["attorney", "clause", "contract", "court", "verdict"]),
    "location": (0.8, ["address", "city", "country", "latitude", "postal", "street", "venue", "warehouse"]),
    "medical": (0.8, ["allergy", "diagnosis", "dosage", "prescription", "symptom"]),
    "person": (0.8, ["author", "contact", "customer", "doctor", "driver", "employee", "member", "owner", "patient", "student", "teacher"]),
    "text": (0.6, ["comment", "description", "message", "note", "remark", "summary"]),
    "time": (0.7, ["birthday", "created", "date", "deadline", "expired", "scheduled", "time"]),
    "transport": (0.7, ["cargo", "flight", "mileage", "route", "vehicle"]),
}
#: Words that say nothing.
NOISE = ["a", "an", "by", "detail", "for", "has", "id", "in", "info", "is", "key", "main", "name", "num", "number", "of", "on", "the", "to", "type", "value"]


def squeezed(name: str) -> str:
    return name.replace("_", "").replace(" ", "")


def events(event: str) -> list[str]:
    """Names of the time of an event."""
    word = event.replace(" ", "_")
    return [*(f"{word}_{end}".rstrip("_") for end in EVENT_ENDS), *(f"{b}_{word}" for b in EVENT_BEGINNINGS), *(f"{b}_of_{word}" for b in EVENT_BEGINNINGS)]


def exact() -> dict[str, str]:
    """Generator by squeezed name. A name of its own comes before a time of an event, but for what a truth value and a time
    share (deleted): that depends on the column's kind, so both are known (see times)."""
    return {squeezed(n): generator for generator, names in NAMES.items() for n in names}


def times() -> dict[str, str]:
    """Generator by squeezed name of a time."""
    return {squeezed(n): generator for generator, names in EVENTS.items() for e in names for n in events(e)}


def ends() -> list[tuple[str, str]]:
    """(ending, generator), longest first."""
    return sorted(((f"_{e}", g) for g, words in ENDINGS.items() for e in words), key=lambda x: (-len(x[0]), x[0]))


def beginnings() -> list[tuple[str, str]]:
    return sorted(((f"{b}_", g) for g, words in BEGINNINGS.items() for b in words), key=lambda x: (-len(x[0]), x[0]))


def event_of(name: str) -> str:
    """The event that a time column names, squeezed: ordered_at, order_date, date_of_birth, check_in."""
    name = name.lower()
    for b in EVENT_BEGINNINGS:
        for lead in (f"{b}_of_", f"{b}_"):
            if name.startswith(lead) and len(name) > len(lead):
                return squeezed(name[len(lead) :])
    for e in EVENT_ENDS:
        if e and name.endswith(f"_{e}") and len(name) > len(e) + 1:
            return squeezed(name[: -len(e) - 1])
    if name.endswith("date") and len(name) > 4:
        return squeezed(name[:-4])
    return squeezed(name)
